"""Structure of Markdown texts: headings, code blocks, list items, paragraphs."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_ITEM = re.compile(r"( {0,3})(?:([-+*])|(\d{1,9})[.)])(?:[ \t]+(.*))?$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")


def elements(text: str | None) -> list[tuple[str, str, str, int, int]]:
    """(type, text, section heading, heading level, number) in order.

    A state machine over lines. The number counts elements (a code block counts its lines). Only paragraphs outside lists and quotations
    count; if nothing is found, every line that is not blank is a paragraph with its own line number. Blank texts have none.
    """
    t = (text or "").strip()
    if not t:
        return []
    out: list[tuple[str, str, str, int, int]] = []
    heading, number = "", 1
    para: list[str] = []
    item: list | None = None

    def emit(kind: str, s: str, level: int = 0, count: int = 1) -> None:
        nonlocal number, heading
        if s:
            if kind == "HEADING":
                heading = s
            out.append((kind, s, heading, level, number))
            number += count

    def flush() -> None:
        nonlocal para, item
        if para:
            emit("PARAGRAPH", "".join(p.strip() for p in para))
        if item:
            emit(item[0], "".join(item[1]))
        para, item = [], None

    lines = t.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        m = _FENCE.match(line)
        if m and not (m.group(1)[0] == "`" and "`" in m.group(2)):
            flush()
            code = []
            i += 1
            while i < len(lines) and not re.match(rf" {{0,3}}{re.escape(m.group(1)[0])}{{{len(m.group(1))},}}[ \t]*$", lines[i]):
                code.append(lines[i] + ("\n" if i + 1 < len(lines) else ""))
                i += 1
            emit("CODE_BLOCK", "".join(code), 0, len(code))
            i += 1
            continue
        if not line.strip():
            if item is None:
                flush()
            elif i + 1 < len(lines) and not lines[i + 1].startswith(("  ", "\t")) and not _ITEM.match(lines[i + 1]):
                flush()
            i += 1
            continue
        if h := _HEADING.match(line):
            flush()
            emit("HEADING", (h.group(2) or "").strip(), len(h.group(1)))
        elif para and (u := _SETEXT.match(line)):
            s, para = "".join(p.strip() for p in para), []
            emit("HEADING", s, 1 if u.group(1)[0] == "=" else 2)
        elif _RULE.match(line):
            flush()
        elif (x := _ITEM.match(line)) and (not para or x.group(4)) and not (para and x.group(3) not in (None, "1")):
            flush()
            item = ["NUMBERED_LIST" if x.group(3) else "BULLET_LIST", [(x.group(4) or "").strip()]]
        elif item is not None:
            item[1].append(line.strip())
        elif line.lstrip().startswith(">"):
            flush()
        else:
            para.append(line)
        i += 1
    flush()
    if not out:
        out = [("PARAGRAPH", x.strip(), "", 0, k + 1) for k, x in enumerate(lines) if x.strip()]
    return out


def structure(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, element_no, type, text, section_heading, heading_level, line_number) of each text; each is worked on alone."""
    schema = "doc_id string, element_no int, type string, text string, section_heading string, heading_level int, line_number int"

    def run(batches):
        for b in batches:
            rows = [(i, k, *e) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, e in enumerate(elements(t))]
            cols = list(zip(*rows)) or [[]] * 7
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types)], names=[x.split()[0] for x in schema.split(", ")])

    return df.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")).mapInArrow(run, schema)

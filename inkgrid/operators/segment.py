"""Units of text and token-budgeted chunks with overlap."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text as T

#: Version labels of the strategies.
PARSER_VERSIONS = {"exact": "tiktoken-exact-1.0", "sentence": "tiktoken-sentence-1.0", "paragraph": "tiktoken-paragraph-1.0", "character-based": "character-based-1.0"}
FALLBACK_VERSION = "paragraph-1.0"
#: Fixed value: the pattern that splits text before byte pairs are merged.
BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def paragraph_units(lines: DataFrame) -> DataFrame:
    """(document_id, unit_no, text, start_page, end_page): runs of lines that are not blank, joined by a space.

    The running number of blank lines names a run; a document's lines are one sorted group, as their order is the input.
    """
    w = Window.partitionBy("document_id").orderBy("line_no")
    d = lines.withColumn("_t", T.trim_ws(F.coalesce("text", F.lit("")))).withColumn("_g", F.sum((F.col("_t") == "").cast("int")).over(w))
    full = d.filter(F.col("_t") != "")
    g = full.groupBy("document_id", "_g").agg(F.sort_array(F.collect_list(F.struct("line_no", "_t", "page"))).alias("x"))
    u = g.select("document_id", F.row_number().over(Window.partitionBy("document_id").orderBy("_g")).alias("unit_no"), F.array_join("x._t", " ").alias("text"), F.get("x.page", F.lit(0)).alias("start_page"), F.element_at("x.page", -1).alias("end_page"))
    return u


def sentence_units(lines: DataFrame) -> DataFrame:
    """(document_id, unit_no, text, start_page, end_page): pieces of each line after ``. ``, ``! `` and ``? ``; never across lines."""
    s = F.split(F.regexp_replace(T.trim_ws(F.col("text")), r"([.!?]) ", "$1\n"), "\n")
    x = lines.select("document_id", "line_no", "page", F.posexplode(F.filter(F.transform(s, T.trim_ws), lambda v: v != "")).alias("_k", "text"))
    w = Window.partitionBy("document_id").orderBy("line_no", "_k")
    return x.select("document_id", F.row_number().over(w).alias("unit_no"), "text", F.col("page").alias("start_page"), F.col("page").alias("end_page"))


def sentences(c: Column, honorifics: tuple[str, ...] = ()) -> Column:
    """Sentences of a whole text: cut at . ! ? before white space or the end, unless the word before is an honorific."""
    pieces = F.filter(F.transform(F.split(c, r"(?<=[.!?])(?U:\s+)"), T.trim_ws), lambda x: x != "")
    if not honorifics:
        return pieces
    known = F.array(*[F.lit(h.lower()) for h in sorted(set(honorifics))])

    def last_word(s: Column) -> Column:
        return F.btrim(F.lower(F.element_at(F.split(s, r"(?U)\s+"), -1)), F.lit('.!?,"'))

    empty = F.array().cast("array<string>")

    def add(acc: Column, x: Column) -> Column:
        joined = F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.concat(F.element_at(acc, -1), F.lit(" "), x))
        return F.when((F.size(acc) > 0) & F.array_contains(known, last_word(F.try_element_at(acc, F.lit(-1)))), joined).otherwise(F.array_append(acc, x))

    return F.aggregate(pieces, empty, add)


def step_of(budget: int, overlap: int) -> int:
    """How far a window moves: the budget less the overlap, or half the budget; never below 1."""
    step = budget - overlap
    return step if step > 0 else max(1, budget // 2)


def chunk_ranges(tokens: Sequence[int], budget: int, overlap: int) -> list[tuple[int, int]]:
    """First and last unit (1-based) of each chunk.

    Units are appended until their tokens reach the budget or the last unit is in; then the next chunk begins with the longest run of
    last units within the overlap and takes at least one new unit. Two searches in the prefix sums for each chunk.
    """
    p = np.concatenate([[0], np.cumsum(np.asarray(tokens, np.int64))])
    n, out, s, e = len(p) - 1, [], 1, 0
    while e < n:
        e = min(n, max(e + 1, int(np.searchsorted(p, p[s - 1] + budget, "left"))))
        out.append((s, e))
        s = max(s, int(np.searchsorted(p, p[e] - overlap, "left")) + 1)
    return out


def pack_ranges(tokens: Column, budget: int, overlap: int) -> Column:
    """:func:`chunk_ranges` of an array column, in Arrow batches: the next chunk depends on the last, which array functions can
    only express with a quadratic number of interpreted steps."""

    @F.pandas_udf("array<struct<s:int,e:int>>")
    def ranges(t: pd.Series) -> pd.Series:
        return t.map(lambda x: [{"s": a, "e": b} for a, b in chunk_ranges(x, budget, overlap)] if x is not None else [])

    return ranges(tokens)


def pack_units(units: DataFrame, budget: int = 450, overlap: int = 80) -> DataFrame:
    """(document_id, chunk_index, content, start_page, end_page, start_char_offset, end_char_offset, first_unit, last_unit).

    Budgets count the column ``tokens`` of the units where there is one, else words. Offsets add up the UTF-8 lengths of the chunks before,
    overlap included.
    """
    counted = ["tokens"] if "tokens" in units.columns else []
    g = units.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("unit_no", "text", "start_page", "end_page", *counted))).alias("u"))
    tok = F.transform("u", lambda x: (x["tokens"] if counted else T.word_count(x["text"])).cast("bigint"))
    r = g.withColumn("r", pack_ranges(tok, budget, overlap)).select("document_id", "u", F.posexplode("r").alias("chunk_index", "r"))
    part = F.slice("u", F.col("r.s"), F.col("r.e") - F.col("r.s") + 1)
    c = r.select("document_id", "chunk_index", F.array_join(F.transform(part, lambda x: x["text"]), "\n\n").alias("content"), F.get(part, F.lit(0))["start_page"].alias("start_page"), F.element_at(part, -1)["end_page"].alias("end_page"), F.col("r.s").alias("first_unit"), F.col("r.e").alias("last_unit"))
    w = Window.partitionBy("document_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum(F.octet_length("content")).over(w), F.lit(0))
    return c.withColumn("start_char_offset", off.cast("int")).withColumn("end_char_offset", (off + F.octet_length("content")).cast("int"))


def _document_text(lines: DataFrame, separator: str, skip_blank: bool) -> DataFrame:
    """(document_id, text, start_page, end_page): a document's lines with a separator after each."""
    t = T.trim_ws(F.coalesce("text", F.lit(""))) if skip_blank else F.coalesce("text", F.lit(""))
    d = lines.select("document_id", "line_no", "page", t.alias("t"))
    d = d.filter("t <> ''") if skip_blank else d
    g = d.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "t"))).alias("x"), F.min_by("page", "line_no").alias("start_page"), F.max_by("page", "line_no").alias("end_page"))
    return g.select("document_id", F.concat(F.array_join("x.t", separator), F.lit(separator)).alias("text"), "start_page", "end_page")


def _windows(n: Column, size: int, step: int) -> Column:
    """Starts of windows until the first that reaches the end."""
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(step)))
    return F.transform(F.sequence(F.lit(0), last.cast("int")), lambda k: k * step)


def token_windows(lines: DataFrame, budget: int = 450, overlap: int = 80) -> DataFrame:
    """Chunks of exactly ``budget`` tokens (words, with the default tokenizer) that overlap; offsets are 0, pages those of the document."""
    d = _document_text(lines, " ", True).withColumn("w", T.words_of(F.col("text")))
    n = F.size("w")
    x = d.filter(n > 0).select("document_id", "start_page", "end_page", "w", F.posexplode(_windows(n, budget, step_of(budget, overlap))).alias("chunk_index", "_a"))
    return x.select("document_id", "chunk_index", F.array_join(F.slice("w", F.col("_a") + 1, budget), " ").alias("content"), "start_page", "end_page", F.lit(0).alias("start_char_offset"), F.lit(0).alias("end_char_offset"))


def load_bpe(ranks: bytes):
    """A byte-pair encoder of a public rank file (lines of base64 token and rank)."""
    import base64

    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=BPE_PATTERN, mergeable_ranks=table, special_tokens={})


def with_bpe_tokens(df: DataFrame, text_col: str, ranks: bytes, out: str = "tokens") -> DataFrame:
    """Adds the number of tokens of a byte-pair vocabulary; a null text has none."""
    cols = [c for c in df.columns if c != out]
    at = cols.index(text_col)

    def count(batches):
        enc = load_bpe(ranks)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int32())], names=[*cols, out])

    d = df.select(*[F.col(f"`{c}`") for c in cols])
    return d.mapInArrow(count, ", ".join(f"`{c}` {t}" for c, t in [*d.dtypes, (out, "int")]))


def bpe_windows(lines: DataFrame, ranks: bytes, budget: int = 450, overlap: int = 80) -> DataFrame:
    """As :func:`token_windows` with the tokens of a byte-pair vocabulary; a character cut by a window's end is replaced.

    The rank file travels with the task; every worker builds its encoder once for a batch stream.
    """
    d = _document_text(lines, " ", True)
    schema = "document_id string, chunk_index int, content string, start_page int, end_page int, start_char_offset int, end_char_offset int"

    def windows(batches):
        enc, step = load_bpe(ranks), step_of(budget, overlap)
        for b in batches:
            rows = []
            for doc, t, a, e in zip(*(c.to_pylist() for c in b.columns)):
                tok = enc.encode_ordinary(t)
                n = 1 if len(tok) <= budget else 1 + -(-(len(tok) - budget) // step)
                rows += [(doc, k, enc.decode(tok[k * step : k * step + budget]), a, e, 0, 0) for k in range(n if tok else 0)]
            cols = list(zip(*rows)) or [[]] * 7
            types = [pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types)], names=[x.split()[0] for x in schema.split(", ")])

    return d.select("document_id", "text", "start_page", "end_page").mapInArrow(windows, schema)


def char_windows(lines: DataFrame, budget: int = 450, overlap: int = 80, chars_per_token: int = 4) -> DataFrame:
    """Chunks of ``budget * chars_per_token`` code points that overlap; offsets count code points."""
    d = _document_text(lines, "\n", False)
    n, size, step = F.length("text"), budget * chars_per_token, step_of(budget, overlap) * chars_per_token
    x = d.filter(n > 0).select("document_id", "start_page", "end_page", "text", F.posexplode(_windows(n, size, step)).alias("chunk_index", "_a"))
    content = F.substring(F.col("text"), F.col("_a") + 1, F.lit(size))
    return x.select("document_id", "chunk_index", content.alias("content"), "start_page", "end_page", F.col("_a").alias("start_char_offset"), (F.col("_a") + F.length(content)).alias("end_char_offset"))


def chunk_documents(lines: DataFrame, strategy: str = "paragraph", budget: int = 450, overlap: int = 80, config: EngineConfig | None = None, ranks_file: str | None = None) -> DataFrame:
    """Chunks of lines by a strategy (exact, paragraph, sentence, character-based; any letter case, others are paragraph).

    Adds id (derived from document and index), language, parser_version and token_count. Limits that are not positive become the defaults.
    With ``ranks_file`` budgets of exact, paragraph and sentence chunks and token_count count the tokens of that vocabulary; if it cannot be
    loaded, paragraphs are chunked by words instead.
    """
    cfg = config or EngineConfig()
    budget = budget if budget > 0 else cfg.chunk_budget
    overlap = overlap if overlap > 0 else cfg.chunk_overlap
    s = strategy.strip().lower()
    s = s if s in PARSER_VERSIONS else "paragraph"
    version = PARSER_VERSIONS[s]
    ranks = None
    if s != "character-based" and ranks_file:
        try:
            ranks = Path(ranks_file).read_bytes()
            load_bpe(ranks)
        except Exception:
            s, version = "paragraph", FALLBACK_VERSION
    if s == "exact":
        c = bpe_windows(lines, ranks, budget, overlap) if ranks else token_windows(lines, budget, overlap)
    elif s == "character-based":
        c = char_windows(lines, budget, overlap, cfg.chars_per_token)
    else:
        units = paragraph_units(lines) if s == "paragraph" else sentence_units(lines)
        c = pack_units(with_bpe_tokens(units, "text", ranks) if ranks else units, budget, overlap).drop("first_unit", "last_unit")
    c = with_bpe_tokens(c, "content", ranks, "token_count") if ranks else c.withColumn("token_count", T.word_count(F.col("content")))
    return c.withColumn("id", T.stable_id(F.col("document_id"), F.col("chunk_index"))).withColumn("language", F.lit(cfg.default_language)).withColumn("parser_version", F.lit(version))

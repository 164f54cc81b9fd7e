"""One form for text that looks the same (problem 5).

Look-alike classes are the connected components, by union-find, of strings and code points that are drawn alike: letter
widths and presentation forms, ligatures, composed and combining accents, kinds of spaces, invisible characters, and
letters that several alphabets share (``letters.SAME_LETTERS``). The commonest member in the corpus represents its class, and
a multi-pattern automaton rewrites every other member, leftmost and longest first, until nothing changes.

Letter case, accents, digits and line breaks make a difference and are never rewritten into each other.

Defined results: a null text stays null, an empty one empty; a text of invisible characters becomes empty; rewriting
is idempotent; repeated rows of an id count once, by any of their (equal) contents.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import table
from .letters import SAME_LETTERS

#: Decomposition tags of forms that look like what they decompose into; not among them: super, sub, circle, square, fraction.
_ALIKE_TAGS = frozenset("wide narrow compat noBreak font initial medial final isolated vertical small".split())
_SPACES = regex.compile(r"[\p{Zs}\t]")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Default_Ignorable_Code_Point}︀-️]")


class UnionFind:
    """Transitive classes of strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, x: str, y: str) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


def alike_forms(c: str) -> str | None:
    """The string that a code point looks like by its decomposition."""
    d = unicodedata.decomposition(c)
    if not d:
        return None
    if d[0] == "<":
        tag, *codes = d.split()
        if tag.strip("<>") not in _ALIKE_TAGS:
            return None
        s = "".join(chr(int(x, 16)) for x in codes)
        return None if s[:1] == " " and len(s) > 1 else s  # spacing accents do not look like a space and an accent
    return "".join(chr(int(x, 16)) for x in d.split())


def rewrite_rules(counts: dict[str, int]) -> dict[str, str]:
    """pattern -> representative for the code points of a corpus with their counts."""
    uf = UnionFind()
    alphabet = set(counts)
    for cls in SAME_LETTERS.split():
        for c in cls[1:]:
            uf.union(cls[0], c)
            alphabet |= {cls[0], c}
    forms = {}
    todo = list(alphabet)
    while todo:
        c = todo.pop()
        if (s := alike_forms(c)) is not None:
            forms[c] = s
            for x in s:
                if x not in alphabet:
                    alphabet.add(x)
                    todo.append(x)
    if any(unicodedata.combining(c) for c in alphabet):  # what a base and a mark of the corpus may compose into
        marks = [c for c in alphabet if unicodedata.combining(c)]
        for b in [c for c in alphabet if c.isalpha() or c == "•"]:
            for m in marks:
                x = unicodedata.normalize("NFC", b + m)
                if len(x) == 1 and x not in forms and unicodedata.decomposition(x) and unicodedata.decomposition(x)[0] != "<":
                    forms[x] = b + m
                    alphabet.add(x)
    for c, s in forms.items():
        if len(s) == 1:
            uf.union(c, s)
    for c in alphabet:
        if _SPACES.match(c):
            uf.union(c, " ")
        elif _INVISIBLE.match(c) and not unicodedata.combining(c):
            uf.union(c, "")
        elif c in "‐‑":
            uf.union(c, "-")
    members = {c: [x for x in cls if len(x) == 1] for cls in uf.classes() for c in cls}
    for c, s in forms.items():
        if len(s) == 2 and unicodedata.combining(s[1]):
            for b in members.get(s[0], [s[0]]):
                for m in members.get(s[1], [s[1]]):
                    uf.union(c, b + m)
        elif len(s) > 1:
            uf.union(c, s)
    uf.union("  ", " ")
    uf.union(" \n", "\n")
    uf.union("\r\n", "\n")

    def weight(x: str) -> tuple:
        n = min((counts.get(c, 0) for c in x), default=0)
        if len(x) == 2 and unicodedata.combining(x[1]):
            n = min(n, counts.get(x[1], 0))
        return (-n, len(x), x)

    class_of = {x: cls for cls in uf.classes() if len(cls) > 1 for x in cls}
    reps: dict[str, str] = {}

    def rep_of(x: str) -> str:
        """The representative of x's class: the commonest member, where members of several characters are spelled with representatives."""
        cls = class_of.get(x)
        if cls is None:
            return x
        name = min(cls)
        if name not in reps:
            reps[name] = x  # what is asked for while the class is worked on
            fixed = next((r for r in ("", "\n", " ") if r in cls), None)  # runs of white space only shrink to these
            reps[name] = fixed if fixed is not None else min((y if len(y) == 1 else "".join(map(rep_of, y)) for y in cls), key=weight)
        return reps[name]

    return {x: rep_of(x) for x in class_of if x and x != rep_of(x)}


class Rewriter:
    """Greedy rewriting with an automaton over all patterns."""

    def __init__(self, rules: dict[str, str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for x, rep in rules.items():
            self.automaton.add_word(x, (len(x), rep))
        if rules:
            self.automaton.make_automaton()
        firsts = "".join(sorted({x[0] for x in rules if len(x) == 1}))
        plain = "".join(x for x in rules if len(x) == 1 and x.isascii())
        self.ascii_rules = regex.compile(f"[{regex.escape(plain)}]|  | \n|\r\n") if plain else regex.compile("  | \n|\r\n")
        self.single = regex.compile(f"[{regex.escape(firsts)}]|  | \n|\r\n|\\p{{M}}") if firsts else None

    def once(self, text: str) -> str:
        out, last = [], 0
        for end, (n, rep) in self.automaton.iter_long(text):
            if end - n + 1 < last:
                continue
            out.append(text[last : end - n + 1])
            out.append(rep)
            last = end + 1
        out.append(text[last:])
        return "".join(out)

    def __call__(self, text: str | None) -> str | None:
        if not text or self.single is None:
            return text
        if text.isascii() and not self.ascii_rules.search(text):
            return text.rstrip(" ")
        seen = {text}
        while (new := self.once(text)) not in seen:  # a run of spaces halves in each pass
            seen.add(new)
            text = new
        return text.rstrip(" ")


def code_point_counts(df: DataFrame, text_col: str) -> dict[str, int]:
    """How often each code point occurs in all texts. Tasks count in arrays; the result has no more rows than Unicode has characters."""

    def count(batches):
        total = np.zeros(0x110000, np.int64)
        for b in batches:
            s = "".join(t for t in b.column(0).to_pylist() if t)
            codes, n = np.unique(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
            total[codes] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["c", "n"])

    rows = df.select(F.col(f"`{text_col}`")).mapInArrow(count, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n")).collect()
    return {chr(r["c"]): int(r["n"]) for r in rows}


def rewrite(df: DataFrame, rules: dict[str, str], id_col: str = "id", text_col: str = "content", hashes_only: bool = False) -> DataFrame:
    """(id, variant, look[, canonical]): hashes of the stored and of the rewritten text, and the rewritten text itself."""
    sent = df.sparkSession.sparkContext.broadcast(rules)  # no larger than Unicode's tables
    schema = "id string, variant binary, look binary" + ("" if hashes_only else ", canonical string")

    def batches_out(batches):
        r = Rewriter(sent.value)
        digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for b in batches:
            texts = b.column(1).to_pylist()
            new = [r(t) for t in texts]
            cols = [b.column(0), pa.array([None if t is None else digest(t) for t in texts], pa.binary()), pa.array([None if t is None else digest(t) for t in new], pa.binary())]
            if not hashes_only:
                cols.append(pa.array(new, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    return df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(batches_out, schema)


def look_alike_pairs(looks: DataFrame) -> DataFrame:
    """(chunk_id_a, chunk_id_b) of different ids that look the same but are different strings.

    Variants are paired first and members joined to the pairs of variants, so a text with very many equal copies costs nothing
    unless it has a look-alike of another spelling.
    """
    rows = looks.filter(F.col("look").isNotNull() & F.col("id").isNotNull()).select("look", "variant", "id").distinct()
    variants = rows.select("look", "variant").distinct()
    several = variants.groupBy("look").agg(F.count("*").alias("n")).filter("n > 1").select("look")
    v = variants.join(several, "look", "left_semi")
    pairs = v.select("look", F.col("variant").alias("va")).join(v.select("look", F.col("variant").alias("vb")), "look").filter("va < vb")
    a = rows.select("look", F.col("variant").alias("va"), F.col("id").alias("ia"))
    b = rows.select("look", F.col("variant").alias("vb"), F.col("id").alias("ib"))
    both = pairs.join(a, ["look", "va"]).join(b, ["look", "vb"]).filter("ia <> ib")
    return both.select(F.least("ia", "ib").alias("chunk_id_a"), F.greatest("ia", "ib").alias("chunk_id_b")).distinct()


def p5_found(spark, d):
    chunks = table(spark, d, "chunks")
    rules = rewrite_rules(code_point_counts(chunks, "content"))
    return look_alike_pairs(rewrite(chunks, rules, hashes_only=True))


def p5_canonical(spark, d):
    """Every chunk's text in one form, with the canonical hash of that form."""
    chunks = table(spark, d, "chunks")
    rules = rewrite_rules(code_point_counts(chunks, "content"))
    r = rewrite(chunks, rules).dropDuplicates(["id"])
    flat = F.lower(F.trim(F.regexp_replace("canonical", r"(?U)\s+", " ")))
    return r.select(F.col("id").alias("chunk_id"), "canonical", F.when(F.length(flat) == 0, "").otherwise(F.sha2(flat, 256)).alias("canonical_hash"))

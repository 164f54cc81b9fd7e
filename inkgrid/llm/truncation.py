"""Text cut off by field limits or in transfer (problem 10).

A field limit shows as a spike in the hazard of text lengths: of the texts of a source that reach a length, far more
end there than at the lengths around it. Hazards come from window functions over the length counts of a source, in code
points and in UTF-8 bytes; each is tested against its neighbours with false-discovery control. Whether an ending is
incomplete is judged from the last sentence unit against counts over all units of all documents: how often units
that begin this way end without a terminator, and how often finished units close with these words (or, in scripts without
spaces, these characters).
A document is cut where both together make it likelier than not: at a significant length a doubtful ending
is enough, elsewhere (a transfer that broke off) the ending must be plain.

Defined results: null, empty and blank texts are no cases and not counted; a null source is a source of its own; an
ellipsis or a mark such as ``[...]`` at the end is judged by what stands before it; very long texts take no more memory than
themselves; with too few documents no length is significant and endings alone decide.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, table
from .sentences import _MARKER, _full_stop, _plain, sentence_spans

_TERMINATED = regex.compile(r"[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}…][\p{Cf}\p{Pe}\p{Pf}\"'”’»\s]*$")
_CUT_MARK = regex.compile(r"[\s]*(?:[\[(<]?[\s]*(?:\.{3,}|…+)[\s]*[\])>]?|[\[(<](?:\p{L}+[\s]*){0,4}(?:truncated|cut|more|continued|snip)[\p{L}\s]*[\])>]|�+)[\s]*$", regex.I)
_NO_TERMINATORS = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_DENSE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_DIGITS = regex.compile(r"\p{N}+")
_ASCII_DIGITS = re.compile(r"[0-9]+")
_PLAIN_ENDS = frozenset(".!?。！？।")
_TWO_WORDS = re.compile(r"\S+(?:\s+\S+)?")
_OPENERS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")"}


def _mask(s: str) -> str:
    """Numbers as one 9 each."""
    return (_ASCII_DIGITS if s.isascii() else _DIGITS).sub("9", s)


def _terminated(unit: str) -> bool:
    """Whether a unit ends with a terminator, closing quotes and brackets after it apart."""
    last = unit[-1]
    return last in _PLAIN_ENDS or (not last.isalnum() and bool(_TERMINATED.search(unit)))


def _unterminated(unit: str) -> str:
    last = unit[-1:]
    return unit if last.isalnum() else unit[:-1] if last in _PLAIN_ENDS else _TERMINATED.sub("", unit)


def _keys(unit: str) -> tuple[str, str]:
    """Two masks of how a unit begins, the longer one first."""
    m = _MARKER.match(unit)
    item = "L:" if m else ""
    s = _mask(_beginning(unit, m.end() if m else 0))
    if not s.isascii() and _DENSE.search(s[:3]):
        return item + s[:4], item + s[:2]
    w = s.split(None, 2)
    return item + " ".join(w[:2]), item + (w[0] if w else "")


def _beginning(unit: str, at: int) -> str:
    """The first two words of a unit, however long they are."""
    m = _TWO_WORDS.match(unit, at)
    return m.group() if m else ""


def _whole(unit: str) -> str:
    """The unit itself; a long one by its digest, so that keys stay small."""
    s = _mask(unit)
    return s if len(s) <= 80 else hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _close(unit: str) -> str:
    """How a finished unit ends, without its terminator: two words, or eight characters of a script without spaces."""
    body = _unterminated(unit).rstrip(" »”\"")
    if not body.isascii() and (_DENSE.search(body[-3:]) or _NO_TERMINATORS.search(body[-3:])):
        return body[-8:]
    return _mask(" ".join(body.rsplit(None, 2)[-2:]))


def _long(unit: str) -> bool:
    """Longer than headings and sign-offs are."""
    return len(unit.split()) >= 6 or (len(unit) >= 12 and bool(_DENSE.search(unit)))


def _tail(unit: str) -> str:
    return unit[-8:] if _NO_TERMINATORS.match(unit[-1]) else ""


def _open_quote(unit: str) -> bool:
    """Whether a quotation of the unit is not closed."""
    for a, b in _OPENERS.items():
        k = unit.rfind(a)
        if k >= 0 and not any(c in unit[k + 1 :] for c in b) and not (a == "“" and "„" in unit[max(0, k - 200) : k]):
            return True
    return unit.count('"') % 2 == 1


_DOC = ["doc_id", "source", "text_hash", "n_chars", "n_bytes", "ending", "k2", "k1", "whole", "close", "close1", "tail", "long"]
_DOC_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 7, pa.bool_()]
_COUNT = ["kind", "key", "n", "bare", "last_bare"]
_COUNT_TYPES = [pa.string(), pa.string(), *[pa.int64()] * 3]
_SCHEMA = "doc_id bigint, source string, text_hash bigint, n_chars int, n_bytes int, ending string, k2 string, k1 string, whole string, close string, close1 string, tail string, long boolean, kind string, key string, n bigint, bare bigint, last_bare bigint"


def _scan(batches):
    """One pass over the texts: a row for each document and, from each task, the counts over its units."""

    def flush(c):
        ks = list(c)
        cols = [pa.nulls(len(ks), t) for t in _DOC_TYPES] + [pa.array([k[0] for k in ks], pa.string()), pa.array([k[1] for k in ks], pa.string()), *[pa.array([c[k][i] for k in ks], pa.int64()) for i in range(3)]]
        return pa.RecordBatch.from_arrays(cols, names=_DOC + _COUNT)

    counts: dict[tuple[str, str], list[int]] = {}

    def add(kind: str, key: str, bare: bool, last: bool) -> None:
        if key:
            v = counts.get((kind, key))
            if v is None:
                v = counts[kind, key] = [0, 0, 0]
            v[0] += 1
            if bare:
                v[1] += 1
                v[2] += last

    for b in batches:
        out: list[list] = [[] for _ in _DOC]
        for i, s, text, th in zip(*(c.to_pylist() for c in b.columns)):
            if not text or text.isspace():
                continue
            body = text.rstrip()
            m = _CUT_MARK.search(body[-80:])
            mark = m is not None and m.start() > 0
            if mark:
                body = body[: len(body) - len(body[-80:]) + m.start()].rstrip()
            starts, ends = sentence_spans(body)
            for a, e in zip(starts[:-1], ends[:-1]):
                u = body[a:e]
                bare = not _terminated(u)
                k2, k1 = _keys(u)
                add("2", k2, bare, False)
                add("1", k1, bare, False)
                if bare:
                    add("W", _whole(u), True, False)
                    add("E", _tail(u), True, False)
                else:
                    z = _close(u)
                    add("Z", z, False, False)
                    add("Z1", z.rsplit(" ", 1)[-1], False, False)
            u = body[starts[-1] :] if starts else body
            done = bool(u) and _terminated(u)
            k2, k1 = _keys(u) if u else ("", "")
            if not done:
                add("2", k2, True, True)
                add("1", k1, True, True)
            if _open_quote(body[body.rfind("\n\n") + 1 :]) or (done and not mark and u[-1] == "." and not _full_stop(u, 0, len(u) - 1, len(u), "", False)):
                kind = "open"
            else:
                kind = "done" if done else "mark" if mark else "bare"
            z = _close(u)
            row = (i, s, th, len(text), len(text.encode("utf-8", "surrogatepass")), kind, k2, k1, _whole(u), z, z.rsplit(" ", 1)[-1], _tail(u) if u else "", _long(u))
            for c, v in zip(out, row):
                c.append(v)
        n = len(out[0])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _DOC_TYPES)] + [pa.nulls(n, t) for t in _COUNT_TYPES], names=_DOC + _COUNT)
        if len(counts) > 200_000:
            yield flush(counts)
            counts.clear()
    yield flush(counts)


def scan(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The endings of all documents with text, and the counts over the units of all documents.

    Endings: ending is done, mark (an ellipsis or another mark after an unfinished unit), open (an unclosed quotation, an
    abbreviation) or bare; the other columns are the keys of the last unit. Counts: for each key how many units have it, how many
    end without a terminator, and how many of those are the last of their document. Kinds: 2 and 1 beginnings, W whole short units, Z
    and Z1 how finished units close, E endings in scripts without terminators.
    """
    rows = cut(documents.select(F.col("doc_id").cast("bigint"), "source", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_scan, _SCHEMA))
    counts = rows.filter(F.col("kind").isNotNull()).groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("bare").alias("bare"), F.sum("last_bare").alias("last_bare"))
    return rows.filter(F.col("kind").isNull()).select(*_DOC), cut(counts)


def length_spikes(ends: DataFrame, reach: int = 40, q: float = 0.01, least: int = 4) -> DataFrame:
    """(source, unit, length, n, expected): the lengths at which significantly many different texts of a source end.

    Hazard: texts of this length over texts at least as long. The expectation is the hazard of the ``reach`` lengths on either
    side; the tail of the count is bounded by Chernoff's inequality; Benjamini and Hochberg's procedure keeps the false
    discoveries of a source below ``q``. Windows run over lengths, of which there are few, not over documents.
    """
    stacked = ends.select("source", "text_hash", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("length")))).alias("x")).select("source", "text_hash", "x.*")
    n = stacked.distinct().groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    by = Window.partitionBy("source", "unit")
    longer = by.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    near = by.orderBy("length").rangeBetween(-reach, reach)
    h = n.withColumn("at_risk", F.sum("n").over(longer)).withColumn("around", F.sum("n").over(near) - F.col("n"))
    hazard_near = (F.col("around") + 0.5) / (2.0 * reach * F.col("at_risk"))
    t = h.withColumn("expected", F.col("at_risk") * hazard_near).withColumn("log_p", F.when(F.col("n") > F.col("expected"), F.col("n") - F.col("expected") + F.col("n") * F.log(F.col("expected") / F.col("n"))).otherwise(F.lit(0.0)))
    r = t.withColumn("m", F.count("*").over(by)).withColumn("rank", F.row_number().over(by.orderBy("log_p", "length")))
    ok = F.col("log_p") <= F.log(F.lit(q) * F.col("rank") / F.col("m"))
    r = r.withColumn("last", F.max(F.when(ok, F.col("rank"))).over(by))
    return r.filter((F.col("rank") <= F.col("last")) & (F.col("n") >= least)).select("source", "unit", "length", "n", "expected")


def incompleteness(e: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``evidence``: how many times likelier the ending is in a cut text than in a whole one."""
    look = e.filter(F.col("ending").isin("bare", "mark"))

    def with_counts(d: DataFrame, kind: str, col: str) -> DataFrame:
        c = counts.filter(F.col("kind") == kind).select(F.col("key").alias(f"_{kind}"), F.struct("n", "bare", "last_bare").alias(f"c{kind}"))
        return d.join(c, F.col(col) == F.col(f"_{kind}"), "left").drop(f"_{kind}")

    d = look
    for kind, col in (("2", "k2"), ("1", "k1"), ("W", "whole"), ("E", "tail"), ("Z", "close"), ("Z1", "close1")):
        d = with_counts(d, kind, col)

    def rate(c: str) -> Column:
        """Share of units beginning so that end bare; those that are last in their document may be cut and count only where no unit before
        the last begins so."""
        inner, inner_bare = F.col(f"{c}.n") - F.col(f"{c}.last_bare"), F.col(f"{c}.bare") - F.col(f"{c}.last_bare")
        return F.when(inner >= 3, (inner_bare + 0.002) / (inner + 0.004)).when((inner <= inner_bare) & (F.col(f"{c}.n") >= 3), F.lit(1.0))

    known = F.coalesce(rate("c2"), rate("c1"))
    from_start = F.when(known > 0.6, 0.001).when(known.isNotNull(), 1 / F.greatest(known, F.lit(0.002))).otherwise(F.when(F.col("long"), 200.0).otherwise(20.0))
    whole_known = F.coalesce(F.col("cW.n"), F.lit(0)) >= 2
    tail_known = F.coalesce(F.col("cE.n"), F.lit(0)) >= 2
    evidence = F.when(whole_known, 0.001).when(F.length("tail") > 0, F.when(tail_known, 0.001).otherwise(200.0)).otherwise(from_start)
    # a mark after a finished thought is a manner of writing unless texts of this source are cut at this length
    finished = (F.coalesce(F.col("cZ.n"), F.lit(0)) >= 2) | (F.coalesce(F.col("cZ1.n"), F.lit(0)) >= 5)
    evidence = F.when(F.col("ending") == "mark", F.when(finished, 0.1).otherwise(1000.0)).otherwise(evidence)
    judged = d.select(*e.columns, evidence.alias("evidence"))
    rest = e.filter(~F.col("ending").isin("bare", "mark")).withColumn("evidence", F.when(F.col("ending") == "open", 100.0).otherwise(0.0001))
    return judged.unionByName(rest)


def truncated(documents: DataFrame, odds_elsewhere: float = 0.03, slack: int = 4, q: float = 0.01) -> DataFrame:
    """(doc_id, source, n_chars, n_bytes, ending, evidence, limit_unit, limit_length, cut) of each document with text."""
    e, counts = scan(documents)
    spikes = length_spikes(e, q=q)
    # a limit in bytes or one before trailing space was trimmed leaves texts a few below it
    odds = (F.col("n") - F.col("expected")) / F.greatest(F.col("expected"), F.lit(0.01))
    # a marked text may have lost a word more, and the mark may come on top of the limit
    def spread(below: int, above: int, mark: bool) -> DataFrame:
        off = F.col("length") - F.col("at")
        w = F.lit(1.0) if mark else 1 + off
        return spikes.withColumn("at", F.explode(F.sequence(F.col("length") - below, F.col("length") + above))).withColumn("odds", odds / w).withColumn("mark", F.lit(mark))

    both = spread(slack, 0, False).unionByName(spread(4 * slack, 6, True))
    best = both.groupBy("source", "unit", "at", "mark").agg(F.max(F.struct("odds", "length")).alias("b")).select(F.col("source").alias("_s"), "unit", "at", "mark", "b.odds", F.col("b.length").alias("limit"))
    j = incompleteness(e, counts)
    for unit, col in (("chars", "n_chars"), ("bytes", "n_bytes")):
        s = best.filter(F.col("unit") == unit).select("_s", "at", "mark", F.col("odds").alias(f"odds_{unit}"), F.col("limit").alias(f"limit_{unit}"))
        j = j.join(s, F.col("source").eqNullSafe(F.col("_s")) & (F.col(col) == F.col("at")) & ((F.col("ending") == "mark") == F.col("mark")), "left").drop("_s", "at", "mark")
    c, y = F.coalesce("odds_chars", F.lit(0.0)), F.coalesce("odds_bytes", F.lit(0.0))
    prior = F.greatest(c, y, F.lit(odds_elsewhere))
    return j.select(
        "doc_id", "source", "n_chars", "n_bytes", "ending", "evidence",
        F.when((c >= y) & (c > 0), "chars").when(y > 0, "bytes").alias("limit_unit"),
        F.when((c >= y) & (c > 0), F.col("limit_chars")).when(y > 0, F.col("limit_bytes")).alias("limit_length"),
        (prior * F.col("evidence") > 1).alias("cut"),
    )


def p10_found(spark, d):
    return truncated(table(spark, d, "documents")).filter("cut").select("doc_id")


def p10_sources(spark, d):
    """For each source its documents with text, those cut, their share, and how many of them were cut at a field limit."""
    t = truncated(table(spark, d, "documents"))
    return t.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("cut").cast("int")).alias("truncated"), F.round(F.avg(F.col("cut").cast("int")), 6).alias("share"), F.sum((F.col("cut") & F.col("limit_length").isNotNull()).cast("int")).alias("at_a_limit"))

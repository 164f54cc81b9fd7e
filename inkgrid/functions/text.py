"""Text functions, Column to Column. All stay in the JVM but the compatibility composition, the 64-bit hash and the character statistics, which go through Arrow once."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, StringType, StructField, StructType


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once. Inside array lambdas an expression would be computed anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nfkc(c: Column) -> Column:
    """Compatibility composition; there is no built-in. One Arrow batch call, ASCII texts pass untouched."""
    return _nfkc(c)


def strip_control(c: Column) -> Column:
    """Deletes control characters but line feeds and tabs."""
    return F.regexp_replace(c, r"[\p{Cc}&&[^\n\t]]", "")


def trim_ws(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_ws(c: Column) -> Column:
    """Runs of Unicode white space become one space; none stays at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def lines_of(c: Column) -> Column:
    return F.split(c, "\n", -1)


def trimmed_lines(c: Column) -> Column:
    return F.transform(lines_of(c), trim_ws)


def dehyphenate(c: Column) -> Column:
    """Joins a line that ends in a hyphen with a following line that is not blank; a joined line is not joined again.

    Works on trimmed lines. Matches do not overlap, so the second of two hyphens in a row stays.
    """
    return F.regexp_replace(F.array_join(trimmed_lines(c), "\n"), r"-\n([^\n]+)", "$1")


def drop_blank_lines(c: Column) -> Column:
    """Collapses white space within lines and drops the lines that become empty."""
    return F.array_join(F.filter(F.transform(lines_of(c), collapse_ws), lambda x: x != ""), "\n")


def normalize_text(c: Column) -> Column:
    """Composition, control characters, end-of-line hyphens, white space, blank lines; lines stay lines."""
    return drop_blank_lines(dehyphenate(strip_control(nfkc(c))))


def clean_chunk_text(c: Column) -> Column:
    """As :func:`normalize_text` but hyphens stay."""
    return drop_blank_lines(strip_control(nfkc(c)))


def canonical_text(c: Column) -> Column:
    return F.lower(collapse_ws(nfkc(c)))


def canonical_hash(c: Column) -> Column:
    """SHA-256 of the composed, lower-cased, white-space-collapsed text; empty for a blank text, null for null."""
    t = canonical_text(c)
    return F.when(F.length(t) == 0, F.lit("")).otherwise(F.sha2(t, 256))


def checksum(c: Column) -> Column:
    """SHA-256 of raw bytes."""
    return F.sha2(c.cast("binary"), 256)


def paragraph_hash(c: Column) -> Column:
    return F.md5(F.lower(collapse_ws(c)))


def fnv1a64_value(data: bytes) -> int:
    # fixed values: offset basis and prime of the 64-bit hash
    h = 14695981039346656037
    for b in data:
        h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


@F.pandas_udf(DecimalType(20, 0))
def _fnv(s: pd.Series) -> pd.Series:
    from decimal import Decimal

    return s.map(lambda t: None if t is None else Decimal(fnv1a64_value(t.encode("utf-8", "surrogatepass"))))


def fnv1a64(c: Column) -> Column:
    """FNV-1a as an unsigned 64-bit number."""
    return _fnv(c)


def share(c: Column, char_class: str) -> Column:
    """Share of the code points of the trimmed text that are of a class; 0 for a blank text."""
    return let(trim_ws(c), lambda t: F.when(F.length(t) > 0, F.regexp_count(t, F.lit(char_class)) / F.length(t)).otherwise(F.lit(0.0)))


def letter_share(c: Column) -> Column:
    return share(c, r"\p{L}")


def digit_share(c: Column) -> Column:
    return share(c, r"\p{Nd}")


def upper_share(c: Column) -> Column:
    return share(c, r"\p{Lu}")


def space_share(c: Column) -> Column:
    return share(c, r"(?U)\s")


#: Unicode white space, as ``(?U)\\s`` means it.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER, _UPPER, _DIGIT, _SPACE = 1, 2, 4, 8


@cache
def _classes() -> np.ndarray:
    """What each code point is, as bits; made once in a worker process."""
    t = np.zeros(0x110000, np.uint8)
    for i in range(0x32000):
        c = unicodedata.category(chr(i))
        t[i] = (_LETTER if c[0] == "L" else 0) | (_UPPER if c == "Lu" else 0) | (_DIGIT if c == "Nd" else 0)
    t[[ord(c) for c in WHITE_SPACE]] |= _SPACE
    return t


def character_counts(text: str) -> tuple[int, int, int, int, int, int, float]:
    """Bytes, code points, words, letters, digits, upper-case letters and Shannon entropy in bits of a text without white space at its ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    if not n:
        return 0, 0, 0, 0, 0, 0, 0.0
    k = np.bincount(codes) if text.isascii() else np.unique(codes, return_counts=True)[1]
    k = k[k > 0].astype(np.float64)
    cls = _classes()[codes]
    space = (cls & _SPACE) > 0
    words = int(np.count_nonzero(~space[1:] & space[:-1])) + int(not space[0])
    return len(text.encode("utf-8", "surrogatepass")), n, words, int(np.count_nonzero(cls & _LETTER)), int(np.count_nonzero(cls & _DIGIT)), int(np.count_nonzero(cls & _UPPER)), float(np.log2(n) - (k * np.log2(k)).sum() / n)


COUNTS = ("octets", "chars", "words", "letters", "digits", "uppers")


@F.pandas_udf(StructType([*[StructField(x, IntegerType()) for x in COUNTS], StructField("entropy", DoubleType())]))
def _stats(s: pd.Series) -> pd.DataFrame:
    rows = [(None,) * 7 if t is None else character_counts(t.strip(WHITE_SPACE)) for t in s]
    return pd.DataFrame(rows, columns=[*COUNTS, "entropy"]).astype({"entropy": "float64"} | {x: "Int32" for x in COUNTS})


def text_stats(c: Column) -> Column:
    """struct of the counts of :func:`character_counts` of the trimmed text, in one pass over it; nulls for a null text."""
    return _stats(c)


@F.pandas_udf(DoubleType())
def _entropy(s: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else character_counts(t)[-1] for t in s], dtype="float64")


def entropy(c: Column) -> Column:
    """Shannon entropy in bits over the code points of a text; 0 for an empty one, null for null."""
    return _entropy(c)


def words_of(c: Column) -> Column:
    """White-space words; none for a blank text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """The default token count."""
    return F.size(words_of(c))


def query_text(c: Column, prefix: str = "search_query: ") -> Column:
    """The prefix of queries, unless the text has it."""
    return F.when(F.lower(c).startswith(prefix.strip().lower()), c).otherwise(F.concat(F.lit(prefix), c))


def entity_labels(entities: Column) -> Column:
    """CATEGORY:text of each entity."""
    return F.transform(entities, lambda e: F.concat(e["category"], F.lit(":"), e["text"]))


def stable_id(*parts: Column) -> Column:
    """A content-derived identifier in UUID form: the same input always gets the same one."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def format_vector(c: Column) -> Column:
    """``[a,b,...]``"""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))


def parse_vector(c: Column) -> Column:
    return F.from_json(c, "array<float>")


def metadata_json(meta: Column, optional_text: tuple[str, ...] = ("tenant_id", "section_heading"), optional_lists: tuple[str, ...] = ("entities", "keywords")) -> Column:
    """JSON of a metadata struct; empty optional texts and lists are left out."""
    for f in optional_text:
        meta = meta.withField(f, F.when(F.length(meta[f]) > 0, meta[f]))
    for f in optional_lists:
        meta = meta.withField(f, F.when(F.size(meta[f]) > 0, meta[f]))
    return F.to_json(meta)

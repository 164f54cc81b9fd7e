"""Splitting oversized items at natural boundaries (problem 7).

A sparse table over the boundary strengths of a text answers "the strongest cut in this window of lengths" in constant
time; of equally strong cuts the rightmost wins. The next piece begins the overlap before the cut.

Defined results: a null content gives no piece; an empty or blank one, or one within the limits, gives a single piece
(of the whole text) only if asked for with ``all_rows``; a longer text of white space only gives one empty piece; a text without any boundary is cut at the last code point that
is allowed, never between a base and its combining mark. Of repeated rows of one id the latest above a limit counts (by ``created_at`` where
there is one, then by content), and only it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundary strengths: paragraph, list item or line, sentence, clause, word, between code points.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, CHARACTER, NEVER = 6, 5, 4, 3, 2, 1, 0

_PARA = regex.compile(r"\n[^\S\n]*\n\s*")
_LINE = regex.compile(r"\n[^\S\n]*")
_CLAUSE = regex.compile(r"[,;:،؛、，；：—–][\p{Pf}\p{Pe}\"']*\s*")
_SPACE = regex.compile(r"\s+")
_WORDS = regex.compile(r"\S+")
_JOINED = regex.compile(r"[\p{M}‌‍⁠︀-️]|(?<=‍)\P{C}")


def strengths(text: str) -> np.ndarray:
    """The strength of a cut before each code point, 0 to len(text)."""
    from .sentences import sentence_spans

    s = np.full(len(text) + 1, CHARACTER, np.int64)
    for m in _JOINED.finditer(text):
        s[m.start()] = NEVER
    for m in _SPACE.finditer(text):
        s[m.start() : m.end()] = NEVER
        s[m.end()] = WORD
    for m in _CLAUSE.finditer(text):
        s[m.end()] = max(s[m.end()], CLAUSE) if s[m.end()] else NEVER
    starts, _ = sentence_spans(text)
    for p in starts:
        s[p] = SENTENCE
    for m in _LINE.finditer(text):
        if s[m.end()] >= SENTENCE:
            s[m.end()] = LINE
    for m in _PARA.finditer(text):
        s[m.end()] = PARAGRAPH
    s[0] = s[len(text)] = PARAGRAPH
    return s


class RangeMax:
    """Sparse table: the rightmost position of the maximum of any range of at most ``longest`` places."""

    def __init__(self, values: np.ndarray, longest: int):
        row = values * (1 << 32) + np.arange(len(values))
        self.rows = [row]
        k = 1
        while 2 * k <= min(len(values), longest):
            row = np.maximum(row[:-k], row[k:])
            self.rows.append(row)
            k *= 2

    def argmax(self, lo: int, hi: int) -> int:
        """lo and hi belong to the range."""
        j = (hi - lo + 1).bit_length() - 1
        r = self.rows[j]
        return int(max(r[lo], r[hi - (1 << j) + 1]) & 0xFFFFFFFF)


def split_text(text: str, max_tokens: int, max_chars: int, overlap_tokens: int, least: float = 0.5) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, overlap tokens with the piece before) of each piece; tokens are white-space words.

    Every piece holds at most max_tokens words and max_chars code points; the cut lies in the last ``1 - least`` of the
    permissible length. The overlap is overlap_tokens words; where a piece holds no more words than that (scripts without spaces), it is the
    same share of max_chars, at most half of the piece, cut at the strongest boundary there. Every piece ends after the one before.
    """
    n = len(text)
    words = [m.span() for m in _WORDS.finditer(text)]
    w_start = np.array([a for a, _ in words], np.int64)
    w_end = np.array([b for _, b in words], np.int64)

    def count(a: int, b: int) -> int:
        """Words, or parts of words, in text[a:b]."""
        if b <= a or not len(w_start):
            return 0
        return int(np.searchsorted(w_start, b, "left") - np.searchsorted(w_end, a, "right"))

    def reach(a: int) -> int:
        """Where a piece that starts at a has to end at the latest."""
        first = int(np.searchsorted(w_end, a, "right"))
        far = min(n_end, a + max_chars)
        return min(far, int(w_start[first + max_tokens])) if first + max_tokens < len(words) else far

    if n <= max_chars and len(words) <= max_tokens:
        return [(0, n, len(words), 0)]
    if not words:
        return [(0, 0, 0, 0)]
    table = RangeMax(strengths(text), max_chars + 1)
    out, a, back, past = [], int(w_start[0]) if len(w_start) else 0, 0, 0
    n_end = int(w_end[-1]) if len(w_end) else n
    while True:
        far = reach(a)
        if far >= n_end:
            out.append((a, n_end, count(a, n_end), back))
            return out
        lo = max(a + int((far - a) * least), past + 1 if out else a + 1)
        cut = table.argmax(min(lo, far), far)
        if cut <= (past if out else a) or table.rows[0][cut] >> 32 == NEVER:
            cut = far  # no boundary in the window: e.g. a single huge grapheme
        end = cut
        while end > a and text[end - 1].isspace():
            end -= 1
        out.append((a, end, count(a, end), back))
        if overlap_tokens <= 0:
            a, back, past = cut, 0, cut
            continue
        i = int(np.searchsorted(w_start, cut, "left")) - overlap_tokens
        past = int(w_start[i + overlap_tokens]) if text[cut].isspace() else cut  # where the text after this piece begins
        nxt = int(w_start[i]) if i >= 0 else -1
        while a < nxt < past and reach(nxt) <= past:  # wide spaces: no word of the next piece would be new
            i += 1
            nxt = int(w_start[i])
        if nxt <= a:
            room = min(int(max_chars * overlap_tokens / max_tokens), (cut - a) // 2)
            nxt = table.argmax(cut - room, cut - room // 2) if room > 1 else cut
            if table.rows[0][nxt] >> 32 == NEVER:
                nxt = cut
        nxt = nxt if nxt > a else cut
        if nxt < past and reach(nxt) <= past:
            nxt = past
        a, back = nxt, count(nxt, end)


def _latest(big: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """id, text and more columns of the latest version of each id. Only ids, times and hashes are compared; rows that are equal in them all stay."""
    at = F.col("created_at") if "created_at" in big.columns else F.lit(None).cast("timestamp")
    keyed = big.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *more, F.struct(at.alias("t"), F.xxhash64(F.col(f"`{text_col}`")).alias("h")).alias("_v"))
    last = keyed.groupBy(F.col("id").alias("_k")).agg(F.max("_v").alias("_m"))
    return keyed.join(last, F.col("id").eqNullSafe(F.col("_k")) & F.col("_v").eqNullSafe(F.col("_m"))).drop("_v", "_k", "_m")


def oversized_pieces(chunks: DataFrame, max_tokens: int, max_chars: int, overlap_tokens: int, id_col: str = "id", text_col: str = "content", least: float = 0.5) -> DataFrame:
    """(id, n_chars, piece_no, start_char, end_char, token_count, overlap_tokens, piece) of each item above a limit.

    The test of the limits runs in the JVM before any text reaches Python; each text is worked on alone, so nothing is
    shuffled but the finished pieces, which make repeated rows one.
    """
    text = F.col(f"`{text_col}`")
    big = _latest(chunks.filter((F.length(text) > max_chars) | (F.size(F.split(F.trim(text), r"(?U)\s+")) > max_tokens)), id_col, text_col)
    schema = "id string, n_chars int, piece_no int, start_char int, end_char int, token_count int, overlap_tokens int, piece string"

    def pieces(batches):
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [(i, len(t), k, a, e, w, o, t[a:e]) for k, (a, e, w, o) in enumerate(split_text(t, max_tokens, max_chars, overlap_tokens, least))]
            cols = list(zip(*rows)) or [[]] * 8
            types = [pa.string(), *[pa.int32()] * 6, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in schema.split(", ")])

    return big.mapInArrow(pieces, schema).groupBy("id", "piece_no").agg(*[F.first(c).alias(c) for c in ("n_chars", "start_char", "end_char", "token_count", "overlap_tokens", "piece")])


def limits(size_limits: DataFrame, item: str) -> tuple[int, int, int | None]:
    """(max_tokens, overlap_tokens, max_chars) of an item of the fixed three-row table."""
    r = size_limits.filter(F.col("item") == item).first()
    if r is None:
        raise ValueError(f"size_limits has no item {item!r}")
    return int(r["max_tokens"]), int(r["overlap_tokens"] or 0), r["max_chars"]


def chunk_pieces(chunks: DataFrame, documents: DataFrame, size_limits: DataFrame) -> DataFrame:
    """Pieces of oversized chunks with their offset in the document's text.

    A stored offset is trusted if the stored span is as long as the content; otherwise (parser versions that leave 0) the
    content is looked for in the document's text; ``start_char_offset`` is null where it cannot be found.
    """
    max_tokens, overlap, max_chars = limits(size_limits, "chunk")
    p = oversized_pieces(chunks, max_tokens, max_chars, overlap)
    big = _latest(chunks.filter((F.length("content") > max_chars) | (F.size(F.split(F.trim("content"), r"(?U)\s+")) > max_tokens)), "id", "content", "document_id", "metadata")
    meta = big.select("id", "document_id", F.col("metadata.start_char_offset").alias("a"), F.col("metadata.end_char_offset").alias("e"), F.length("text").alias("n"), F.col("text").alias("content"))
    meta = meta.groupBy("id").agg(F.max(F.struct("document_id", "a", "e", "n", "content")).alias("m")).select("id", "m.*")
    trusted = F.col("e") - F.col("a") == F.col("n")
    lost = meta.filter(~F.coalesce(trusted, F.lit(False))).select("id", "document_id", "content")
    texts = documents.select(F.col("document_id"), F.col("text")).filter(F.col("text").isNotNull())
    at = lost.join(texts, "document_id").select("id", F.expr("instr(text, content) - 1").alias("found")).filter("found >= 0").groupBy("id").agg(F.min("found").alias("found"))
    base = meta.select("id", F.when(trusted, F.col("a")).alias("stored")).join(at, "id", "left").select(F.col("id"), F.coalesce("stored", "found").alias("base"), F.when(F.col("stored").isNotNull(), "stored").when(F.col("found").isNotNull(), "located").otherwise("unknown").alias("offset_source"))
    return p.join(base, "id", "left").select(F.col("id").alias("chunk_id"), "piece_no", "start_char", "end_char", "token_count", "overlap_tokens", (F.col("base") + F.col("start_char")).cast("int").alias("start_char_offset"), "offset_source", "piece", "n_chars")


def p7_found(spark, d):
    from ..runtime import table

    max_tokens, overlap, max_chars = limits(table(spark, d, "size_limits"), "chunk")
    p = oversized_pieces(table(spark, d, "chunks"), max_tokens, max_chars, overlap)
    return p.filter((F.col("piece_no") == 0) & (F.col("n_chars") > max_chars)).select(F.col("id").alias("chunk_id"))


def p7_pieces(spark, d):
    from ..runtime import table

    return chunk_pieces(table(spark, d, "chunks"), table(spark, d, "documents"), table(spark, d, "size_limits")).drop("n_chars")

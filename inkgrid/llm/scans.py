"""Repairing text from scanned pages (problem 6).

Three questions are answered for the lines of every document: which are page furniture, which words are broken only by
the line's end, and which words hold misrecognised characters.

Line-pair classifiers (gradient-boosted trees) look at lines near a page's edges together with their neighbours and how often they
recur, and at the two parts of a broken word together with the counts of what they would join to. Correction candidates come from an
inverted join over character q-grams, and for words without a commoner likeness from the replacements that these candidates show;
how often one string is read as another is counted over all candidates, and a gradient-boosted ranking over these counts
decides. All word, q-gram and confusion counts cover all documents; only the classifiers are fitted on bounded samples
(``sample_rows``).

A block of a document's lines, with some lines of context, is one row: lines are shuffled once, as sets, so that repeated rows
end in the first task, and a document of any length is no single task. Tokens stay in these rows; only their counts, the broken
words and what looks misread leave them.

Defined results: repeated rows of a line count once; a null text is an empty line; a null page is that of the line before (at a
document's start: after); null document ids or line numbers are left out; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, table
from .boosting import Boosted

#: Lines of a block and of the context on either side.
BLOCK, CONTEXT = 2048, 160
HYPHENS = "-‐¬\xad"
_TOKEN = regex.compile(r"(?:(?<!\S)!(?=\p{Ll}{2}))?[\p{L}\p{M}\p{N}@]+(?:![\p{L}\p{N}@]+)*")
_WORDS_HYPHEN = regex.compile(r"[\p{L}\p{M}\p{N}@]+(?:[-‐][\p{L}\p{M}\p{N}@]+)+")
_BROKEN = regex.compile(rf"([\p{{L}}\p{{M}}@][\p{{L}}\p{{M}}\p{{N}}@!]*)[{HYPHENS}]$")
_FIRST = regex.compile(r"^[\p{L}\p{M}\p{N}@!]+")
_TOKEN_ASCII = re.compile(r"(?:(?<!\S)!(?=[a-z]{2}))?[A-Za-z0-9@]+(?:![A-Za-z0-9@]+)*")
_WHITE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_SIDE_NUMBER = re.compile(r"^\s*(\d{1,4}|[ivxlc]{1,6})\s{2,}|\s{2,}(\d{1,4}|[ivxlc]{1,6})\s*$")
_NUMBER_LINE = re.compile(r"^[\s\-–—\[(|/.]*(?:[^\W\d_]{1,9}(?:\.\s*|\s+))?(\d{1,5}|[ivxlc]{1,7})(?:\s*(?:/|[^\W\d_]{1,4})\s*\d{1,5})?[\s\-–—\])|/.]*$", re.I)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_TERMINAL = re.compile(r"[.!?:;][\"'”’»)\]]*$")
# What scanning confuses most often, only used to compare running headers with each other.
_FOLD = [("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("ri", "n"), ("in", "m")]
_FOLD_CHARS = str.maketrans("e@t!1lo05s69hbgqzI", "caf" + "iii" + "00" + "ss" + "b" + "g" + "bb" + "gg" + "2i")
_LOOKS_DIGIT = {"o": "0", "O": "0", "l": "1", "I": "1", "i": "1", "!": "1", "s": "5", "S": "5", "g": "9", "q": "9", "b": "6", "Z": "2", "z": "2", "B": "8"}


def in_blocks(lines: DataFrame) -> DataFrame:
    """Adds ``block``; lines near a block's border also go to the neighbouring block, as its context."""
    b = F.floor(F.col("line_no") / F.lit(BLOCK))
    pos = F.col("line_no") - b * BLOCK
    to = F.array_compact(F.array(b, F.when((pos < CONTEXT) & (b > 0), b - 1), F.when(pos >= BLOCK - CONTEXT, b + 1)))
    return lines.withColumn("block", F.explode(F.transform(to, lambda x: x.cast("int"))))


def line_blocks(lines: DataFrame) -> DataFrame:
    """(document_id, block, lines array<struct<line_no, page, text>>): the lines of each block and its context in order; repeated rows once."""
    ok = lines.filter(F.col("document_id").isNotNull() & F.col("line_no").isNotNull())
    ok = ok.select("document_id", F.col("line_no").cast("int").alias("line_no"), F.col("page").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return in_blocks(ok).groupBy("document_id", "block").agg(F.sort_array(F.collect_set(F.struct("line_no", "page", "text"))).alias("lines"))


def _block_rows(b: pa.RecordBatch) -> Iterator[tuple[int, int, int, list[int], list, list[str]]]:
    """(row, first and end line number of the block, numbers, pages, texts) of each row of a batch; a line's variants are one: the greatest."""
    col = b.column(2)
    off = col.offsets.to_numpy()
    v = col.values
    no_all, page_all, text_all = v.field(0).to_numpy(), v.field(1).to_pylist(), v.field(2).to_pylist()
    for i, block in enumerate(b.column(1).to_pylist()):
        a, e = int(off[i]), int(off[i + 1])
        no, page, text = no_all[a:e].tolist(), page_all[a:e], text_all[a:e]
        if len(set(no)) < len(no):
            best: dict[int, list] = {}
            for n, p, t in zip(no, page, text):
                x = best.setdefault(n, [p, t])
                x[0] = p if x[0] is None else x[0] if p is None else max(p, x[0])
                x[1] = max(t, x[1])
            no, page, text = list(best), [x[0] for x in best.values()], [x[1] for x in best.values()]
        yield i, block * BLOCK, (block + 1) * BLOCK, no, _fill_pages(page), text


def _roman(s: str) -> int:
    total = 0
    for a, b in zip(s, s[1:] + " "):
        v = _ROMAN[a]
        total += -v if _ROMAN.get(b, 0) > v else v
    return total


def page_number(text: str) -> tuple[int, str] | None:
    """The number of a line that is nothing but a page number, and the form it has."""
    m = _NUMBER_LINE.match(text)
    if not m:
        return None
    s = m.group(1)
    form = _DIGITS.sub("9", _WHITE.sub(" ", text.strip()))
    if s.isdigit():
        return int(s), form
    if s.islower() and set(s) <= set(_ROMAN):
        return _roman(s), "roman"
    return None


def _fold(s: str) -> str:
    s = s.lower()
    for a, b in _FOLD:
        s = s.replace(a, b)
    return _WHITE.sub(" ", s.translate(_FOLD_CHARS))


def _fill_pages(page: list) -> list[int]:
    last = None
    out = []
    for p in page:
        last = p if p is not None else last
        out.append(last)
    nxt = None
    for i in range(len(out) - 1, -1, -1):
        if out[i] is None:
            out[i] = nxt if nxt is not None else 1
        nxt = out[i]
    return out


#: Lines at a page's top and bottom that may be furniture.
EDGE = 2
EDGE_FEATURES = 23
_EDGE_SCHEMA = "document_id string, line_no int, page int, zone int, k1 string, k2 string, form string, number int, features array<float>"
_EDGE_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.float32())]


def _edges(batches):
    """Features of the lines of a block that lie near the top (zone 1) or bottom (2) of a page."""
    for b in batches:
        out: list[tuple] = []
        docs = b.column(0).to_pylist()
        for row, lo, hi, no, page, text in _block_rows(b):
            full = [i for i, x in enumerate(text) if x and not x.isspace()]
            if not full:
                continue
            width = max(20.0, float(np.percentile([len(text[i]) for i in full], 80)))
            pages = np.array([page[i] for i in full])
            turn = np.flatnonzero(np.r_[True, pages[1:] != pages[:-1]])
            size = np.diff(np.r_[turn, len(full)])
            top = np.arange(len(full)) - np.repeat(turn, size)
            bottom = np.repeat(size, size) - 1 - top
            for j in np.flatnonzero((top < EDGE) | (bottom < EDGE)).tolist():
                i = full[j]
                if not lo <= no[i] < hi:
                    continue
                t = text[i]
                s = t.strip()
                zone = 1 if top[j] < EDGE else 2
                side = _SIDE_NUMBER.search(t)
                core = (_SIDE_NUMBER.sub("", t).strip() or s) if side else s
                pn = page_number(t)
                number, form = pn if pn else (None, None)
                if not pn and side and (side.group(1) or side.group(2)).isdigit():
                    number, form = int(side.group(1) or side.group(2)), "side"
                letters = sum(map(str.isalpha, s))
                k1 = f"{zone}:{_fold(core)}" if not pn or letters >= 3 and form != "roman" else None
                k2 = f"{zone}:{_DIGITS.sub('9', _WHITE.sub(' ', core))}" if not pn else None
                after = text[full[j + 1]].strip() if j + 1 < len(full) else ""
                before = text[full[j - 1]].strip() if j else ""
                feats = [
                    int(top[j]) if zone == 1 else 9, int(bottom[j]) if zone == 2 else 9, float(pn is not None), float(form == "side"),
                    float(bool(_TERMINAL.search(s))), float(s[0].islower()), float(after[:1].islower()), float(bool(_TERMINAL.search(before))),
                    len(s) / width, float(len(t) - len(t.lstrip()) > 2), float(i + 1 >= len(no) or not text[i + 1].strip()), float(i == 0 or not text[i - 1].strip()),
                    float("·" in s), sum(map(str.isdigit, s)) / len(s), sum(map(str.isupper, s)) / max(1, letters), float(page[i] == 1), float(form == "9"),
                ]
                out.append((docs[row], no[i], page[i], zone, k1, k2, form, number, feats))
        cols = list(zip(*out)) or [[]] * len(_EDGE_TYPES)
        yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, _EDGE_TYPES)], names=[x.split()[0] for x in _EDGE_SCHEMA.split(", ")])


def furniture_lines(blocks: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """(document_id, line_no) of the lines that are page furniture.

    Lines that recur on several pages of their document, or count its pages, are examples for the classifier; it decides on all.
    """
    e = cut(blocks.mapInArrow(_edges, _EDGE_SCHEMA))
    off = F.col("number") - F.col("page")
    named = (("1", F.col("k1")), ("2", F.col("k2")), ("s", F.concat_ws(":", F.col("zone").cast("string"), "form", off.cast("string"))))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in named])
    keys = e.withColumn("x", F.explode(kinds)).select("document_id", "line_no", "page", "number", "x.kind", "x.key").filter(F.col("key").isNotNull() & ((F.col("kind") != "s") | F.col("number").isNotNull()))
    counts = keys.groupBy("document_id", "kind", "key").agg(F.countDistinct("page").cast("int").alias("n")).toDF("_d", "_k", "_y", "n")
    got = keys.join(counts, (F.col("document_id") == F.col("_d")) & (F.col("kind") == F.col("_k")) & (F.col("key") == F.col("_y")))
    per = got.groupBy(F.col("document_id").alias("_d"), F.col("line_no").alias("_l")).agg(*[F.max(F.when(F.col("kind") == k, F.col("n"))).alias(f"n{k}") for k in "12s"])
    x = e.join(per, (F.col("document_id") == F.col("_d")) & (F.col("line_no") == F.col("_l")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    bare, fits = F.col("k2").isNull(), F.coalesce(off == 0, F.lit(False))
    rest = (F.get("features", F.lit(4)) > 0) & (F.get("features", F.lit(5)) > 0)  # the end of a sentence that ran over the page
    sure = F.when(bare, (zero("ns") >= 2) | ((zero("ns") >= 1) & fits) | (zero("n1") >= 2)).otherwise((F.greatest(zero("n1"), zero("n2")) >= 2) & ~rest)
    more = F.array(*[F.log1p(zero(c)).cast("float") for c in ("n1", "n2", "ns")], fits.cast("float"), bare.cast("float"), rest.cast("float"))
    x = cut(x.select("document_id", "line_no", F.concat("features", more).alias("features"), sure.alias("sure")))
    share = min(1.0, sample_rows / max(1, x.count()))
    got = x.filter(F.pmod(F.xxhash64("document_id", "line_no"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))).limit(2 * sample_rows).select("features", "sure").collect()
    model = Boosted(rounds=80, depth=4).fit(np.array([r["features"] for r in got], np.float64).reshape(-1, EDGE_FEATURES), np.array([r["sure"] for r in got], np.float64))
    sent = blocks.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for b in batches:
            f = b.column(2).values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, EDGE_FEATURES)
            yes = pa.array(sent.value.score(f) > 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(yes), b.column(1).filter(yes)], names=["document_id", "line_no"])

    return x.mapInArrow(judge, "document_id string, line_no int")


_BROKEN_WORD = "struct<line_no:int,token:string,right:string,line_no2:int,hyphen:string>"
_TOKEN_SCHEMA = f"document_id string, block int, line_no array<int>, token array<string>, compound array<string>, broken array<{_BROKEN_WORD}>"
_TOKEN_TYPES = [pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.struct([("line_no", pa.int32()), ("token", pa.string()), ("right", pa.string()), ("line_no2", pa.int32()), ("hyphen", pa.string())]))]


def _tokens(batches):
    """The tokens of a block's body lines; a word broken at a line's end is one entry with both parts."""
    for b in batches:
        out: list[tuple] = []
        docs, furniture, numbers = b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(1).to_pylist()
        for row, lo, hi, no, _page, text in _block_rows(b):
            furn = set(furniture[row] or ())
            body = [i for i in range(len(no)) if text[i] and no[i] not in furn and not text[i].isspace()]
            lines, tokens, compounds, broken = [], [], [], []
            taken: dict[int, int] = {}  # line -> length of the part that belongs to the line before
            for a, i in enumerate(body):
                s = text[i].rstrip()
                core = lo <= no[i] < hi
                skip = taken.get(i, 0)
                if s[-1] in HYPHENS and a + 1 < len(body) and (m := _BROKEN.search(s)):
                    j = body[a + 1]
                    nx = text[j]
                    lead = len(nx) - len(nx.lstrip())
                    r = _FIRST.match(nx.lstrip())
                    if r and m.start() >= skip:
                        taken[j] = lead + r.end()
                        if core:
                            broken.append({"line_no": no[i], "token": m.group(1), "right": r.group(), "line_no2": no[j], "hyphen": s[-1]})
                        s = s[: m.start()]
                if core:
                    found = (_TOKEN_ASCII if s.isascii() else _TOKEN).findall(s, skip)
                    tokens += found
                    lines += [no[i]] * len(found)
                    if "-" in s or "‐" in s:
                        compounds += _WORDS_HYPHEN.findall(s, skip)
            out.append((docs[row], numbers[row], lines, tokens, compounds, broken))
        cols = list(zip(*out)) or [[]] * len(_TOKEN_TYPES)
        yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, _TOKEN_TYPES)], names=["document_id", "block", "line_no", "token", "compound", "broken"])


JOIN_FEATURES = 7


def _join_features(joined: int, compound: int, left: int, right: int, soft: bool, token: str, after: str) -> list[float]:
    return [math.log1p(joined), math.log1p(compound), math.log1p(min(left, right)), math.log1p(joined) - math.log1p(compound), float(soft), float(not after[:1].isupper() or token.isupper()), float(joined == 0 and compound == 0)]


def judge_breaks(broken: DataFrame, words: DataFrame, compounds: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """(token, right, hyphen, joins): for each pair of parts whether the line's end broke a word (else it is a compound).

    The classifier is fitted on words and compounds of the corpus that are cut here at every place, and at their hyphen; an example counts
    all occurrences but itself, so that it also learns what pairs are that nobody has seen whole.
    """
    spark = broken.sparkSession
    pairs = broken.select("token", "right", "hyphen").distinct()
    low = pairs.withColumn("l", F.lower("token")).withColumn("r", F.lower("right"))
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("word")) for k, c in (("joined", F.concat("l", "r")), ("left_n", F.col("l")), ("right_n", F.col("r")), ("compound", F.concat_ws("-", "l", "r")))])
    asked = low.withColumn("x", F.explode(keys)).select("token", "right", "hyphen", "x.kind", "x.word")
    both = words.select("word", "n", F.lit(False).alias("c")).unionByName(compounds.select("word", "n", F.lit(True).alias("c")))
    hit = asked.join(both, "word", "left").withColumn("n", F.when((F.col("kind") == "compound") == F.col("c"), F.col("n")))
    low = hit.groupBy("token", "right", "hyphen").agg(*[F.max(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in ("joined", "left_n", "right_n", "compound")])

    def sample(d: DataFrame) -> dict[str, int]:
        share = min(1.0, sample_rows / max(1, d.count()))
        return {r["word"]: int(r["n"]) for r in d.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))).limit(2 * sample_rows).collect()}

    cuts = [(w[:i], w[i:], n) for w, n in sorted(sample(words.filter("length(word) >= 4")).items()) if w.isalpha() for i in range(2, len(w) - 1, 2)]
    halves = [(*w.replace("‐", "-").partition("-")[::2], n) for w, n in sorted(sample(compounds).items())]
    halves = [(l, r, n) for l, r, n in halves if r and l.isalpha() and r.isalpha()]
    # full counts of the parts of the sampled words
    asked_words = sorted({x for l, r, _ in cuts for x in (l, r)} | {x for l, r, _ in halves for x in (l, r, l + r)} | {f"{l}-{r}" for l, r, _ in cuts})
    ask = spark.createDataFrame(pa.table({"word": pa.array(asked_words, pa.string())}))  # bounded by the samples
    full = {(r["word"], r["c"]): int(r["n"]) for r in both.join(ask, "word").collect()}
    x, y = [], []
    for l, r, n in cuts:
        for soft in (False, True):
            x.append(_join_features(n - 1, full.get((f"{l}-{r}", True), 0), full.get((l, False), 0), full.get((r, False), 0), soft, l, r))
            y.append(1)
    for l, r, n in halves:
        for k in range(4):
            x.append(_join_features(full.get((l + r, False), 0), n - 1, full.get((l, False), 0), full.get((r, False), 0), False, l, r.title() if k % 2 else r))
            y.append(0)
    model = Boosted(rounds=40).fit(np.array(x, np.float64).reshape(-1, JOIN_FEATURES), np.array(y, np.float64))
    sent = spark.sparkContext.broadcast(model)

    def judge(batches):
        for b in batches:
            tok, right, hy, joined, left_n, right_n, comp = (c.to_pylist() for c in b.columns)
            f = [_join_features(j or 0, c or 0, a or 0, z or 0, h in "¬\xad", t, r) for t, r, h, j, a, z, c in zip(tok, right, hy, joined, left_n, right_n, comp)]
            yes = sent.value.score(np.array(f, np.float64).reshape(-1, JOIN_FEATURES)) > 0.5
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(yes, pa.bool_())], names=["token", "right", "hyphen", "joins"])

    return low.select("token", "right", "hyphen", "joined", "left_n", "right_n", "compound").mapInArrow(judge, "token string, right string, hyphen string, joins boolean")


def align(c: str, w: str, most: int = 2) -> list[tuple[str, str, int]] | None:
    """The replacements (part of c, part of w, place in w) that turn c into w: 1 to 1, 1 to 2 or 2 to 1 characters, at most ``most``."""
    i = 0
    m = min(len(c), len(w))
    while i < m and c[i] == w[i]:
        i += 1
    j = 0
    while j < m - i and c[-1 - j] == w[-1 - j]:
        j += 1
    a, b = c[i : len(c) - j], w[i : len(w) - j]
    if not a and not b:
        return []
    if 1 <= len(a) <= 2 and 1 <= len(b) <= 2 and len(a) + len(b) < 4:
        return [(a, b, i)]
    if not a or not b:  # "m" read as "rn" beside an equal letter: widen by one
        if i > 0 and len(a) + len(b) == 1:
            return [(c[i - 1 : len(c) - j], w[i - 1 : len(w) - j], i - 1)]
        return None
    if most < 2 or abs(len(a) - len(b)) > 2:
        return None
    # the first difference is at i and the last before the equal end: two replacements with an equal stretch between
    for la in (1, 2):
        for lb in (1, 2):
            if la + lb == 4:
                continue
            for ra in (1, 2):
                for rb in (1, 2):
                    if ra + rb == 4 or la + ra > len(a) or lb + rb > len(b):
                        continue
                    if a[la : len(a) - ra] == b[lb : len(b) - rb]:
                        return [(a[:la], b[:lb], i), (a[len(a) - ra :], b[len(b) - rb :], i + len(b) - rb)]
    return None


RANK_FEATURES = 8
# Pairs that look so much alike that a few words of support count as more; correct first, then as read.
LOOK_ALIKE_PAIRS = "e:c t:f h:b d:cl u:ii m:rn rn:m in:m ri:n w:vv vv:w cl:d n:ri"
LOOK_ALIKE_BONUS = 5
#: Words of at least two characters with a letter; those of digits and letters go by their masks.
_WORDY = r"\p{L}|@"


def candidates(types: DataFrame, least_count: int, least_ratio: float) -> DataFrame:
    """(w, c, nw, nc): words and the much commoner ones they share q-grams with (trigrams, for short words bigrams)."""
    t = types.filter((F.length("word") >= 2) & F.col("word").rlike(_WORDY))
    lex = t.filter((F.col("n") >= least_count) & F.col("word").rlike(r"^[\p{L}\p{M}]+$"))

    def grams(d: DataFrame, q: int, short: Column) -> DataFrame:
        p = F.concat(F.lit("#"), F.col("word"), F.lit("#"))
        g = F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - q + 1, F.lit(1))), lambda i: F.substring(p, i, q))
        return d.filter(short).select("word", "n", F.length("word").alias("len"), F.explode(F.array_distinct(g)).alias("g"))

    size = F.length("word")
    shared = []
    for q, of_query, of_lex in ((3, size >= 5, size >= 3), (2, size < 5, size <= 6)):
        a = grams(t, q, of_query).toDF("w", "nw", "lw", "g").withColumn("lc", F.explode(F.sequence(F.col("lw") - 2, F.col("lw") + 2)))
        b = grams(lex, q, of_lex).toDF("c", "nc", "lc", "g")
        near = a.join(b, ["g", "lc"]).filter(F.col("nc") >= least_ratio * F.col("nw"))  # of lengths that two replacements can reach
        shared.append(near.groupBy("w", "c", "nw", "nc").agg(F.count("*").alias("k")))
    both = shared[0].unionByName(shared[1]).filter(F.col("k") >= F.greatest(F.lit(1), F.floor((F.length("w") - 5) / 2)))
    return both.filter(F.levenshtein("w", "c", 4) >= 0).select("w", "c", "nw", "nc")


def repaired_masks(types: DataFrame) -> DataFrame:
    """(w, c, nw, nc, a1, b1, p1, fixed): tokens of digits with one letter that looks like a digit, by their masks, which write 9 for a digit and keep letters.

    ``w`` is the token; counts are those of the masks, so numbers of one form support each other.
    """
    schema = "token string, n bigint, mask string, fixed string, fixed_mask string, place int"

    def variants(batches):
        for b in batches:
            out = []
            for tok, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                d = [i for i, c in enumerate(tok) if not c.isdigit()]
                mask = _DIGITS.sub(lambda m: "9" * len(m.group()), tok)
                if len(d) == 1 and len(tok) > 1 and tok[d[0]] in _LOOKS_DIGIT:
                    i = d[0]
                    out.append((tok, n, mask, tok[:i] + _LOOKS_DIGIT[tok[i]] + tok[i + 1 :], mask[:i] + "9" + mask[i + 1 :], i))
                else:
                    out.append((tok, n, mask, None, None, None))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()])], names=[x.split()[0] for x in schema.split(", ")])

    v = types.filter(F.col("token").rlike(r"\d")).select("token", "n").mapInArrow(variants, schema)
    masks = v.groupBy("mask").agg(F.sum("n").alias("m"))
    x = v.filter(F.col("fixed").isNotNull()).join(masks.withColumnRenamed("m", "own"), "mask").join(masks.select(F.col("mask").alias("fixed_mask"), F.col("m").alias("other")), "fixed_mask", "left")
    read = F.substring("token", F.col("place") + 1, F.lit(1))
    return x.select(F.col("token").alias("w"), F.col("fixed").alias("c"), F.col("own").alias("nw"), F.coalesce("other", F.lit(0)).alias("nc"), F.substring("fixed", F.col("place") + 1, F.lit(1)).alias("a1"), read.alias("b1"), F.col("place").alias("p1"))


def repaired_symbols(types: DataFrame) -> DataFrame:
    """(token, c, nw, nc, a1, b1, p1, stem): words in which one symbol or digit stands among letters, and the word with the letter that it looks like.

    ``stem``: at a word's end or start a digit may also count a word of the corpus, as it does in "model5".
    """
    t = types.filter(F.col("token").rlike(r"^[\p{L}@!0-9]+$") & F.col("token").rlike(r"[@!01569]") & (F.col("token").rlike(r"\p{L}") | (F.col("token") == "@")))
    sym = F.regexp_replace("token", r"[^@!0-9]", "")
    letters = F.length(F.regexp_replace("token", r"[@!0-9]", ""))
    place = F.length(F.regexp_extract("token", r"^(\p{L}*)[@!01569]", 1))
    one = t.filter((F.length(sym) == 1) & ((F.col("token") == "@") | (sym.isin("@", "!") & (letters >= 2)) | (letters >= 4))).select(F.col("token"), F.col("n").alias("nw"), sym.alias("b1"), place.cast("int").alias("p1"))
    digit = ~F.col("b1").isin("@", "!")
    rest = F.when(digit & (F.col("p1") == F.length("token") - 1), F.lower(F.expr("left(token, length(token) - 1)"))).when(digit & (F.col("p1") == 0), F.lower(F.expr("substring(token, 2)")))
    known = types.groupBy(F.lower("token").alias("_w")).agg(F.sum("n").alias("_n"))
    x = one.withColumn("c", F.translate("token", "@!01569", "aiolsbg")).withColumn("rest", rest)
    x = x.join(known.select(F.col("_w").alias("rest"), F.lit(True).alias("stem")), "rest", "left").join(known.select(F.col("_w").alias("_c"), F.col("_n").alias("nc")), F.lower("c") == F.col("_c"), "left")
    return x.select(F.col("token").alias("w"), "c", "nw", F.coalesce("nc", F.lit(0)).alias("nc"), F.translate("b1", "@!01569", "aiolsbg").alias("a1"), "b1", "p1", F.coalesce("stem", F.lit(False)).alias("stem"))


def corrections_of(types: DataFrame, least_count: int = 5, least_ratio: float = 10.0, sample_rows: int = 20_000) -> DataFrame:
    """(token, correction, places): the tokens that are misread, what they should read, and where in the correction that differs.

    ``types``: (token, n). Words are looked up in lower case among words at least ``least_ratio`` times as common; tokens with symbols and
    digits get a candidate of their own besides. Every candidate shows replacements, how many words of the corpus show
    the same ones is counted, and the ranking fitted on sure cases decides for the best candidate of each token.
    """
    low = types.groupBy(F.lower("token").alias("word")).agg(F.sum("n").alias("n"))
    schema = "w string, c string, nw bigint, nc bigint, a1 string, b1 string, a2 string, b2 string, p1 int, p2 int"

    def aligned(batches):
        for b in batches:
            out = []
            for w, c, nw, nc in zip(*(x.to_pylist() for x in b.columns)):
                e = align(c, w)
                if e:
                    second = e[1] if len(e) > 1 else (None, None, None)
                    out.append((w, c, nw, nc, e[0][0], e[0][1], second[0], second[1], e[0][2], second[2]))
            cols = list(zip(*out)) or [[]] * 10
            types_ = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(cols, types_)], names=[x.split()[0] for x in schema.split(", ")])

    none = F.lit(None).cast("string")
    al = candidates(low, least_count, least_ratio).mapInArrow(aligned, schema)
    words = al.select("*", F.lit("word").alias("kind"), F.lit(False).alias("stem"))
    symbols = repaired_symbols(types).select("w", "c", "nw", "nc", "a1", "b1", none.alias("a2"), none.alias("b2"), "p1", F.lit(None).cast("int").alias("p2"), F.lit("symbol").alias("kind"), "stem")
    numbers = repaired_masks(types).select("w", "c", "nw", "nc", "a1", "b1", none.alias("a2"), none.alias("b2"), "p1", F.lit(None).cast("int").alias("p2"), F.lit("number").alias("kind"), F.lit(False).alias("stem"))
    al = cut(words.unionByName(symbols).unionByName(numbers))
    # how many words show this replacement alone, against a much commoner word; letters read as digits by numbers of a much commoner form
    shown = al.filter(F.col("a2").isNull() & ((F.col("kind") == "word") | ((F.col("kind") == "number") & (F.col("nc") >= least_ratio * F.col("nw")))))
    conf = shown.groupBy("a1", "b1").agg(F.countDistinct("w").alias("s"))
    known = F.array(*[F.lit(p) for p in LOOK_ALIKE_PAIRS.split()])
    bonus = F.when(F.array_contains(known, F.concat_ws(":", "a1", "b1")), LOOK_ALIKE_BONUS).otherwise(0)
    back = conf.select(F.col("b1").alias("_a"), F.col("a1").alias("_b"), F.col("s").alias("_r"))
    conf = conf.withColumn("s", F.col("s") + bonus).join(back, (F.col("a1") == F.col("_a")) & (F.col("b1") == F.col("_b")), "left")
    conf = cut(conf.select("a1", "b1", "s", F.when(F.array_contains(known, F.concat_ws(":", "a1", "b1")), 0).otherwise(F.coalesce("_r", F.lit(0))).alias("r")))
    x = al
    for k in ("1", "2"):
        x = x.join(conf.toDF(f"_a{k}", f"_b{k}", f"s{k}", f"r{k}"), (F.col(f"a{k}") == F.col(f"_a{k}")) & (F.col(f"b{k}") == F.col(f"_b{k}")), "left").drop(f"_a{k}", f"_b{k}")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    least_s = F.when(F.col("a2").isNull(), zero("s1")).otherwise(F.least(zero("s1"), zero("s2")))
    most_r = F.when(F.col("a2").isNull(), zero("r1")).otherwise(F.greatest(zero("r1"), zero("r2")))
    odd = F.col("w").rlike(r"[@!\d]") & (F.col("w").rlike(r"\p{L}") | (F.col("w") == "@"))
    ratio = F.log((F.col("nc") + 0.5) / F.col("nw"))
    f = F.array(F.log1p("nc"), ratio, F.col("a2").isNotNull().cast("int"), F.log1p(least_s), F.log1p(least_s) - F.log1p(most_r), F.length("w"), F.length("c") - F.length("w"), F.col("stem").cast("int") + 2 * (F.col("kind") == "number").cast("int"))
    x = x.withColumn("s", least_s).withColumn("odd", odd).withColumn("f", F.transform(f, lambda v: v.cast("float")))
    # sure cases: a symbol or digit inside a word is never right, a number is where its form is common; a replacement that hardly any word shows is none
    number = F.col("kind") == "number"
    y = F.when(number & (F.col("nc") >= least_ratio * F.col("nw")), 1.0).when(number & (F.col("nc") < F.col("nw")), 0.0).when(F.col("stem"), 0.0)
    y = y.when(~number & F.col("odd") & ((F.col("s") >= 8) | (F.col("kind") == "symbol")), 1.0).when(~F.col("odd") & (F.col("s") <= 3), 0.0)
    x = cut(x.select("w", "c", "kind", "p1", "p2", "f", y.alias("y")))
    lab = x.filter(F.col("y").isNotNull())
    share = min(1.0, sample_rows / max(1, lab.count()))
    got = lab.filter(F.pmod(F.xxhash64("w", "c"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))).limit(2 * sample_rows).select("f", "y").collect()
    model = Boosted(rounds=60).fit(np.array([r["f"] for r in got], np.float64).reshape(-1, RANK_FEATURES), np.array([r["y"] for r in got], np.float64))
    sent = types.sparkSession.sparkContext.broadcast(model)

    def rank(batches):
        for b in batches:
            p = sent.value.score(b.column(2).values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, RANK_FEATURES))
            yes = pa.array(p > 0.5)
            yield pa.RecordBatch.from_arrays([*(b.column(i).filter(yes) for i in (0, 1, 3, 4, 5)), pa.array(p[p > 0.5])], names=["w", "c", "p1", "p2", "kind", "score"])

    ranked = x.select("w", "c", "f", "p1", "p2", "kind").mapInArrow(rank, "w string, c string, p1 int, p2 int, kind string, score double")
    ranked = ranked.withColumn("own", F.col("kind") != "word")
    best = ranked.groupBy("w", "own").agg(F.max_by(F.struct("c", "p1", "p2"), F.struct("score", "c")).alias("b"))
    found = best.select("w", "own", F.col("b.c").alias("correction"), F.array_compact(F.array("b.p1", "b.p2")).alias("places"))
    # words were looked up in lower case, the others as they stand; a commoner word goes before a repaired symbol
    by_word = types.select("token", F.lower("token").alias("w")).join(found.filter("not own").drop("own"), "w").select("token", "correction", "places", F.lit(1).alias("rank"))
    by_token = found.filter("own").select(F.col("w").alias("token"), "correction", "places", F.lit(0).alias("rank"))
    both = by_word.unionByName(by_token).groupBy("token").agg(F.max_by(F.struct("correction", "places"), F.struct("rank", "correction")).alias("b"))
    return both.select("token", "b.correction", "b.places")


def scan_findings(lines: DataFrame) -> dict[str, DataFrame]:
    """blocks (lines of each block), tokens (of each block), furniture, broken (parts of words and whether they join), corrections (by token)."""
    blocks = cut(line_blocks(lines))
    furniture = cut(furniture_lines(blocks))
    near = in_blocks(furniture).groupBy("document_id", "block").agg(F.sort_array(F.collect_set("line_no")).alias("furniture"))  # no more than a block's lines
    tokens = cut(blocks.join(near, ["document_id", "block"], "left").mapInArrow(_tokens, _TOKEN_SCHEMA))
    whole = cut(tokens.select(F.explode("token").alias("token")).groupBy("token").agg(F.count("*").alias("n")))
    words = whole.groupBy(F.lower("token").alias("word")).agg(F.sum("n").alias("n"))
    compounds = tokens.select(F.explode("compound").alias("token")).groupBy(F.regexp_replace(F.lower("token"), "‐", "-").alias("word")).agg(F.count("*").alias("n"))
    split = tokens.select("document_id", "block", F.explode("broken").alias("x")).select("document_id", "block", "x.*")
    broken = cut(split.join(judge_breaks(split, words, compounds), ["token", "right", "hyphen"]))
    uses = broken_uses(broken)
    types = cut(whole.unionByName(uses.groupBy("token").agg(F.count("*").alias("n"))).groupBy("token").agg(F.sum("n").alias("n")))
    return {"blocks": blocks, "tokens": tokens, "furniture": furniture, "broken": broken, "corrections": cut(corrections_of(types))}


def broken_uses(broken: DataFrame) -> DataFrame:
    """(document_id, line_no, token, line_no2, cut_at) of the words at lines' ends: joined ones as one word, compounds as two."""
    no = F.lit(None).cast("int")
    parts = F.when(F.col("joins"), F.array(F.struct(F.col("line_no"), F.concat("token", "right").alias("token"), "line_no2", F.length("token").alias("cut_at")))).otherwise(
        F.array(F.struct("line_no", "token", no.alias("line_no2"), F.lit(0).alias("cut_at")), F.struct(F.col("line_no2").alias("line_no"), F.col("right").alias("token"), no.alias("line_no2"), F.lit(0).alias("cut_at")))
    )
    return broken.select("document_id", F.explode(parts).alias("x")).select("document_id", "x.*")


def misread_uses(found: dict[str, DataFrame]) -> DataFrame:
    """(document_id, line_no, token, line_no2, cut_at, correction, places) of every misread word."""
    pair = F.explode(F.arrays_zip("line_no", "token"))
    whole = found["tokens"].select("document_id", pair.alias("x")).select("document_id", "x.line_no", "x.token", F.lit(None).cast("int").alias("line_no2"), F.lit(0).alias("cut_at"))
    return whole.unionByName(broken_uses(found["broken"])).join(found["corrections"], "token")


def line_kinds(found: dict[str, DataFrame]) -> DataFrame:
    """(document_id, line_no, kind) of every line that is furniture, ends in a broken word or holds misread characters."""
    furniture = found["furniture"].select("document_id", "line_no", F.lit("furniture").alias("kind"))
    hyphen = found["broken"].filter("joins").select("document_id", "line_no", F.lit("hyphen").alias("kind"))
    hit = misread_uses(found).withColumn("place", F.explode("places"))
    at = F.when(F.col("line_no2").isNotNull() & (F.col("place") >= F.col("cut_at")), F.col("line_no2")).otherwise(F.col("line_no"))
    misread = hit.select("document_id", at.alias("line_no"), F.lit("misread").alias("kind"))
    return furniture.unionByName(hyphen).unionByName(misread).distinct()


def block_lines(found: dict[str, DataFrame]) -> DataFrame:
    """(document_id, line_no, page, text, furniture) of every line, each once."""

    def own(batches):
        for b in batches:
            out: list[tuple] = []
            docs, furniture = b.column(0).to_pylist(), b.column(3).to_pylist()
            for row, lo, hi, no, page, text in _block_rows(b):
                furn = set(furniture[row] or ())
                out += [(docs[row], n, p, t, n in furn) for n, p, t in zip(no, page, text) if lo <= n < hi]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_()])], names=["document_id", "line_no", "page", "text", "furniture"])

    near = in_blocks(found["furniture"]).groupBy("document_id", "block").agg(F.collect_set("line_no").alias("furniture"))
    return found["blocks"].join(near, ["document_id", "block"], "left").mapInArrow(own, "document_id string, line_no int, page int, text string, furniture boolean")


def _match_case(token: str, correction: str) -> str:
    if token[:1].isupper() and token[1:].upper() == token[1:] and len(token) > 1 and any(c.isalpha() for c in token[1:]):
        return correction.upper()
    return correction[:1].upper() + correction[1:] if token[:1].isupper() else correction


def _body_lines(t: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripped texts, whether they end a sentence, and the line's kind: 0 body, 1 blank, 2 furniture."""
    for b in t:
        doc, no, page, text, furn = b.columns
        s = [x.strip() for x in text.to_pylist()]
        kind = [2 if f else 0 if x else 1 for x, f in zip(s, furn.to_pylist())]
        done = [bool(_TERMINAL.search(x)) for x in s]
        yield pa.RecordBatch.from_arrays([doc, no, page, pa.array(s, pa.string()), pa.array(kind, pa.int32()), pa.array(done, pa.bool_())], names=["document_id", "line_no", "page", "text", "kind", "done"])


def paragraph_starts(lines: DataFrame) -> DataFrame:
    """(document_id, block, line_no, text, paragraph) of the body lines; a paragraph is named by its first line.

    A line starts a paragraph by what lies between it and the body line before, however far back that is: windows run inside
    blocks, and the small table of block totals hands each block what came before it.
    """
    x = lines.select("document_id", "line_no", "page", "text", "furniture").mapInArrow(_body_lines, "document_id string, line_no int, page int, text string, kind int, done boolean")
    x = cut(x.withColumn("block", F.floor(F.col("line_no") / F.lit(BLOCK)).cast("int")))
    body, blank, furn = (F.when(F.col("kind") == k, v) for k, v in ((0, F.struct("line_no", "page", "done")), (1, F.col("line_no")), (2, F.col("line_no"))))
    past = Window.partitionBy("document_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("document_id", "block").orderBy("line_no")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy("document_id", "block").agg(F.max(body).alias("b"), F.max(blank).alias("e"), F.max(furn).alias("f"))
    carry = totals.select("document_id", "block", *[F.max(c).over(past).alias(f"_{c}") for c in "bef"])
    x = x.withColumn("b", F.max(body).over(before)).withColumn("e", F.max(blank).over(before)).withColumn("f", F.max(furn).over(before)).filter("kind = 0")
    x = x.join(carry, ["document_id", "block"]).withColumn("b", F.coalesce("b", "_b"))
    after = lambda c: F.coalesce(F.greatest(c, f"_{c}") > F.col("b.line_no"), F.lit(False))
    crossing = after("f") | (F.col("page") != F.col("b.page"))
    starts = F.col("b").isNull() | (after("e") & (~crossing | F.col("b.done")))
    x = x.withColumn("start", F.when(starts, F.col("line_no")))
    x = cut(x.select("document_id", "block", "line_no", "text", F.max("start").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("start")))
    last = x.groupBy("document_id", "block").agg(F.max("start").alias("s")).select("document_id", "block", F.max("s").over(past).alias("_s"))
    return x.join(last, ["document_id", "block"]).select("document_id", "block", "line_no", "text", F.coalesce("start", "_s").alias("paragraph"))


def _repair(s: str, fixes: list[tuple[str, str]]) -> str:
    for a, c in dict.fromkeys(fixes):
        s = regex.sub(rf"(?<![\p{{L}}\p{{N}}]){regex.escape(a)}(?![\p{{L}}\p{{N}}])", _match_case(a, c).replace("\\", ""), s)
    return s


_FIXES = "array<struct<token:string,correction:string>>"
_PART_SCHEMA = f"document_id string, paragraph int, block int, last_line int, head string, text string, tail string, joins boolean, head_fixes {_FIXES}, tail_fixes {_FIXES}"


def _parts(t: pa.Table) -> pa.Table:
    """The parts of paragraphs that lie in a block, repaired; the words at their ends stay as they are, for the block's border may cut them."""
    t = t.take(pa.array(np.argsort(t.column("line_no").to_numpy(), kind="stable")))
    out: list[tuple] = []
    rows = t.to_pylist()
    for start, group in itertools.groupby(rows, lambda r: r["paragraph"]):
        g = list(group)
        fixes = [[(f["token"], f["correction"]) for f in r["fixes"] or []] for r in g]
        buf, join = "", None
        for r in g:
            buf = r["text"] if not buf else (buf[:-1] if join else buf) + r["text"] if join is not None else f"{buf} {r['text']}"
            join = r["joins"]
        head, tail = "", ""
        if start < g[0]["line_no"]:  # goes on from the block before
            head = regex.match(r"\S*", buf).group()
            buf = buf[len(head) :]
        if join is not None and g[-1] is rows[-1]:  # may go on in the next block
            tail = regex.search(r"\S*$", buf).group()
            buf = buf[: len(buf) - len(tail)]
        fix = lambda x: [{"token": a, "correction": c} for a, c in x]
        out.append((g[0]["document_id"], start, g[0]["block"], g[-1]["line_no"], head, _repair(buf, [f for x in fixes for f in x]), tail, join, fix(fixes[0]), fix(fixes[-1])))
    cols = list(zip(*out)) or [[]] * 10
    pairs = pa.list_(pa.struct([("token", pa.string()), ("correction", pa.string())]))
    types = [pa.string(), *[pa.int32()] * 3, *[pa.string()] * 3, pa.bool_(), pairs, pairs]
    return pa.table({x: pa.array(c, ty) for x, c, ty in zip(("document_id", "paragraph", "block", "last_line", "head", "text", "tail", "joins", "head_fixes", "tail_fixes"), cols, types)})


def _whole(parts: list[dict]) -> str:
    """The text of a paragraph from its parts in the order of blocks; words at borders are joined and repaired here."""
    out: list[str] = []
    word, fixes, join = "", [], None
    for k, p in enumerate(parts):
        of = lambda c: [(f["token"], f["correction"]) for f in p[c]]  # noqa: E731, B023
        if k and join is None:
            out += [_repair(word, fixes), " "]
            word, fixes = "", []
        elif k and join:
            word = word[:-1]
        word, fixes, join = word + p["head"], fixes + of("head_fixes"), p["joins"]
        if p["text"] or p["tail"]:
            out += [_repair(word, fixes), p["text"]]
            word, fixes = p["tail"], []
        fixes = fixes + of("tail_fixes")
    return unicodedata.normalize("NFC", "".join([*out, _repair(word, fixes)]))


def paragraphs(found: dict[str, DataFrame]) -> DataFrame:
    """(document_id, paragraph, first_line, last_line, text): the repaired text of each document, in paragraphs.

    A paragraph is named by its first line. Blank lines around furniture and a page's end only end a paragraph where the text
    before is finished. Paragraphs are numbered over all lines first; the parts that lie in a block are repaired with that block's
    lines, breaks and corrections only, and put together by paragraph, over any number of blocks.
    """
    b = found["broken"].groupBy("document_id", "line_no").agg(F.max("joins").alias("joins"))
    corr = misread_uses(found).select("document_id", "line_no", "token", "correction")
    fixes = corr.groupBy("document_id", "line_no").agg(F.sort_array(F.collect_set(F.struct("token", "correction"))).alias("fixes"))
    x = paragraph_starts(block_lines(found)).join(b, ["document_id", "line_no"], "left").join(fixes, ["document_id", "line_no"], "left")
    parts = x.groupBy("document_id", "block").applyInArrow(_parts, _PART_SCHEMA)
    part = F.struct("block", "head", "text", "tail", "joins", "head_fixes", "tail_fixes")
    p = parts.groupBy("document_id", "paragraph").agg(F.max("last_line").alias("last_line"), F.sort_array(F.collect_list(part)).alias("parts"))

    def build(batches):
        for t in batches:
            doc, start, last, of = t.columns
            yield pa.RecordBatch.from_arrays([doc, start, start, last, pa.array([_whole(x) for x in of.to_pylist()], pa.string())], names=["document_id", "paragraph", "first_line", "last_line", "text"])

    return p.mapInArrow(build, "document_id string, paragraph int, first_line int, last_line int, text string")


def p6_found(spark, d):
    return line_kinds(scan_findings(table(spark, d, "extracted_lines")))


def p6_paragraphs(spark, d):
    return paragraphs(scan_findings(table(spark, d, "extracted_lines")))

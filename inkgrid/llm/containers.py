"""Filling fixed-capacity containers (problem 8).

The plan is made from the histogram of lengths, which has at most ``capacity`` rows whatever the size of the corpus: all
patterns of up to three items (in bins of lengths) that fill a container are enumerated, their repeat counts fitted to the
histogram by non-negative least squares, and rounded down. What remains is packed best-fit-decreasing on counts, into what the
patterns leave free and into new containers. Items then only need their rank within their length to find their container.

Defined results: null and empty texts have no tokens and no container; an item above the capacity is split into pieces
of exactly the capacity and a remainder; nothing else is split; an empty table gives no containers; repeated rows of one
id count once, with their largest size.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import sharded_position
from ..runtime import cut, table
from .nnls import nnls
from .pieces import limits
from .tokens import TOKENIZER_FILE, token_sizes


def patterns(bins: int, depth: int) -> np.ndarray:
    """All multisets of at most depth bin numbers (1..bins) whose sum is bins, as rows of counts."""
    rows: list[list[int]] = []

    def grow(chosen: list[int], least: int, left: int) -> None:
        if left == 0:
            rows.append(chosen)
        elif len(chosen) < depth:
            for v in range(least, left + 1):
                if v == left or v * 2 <= left or len(chosen) + 1 == depth:
                    if len(chosen) + 1 == depth and v != left:
                        continue
                    grow([*chosen, v], v, left - v)

    grow([], 1, bins)
    out = np.zeros((len(rows), bins + 1), np.float64)
    for i, r in enumerate(rows):
        np.add.at(out[i], r, 1)
    return out


@dataclass
class Level:
    """Where the items of each class go: interval starts by class, then container = base + (rank - start) // per."""

    classes: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)  # class -> (rank start, base, per)
    ranks: dict[int, int] = field(default_factory=dict)  # class -> items placed so far
    containers: int = 0

    def place(self, pattern: dict[int, int], repeats: int, lengths: dict[int, int]) -> None:
        for c, per in pattern.items():
            start = self.ranks.get(c, 0)
            self.classes.setdefault(c, []).append((start, self.containers, per))
            self.ranks[c] = start + per * repeats
        self.containers += repeats


def _take(pattern_bins: np.ndarray, repeats: int, members: dict[int, list[list[int]]]) -> list[tuple[dict[int, int], int]]:
    """Turn a pattern of bins into patterns of classes; members: bin -> [class, count left], longest first."""
    out = []
    while repeats > 0:
        pat: dict[int, int] = {}
        most = repeats
        for b in np.flatnonzero(pattern_bins):
            need = int(pattern_bins[b])
            left = [m for m in members[b] if m[1] > 0]
            if not left:
                return out
            if left[0][1] >= need:
                pat[left[0][0]] = pat.get(left[0][0], 0) + need
                most = min(most, left[0][1] // need)
            else:
                most = 1
                for m in left:
                    k = min(need, m[1])
                    pat[m[0]] = pat.get(m[0], 0) + k
                    need -= k
                    if not need:
                        break
                if need:
                    return out
        for b in np.flatnonzero(pattern_bins):
            for m in members[b]:
                if m[0] in pat:
                    m[1] -= pat[m[0]] * most
        out.append((pat, most))
        repeats -= most
    return out


def plan_level(lengths: dict[int, int], counts: dict[int, int], capacity: int, bins: int = 128, depth: int = 3) -> Level:
    """Places every item of every class into containers; classes are numbers with a length each."""
    lv = Level()
    width = max(1, -(-capacity // bins))
    n_bins = capacity // width
    open_: dict[int, list[list]] = {}  # space left -> [pattern, containers]
    spaces: list[int] = []

    def put(space: int, pat: dict[int, int], k: int) -> None:
        if not open_.get(space):
            open_[space] = []
            bisect.insort(spaces, space)
        open_[space].append([pat, k])

    members: dict[int, list[list[int]]] = {}
    for c in sorted(counts, key=lambda c: -lengths[c]):
        if counts[c] > 0:
            members.setdefault(min(n_bins, -(-lengths[c] // width)), []).append([c, counts[c]])
    if members and n_bins >= 2:
        pats = patterns(n_bins, depth)
        hist = np.zeros(n_bins + 1)
        for b, m in members.items():
            hist[b] = sum(k for _, k in m)
        fit = [b for b in members if b * width <= capacity or all(lengths[c] <= capacity for c, _ in members[b])]
        usable = pats[(pats[:, [b for b in range(n_bins + 1) if b not in fit]] == 0).all(axis=1)]
        if len(usable):
            weight = np.arange(n_bins + 1, dtype=np.float64)[:, None]  # long items are harder to place
            x = np.floor(nnls(usable.T * weight, hist * weight[:, 0]) + 1e-6).astype(np.int64)
            for i in np.argsort(-x, kind="stable"):
                if x[i] <= 0:
                    break
                for pat, k in _take(usable[i], int(x[i]), members):
                    fill = sum(lengths[c] * m for c, m in pat.items())
                    if fill <= capacity:
                        put(capacity - fill, pat, k)  # bins round up: what is left over can still take a small item
                    else:  # bins are rounded up, so this only guards odd capacities
                        for c, m in pat.items():
                            next(y for y in members[min(n_bins, -(-lengths[c] // width))] if y[0] == c)[1] += m * k
    residual = sorted(((lengths[c], c, k) for m in members.values() for c, k in m if k > 0), reverse=True)

    for length, c, k in residual:
        while k > 0:
            i = bisect.bisect_left(spaces, length)
            if i < len(spaces):
                s = spaces[i]
                pat, have = open_[s].pop()
                if not open_[s]:
                    spaces.pop(i)
                each = min(s // length, max(1, k // have)) if k >= have else 1
                used = min(have, k // each)
                if used < have:
                    put(s, pat, have - used)
                put(s - each * length, pat | {c: pat.get(c, 0) + each}, used)
                k -= each * used
            else:
                per = capacity // length
                q, r = divmod(k, per)
                if q:
                    put(capacity - per * length, {c: per}, q)
                if r:
                    put(capacity - r * length, {c: r}, 1)
                k = 0
    for s in spaces:
        for pat, k in open_[s]:
            lv.place(pat, k, lengths)
    return lv


@dataclass
class Plan:
    """Where items go, by their length and their rank among the items of that length."""

    capacity: int
    level: Level

    def locate(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Container of each item."""
        out = np.full(len(length), -1, np.int64)
        for c in np.unique(length):
            sel = length == c
            iv = np.array(self.level.classes[int(c)], np.int64)
            r = rank[sel].astype(np.int64)
            k = np.searchsorted(iv[:, 0], r, "right") - 1
            out[sel] = iv[k, 1] + (r - iv[k, 0]) // iv[k, 2]
        return out


def make_plan(histogram: dict[int, int], capacity: int, bins: int = 128, depth: int = 3) -> Plan:
    """Plan for a histogram length -> count with lengths 1..capacity."""
    return Plan(capacity, plan_level({n: n for n in histogram}, dict(histogram), capacity, bins, depth))


def split_over(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece_no, token_start, token_end, n_tokens): items above the capacity in pieces, others whole."""
    n = F.col("n_tokens")
    s = sizes.filter(n > 0).withColumn("_k", F.ceil(n / F.lit(capacity)).cast("int")).withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    start = F.col("piece_no").cast("bigint") * capacity
    return s.select("doc_id", "piece_no", start.alias("token_start"), F.least(start + capacity, n).alias("token_end")).withColumn("n_tokens", (F.col("token_end") - F.col("token_start")).cast("int"))


def pack_items(sizes: DataFrame, capacity: int, bins: int = 128, depth: int = 3, shards: int = 64, seed: int = 7) -> DataFrame:
    """Container of every piece of every item of ``sizes`` (doc_id, n_tokens).

    Ranks within a length come from sharded windows, so a length that a third of all items have is no single task;
    the plan's intervals (no more than lengths times patterns) travel with the task closure.
    """
    once = sizes.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    pieces = cut(split_over(once, capacity))
    hist = {int(r["n_tokens"]): int(r["k"]) for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("k")).collect()}  # at most capacity rows
    plan = make_plan(hist, capacity, bins, depth)
    ranked = sharded_position(pieces, ["n_tokens"], F.xxhash64("doc_id", "piece_no", F.lit(seed)), ["doc_id", "piece_no"], shards=shards, rank="_rank")
    cols = ["doc_id", "piece_no", "token_start", "token_end", "n_tokens"]
    schema = ranked.select(*cols).schema.add("container_id", "long")

    def place(batches):
        for b in batches:
            to = plan.locate(b.column(4).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(to)], names=[*cols, "container_id"])

    return ranked.select(*cols, "_rank").mapInArrow(place, schema)


def document_sizes(documents: DataFrame, tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """(doc_id, source, n_tokens) of each document, written once."""
    return cut(token_sizes(documents, "text", ["doc_id", "source"], tokenizer_file=tokenizer_file))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, the share of the space used, the fullest and emptiest container, items split."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.sum((F.col("piece_no") > 0).cast("int")).alias("cuts"))
    return per.agg(F.lit(capacity).alias("capacity"), F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.round(F.sum("used") / (F.count("*") * F.lit(capacity)), 6).alias("fill"), F.min("used").alias("least_used"), F.max("used").alias("most_used"), F.sum("cuts").alias("cuts"))


def _packed(spark, d, item):
    capacity, _, _ = limits(table(spark, d, "size_limits"), item)
    sizes = token_sizes(table(spark, d, "documents"), "text", ["doc_id"])
    return pack_items(sizes, capacity), capacity


def p8_containers(spark, d):
    return _packed(spark, d, "container")[0]


def p8_small_containers(spark, d):
    return _packed(spark, d, "small_container")[0]


def p8_fill(spark, d):
    return fill_report(*_packed(spark, d, "container")).unionByName(fill_report(*_packed(spark, d, "small_container")))

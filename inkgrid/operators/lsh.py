"""Near duplicates: MinHash signatures, band buckets, exact similarity joins and their classes."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions import text as T
from ..runtime import cut, release

#: A prime just above 2^32; signatures are numbers below it.
PRIME = 4_294_967_311
_SPLIT = re.compile(f"[{T.WHITE_SPACE}]+")
#: Odd multipliers of the mixing of word hashes into hashes of runs.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_hashes(text: str, size: int, known: dict[str, int]) -> np.ndarray:
    """Hashes of the distinct runs of ``size`` lower-case words; a shorter text is one run, a blank one has none. ``known``: hashes of words so far."""
    words = [w for w in _SPLIT.split(text.lower()) if w]
    if not words:
        return np.zeros(0, np.int64)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    h = np.array([known[w] for w in words], np.uint64)
    k = min(size, len(h))
    run = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        run = run * _STEP + h[j : len(h) - k + 1 + j]
        run = (run ^ (run >> np.uint64(29))) * _MIX
    return np.unique(run ^ (run >> np.uint64(32))).view(np.int64)


def shingles(c: Column, size: int = 5) -> Column:
    """array<bigint>: hashes of the distinct runs of ``size`` lower-case words, in Arrow batches; null for null."""

    @F.pandas_udf(ArrayType(LongType()))
    def of(s: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        return pd.Series([None if t is None else shingle_hashes(t, size, known) for t in s], dtype=object)

    return of(c)


def coefficients(count: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, PRIME, count, dtype=np.uint64), r.integers(0, PRIME, count, dtype=np.uint64)


def min_hashes(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """For each set and hash function the least value, all sets that fit ``at_once`` hashes in one piece of arithmetic."""
    out, k = [], 0
    a = a % np.uint64(1 << 31)
    while k < len(sets):
        e, n = k, 0
        while e < len(sets) and (e == k or n + len(sets[e]) <= at_once):
            n += len(sets[e])
            e += 1
        flat = np.concatenate(sets[k:e]).view(np.uint64) % np.uint64(PRIME)
        starts = np.r_[0, np.cumsum([len(x) for x in sets[k:e]])[:-1]]
        out.append(np.stack([np.minimum.reduceat((flat * x + y) % np.uint64(PRIME), starts) for x, y in zip(a, b)], 1))
        k = e
    return np.concatenate(out).astype(np.int64) if out else np.zeros((0, len(a)), np.int64)


def signatures(df: DataFrame, id_col: str, text_col: str, count: int = 64, size: int = 5, seed: int = 42) -> DataFrame:
    """(id, signature array<bigint>): per hash function the least value over the shingles.

    A text of fewer words than a shingle has is hashed as it stands, case and spaces included; blank and null texts have no signature.
    """
    d = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def sign(batches):
        a, b = coefficients(count, seed)
        for x in batches:
            known: dict[str, int] = {}
            at, sets = [], []
            for i, t in enumerate(x.column(1).to_pylist()):
                if not t or not (h := shingle_hashes(t, size, known)).size:
                    continue
                if len(h) == 1 and len(_SPLIT.split(t.strip(T.WHITE_SPACE))) < size:
                    h = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))], np.uint64).view(np.int64)
                at.append(i)
                sets.append(h)
            m = min_hashes(sets, a, b)
            sig = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, count), pa.int32()), pa.array(m.reshape(-1)))
            yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(at, pa.int32())), sig], names=["id", "signature"])

    return d.mapInArrow(sign, f"id {dict(d.dtypes)['id']}, signature array<bigint>")


def band_key(signature: list[int], rows: int, band: int) -> str:
    """The bucket key of one band: the digest of its values as little-endian 64-bit numbers."""
    return hashlib.md5(np.array(signature[band * rows : (band + 1) * rows], "<u8").tobytes()).hexdigest()


def buckets(sigs: DataFrame, bands: int = 16) -> DataFrame:
    """(band, bucket_key, id): one row for each band of each signature. A table of these rows is the index that later batches are probed against."""

    def rows_of(batches):
        for x in batches:
            n = x.num_rows
            if not n:
                continue
            m = x.column(1).flatten().to_numpy(zero_copy_only=False).astype("<u8").reshape(n, -1)
            rows = m.shape[1] // bands
            raw, width = m[:, : rows * bands].tobytes(), rows * 8
            keys = [hashlib.md5(raw[k : k + width]).hexdigest() for k in range(0, len(raw), width)]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(bands, dtype=np.int32), n)), pa.array(keys, pa.string()), x.column(0).take(pa.array(np.repeat(np.arange(n), bands)))], names=["band", "bucket_key", "id"])

    return sigs.select("id", "signature").mapInArrow(rows_of, f"band int, bucket_key string, id {dict(sigs.dtypes)['id']}")


def probe(bucket_rows: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(id, near_id): the first id of the first band in which an id meets another one that came before it.

    With ``index`` (bucket rows of what is stored) new rows are looked up there only; without it ids come in their own order.
    Aggregated by bucket, not paired: a bucket of any size costs one row.
    """
    first = (index if index is not None else bucket_rows).groupBy("band", "bucket_key").agg(F.min("id").alias("near_id"))
    hit = bucket_rows.join(first, ["band", "bucket_key"])
    hit = hit.filter(F.col("near_id") != F.col("id")) if index is not None else hit.filter(F.col("near_id") < F.col("id"))
    return hit.groupBy("id").agg(F.min_by("near_id", F.struct("band", "near_id")).alias("near_id"))


def copy_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id): exact copies by canonical hash; a class is named by its least id. Blank and null texts have none."""
    h = df.select(F.col(f"`{id_col}`").alias("id"), T.canonical_hash(F.col(f"`{text_col}`")).alias("h")).filter(F.length("h") > 0)
    h = cut(h)
    return h.join(h.groupBy("h").agg(F.min("id").alias("class_id")), "h").select("id", "class_id")


def similar_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """(id_a, id_b, jaccard): all pairs of texts whose shingle sets are at least that similar, exactly.

    Prefix filter: of sets sorted by the rarity of their shingles over the corpus, two that are similar enough share one of the first
    n - ceil(t n) + 1. Only these are joined (common shingles are at the end of the order), and only where sizes and what is left of both
    sets behind the shared shingle can still reach the threshold; then whole sets are compared.
    """
    s = cut(df.select(F.col(f"`{id_col}`").alias("id"), shingles(F.col(f"`{text_col}`"), size).alias("sh")).filter(F.size("sh") > 0))
    freq = s.select(F.explode("sh").alias("x")).groupBy("x").agg(F.count("*").alias("f")).filter("f > 1")
    # a shingle of one text only pairs nothing; it counts as rarest
    ordered = s.select("id", F.size("sh").alias("n"), F.explode("sh").alias("x")).join(freq, "x").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("o"))
    single = F.col("n") - F.size("o")
    keep = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1 - single
    pre = ordered.filter(keep > 0).select("id", "n", single.alias("k"), F.posexplode(F.slice("o", F.lit(1), keep.cast("int"))).alias("p", "y")).select("id", "n", (F.col("k") + F.col("p")).alias("p"), F.col("y.x").alias("x"))
    a, b = pre.toDF("id_a", "n_a", "p_a", "x"), pre.toDF("id_b", "n_b", "p_b", "x")
    need = F.lit(threshold / (1 + threshold)) * (F.col("n_a") + F.col("n_b")) - 1e-9
    fits = (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9) & (F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) + F.least("p_a", "p_b") >= need)
    near = a.join(b, "x").filter((F.col("id_a") < F.col("id_b")) & fits).select("id_a", "id_b").distinct()
    x = near.join(s.toDF("id_a", "sa"), "id_a").join(s.toDF("id_b", "sb"), "id_b")
    inter = F.size(F.array_intersect("sa", "sb"))
    return x.select("id_a", "id_b", F.round(inter / (F.size("sa") + F.size("sb") - inter), 6).alias("jaccard")).filter(F.col("jaccard") >= threshold)


def connected(pairs: DataFrame) -> DataFrame:
    """(id, component): components of links (id_a, id_b), named by their least id.

    Labels travel along links and each round also jumps to the label of the label, so rounds grow with the logarithm of a component's width; links and
    labels stay distributed, each round is written once and the one before it deleted. It ends when nothing changes.
    """
    e = pairs.select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))
    e = cut(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    lab = cut(e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")))
    while True:
        near = e.join(lab.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v").groupBy("u").agg(F.min("cv").alias("m"))
        one = lab.join(near, "u", "left").select("u", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c"))
        jump = one.join(lab.select(F.col("u").alias("_u"), F.col("c").alias("_c")), F.col("c") == F.col("_u"), "left").select("u", "old", F.least("c", F.coalesce("_c", "c")).alias("c"))
        new = cut(jump)
        changed = new.filter(F.col("c") != F.col("old")).limit(1).count()
        release(lab)
        lab = new
        if not changed:
            release(e)
            return lab.select(F.col("u").alias("id"), F.col("c").alias("component"))


def near_duplicate_classes(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """(id, class_id, links): the near-duplicate class of each text and the number of different texts it is linked to.

    Copies are made one first; no link between different texts is lost. Texts without a link are their own class.
    """
    copies = cut(copy_classes(df, id_col, text_col))
    reps = df.join(copies.filter("id = class_id").select(F.col("id").alias("_i")), F.col(f"`{id_col}`") == F.col("_i"), "left_semi")
    pairs = cut(similar_pairs(reps, id_col, text_col, threshold, size))
    comp = connected(pairs)
    links = pairs.select(F.explode(F.array("id_a", "id_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    c = copies.select("id", F.col("class_id").alias("rep")).join(comp.toDF("rep", "component"), "rep", "left").join(links, "rep", "left")
    return c.select("id", F.coalesce("component", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))

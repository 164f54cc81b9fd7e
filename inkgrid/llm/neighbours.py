"""The most similar vectors of every vector (problem 4).

Unit vectors are projected to a few dimensions by a Gaussian (2-stable) matrix: the squared projected distance of
two vectors over their squared true distance is chi-square distributed with as many degrees of freedom. A kd-tree over the
projections is searched incrementally: parts of the tree come in the order of their projected distance, their points are
verified by true distance, and a query stops when the chi-square test says that a nearer vector would, with
probability ``confidence``, have shown by now.

The upper levels of the tree are fitted on a bounded sample and cut the collection into cells, one per task; a query is
searched in its own cell first and then sent only to the cells that its stopping radius reaches.

Defined results: null, all-zero and non-finite embeddings and those whose length is not ``dimensions`` take no part; repeated
rows of an id count once (the latest); exact copies are searched once and expanded at the end, ties go to the smaller id; a
vector with fewer than k others of its model gets those there are; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, table


def chi_square_cdf(x: float, m: int) -> float:
    """The distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    s, h = m / 2.0, x / 2.0
    term = total = 1.0 / s
    n = 0
    while term > total * 1e-15 and n < 10_000:
        n += 1
        term *= h / (s + n)
        total += term
    return min(1.0, total * math.exp(-h + s * math.log(h) - math.lgamma(s)))


def chi_square_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 10.0 * m + 100.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, m) < p else (lo, mid)
    return hi


def projection(dimensions: int, m: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng([seed, dimensions, m]).standard_normal((dimensions, m)).astype(np.float32)


def usable_vectors(vectors: DataFrame, m: int) -> DataFrame:
    """(model, id, key, vec, proj): unit vectors as float32 bytes, their digest and projection."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = vectors.filter(e.isNotNull() & F.col("id").isNotNull() & (F.size(e) == F.col("dimensions")) & (F.size(e) > 0) & ~bad & F.exists(e, lambda x: x != 0))
    ok = ok.select("id", "model_version", e.cast("array<float>").alias("embedding"), "created_at")

    def unit(batches):
        for b in batches:
            col = b.column(2)
            off, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
            vec, key, proj = [], [], []
            for a, z in zip(off[:-1], off[1:]):
                x = flat[a:z].astype(np.float64)
                x = (x / np.abs(x).max()) if z > a else x
                u = (x / np.linalg.norm(x)).astype(np.float32)
                raw = u.tobytes()
                vec.append(raw)
                key.append(hashlib.blake2b(raw, digest_size=16).digest())
                proj.append((u @ projection(z - a, m)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(key, pa.binary()), pa.array(vec, pa.binary()), pa.array(proj, pa.binary()), b.column(3)], names=["model", "id", "key", "vec", "proj", "at"])

    named = ok.select("id", F.concat_ws("/", F.coalesce("model_version", F.lit("")), F.size("embedding")).alias("m"), "embedding", "created_at")
    p = named.mapInArrow(unit, "model string, id string, key binary, vec binary, proj binary, at timestamp")
    return p.groupBy("id").agg(F.max_by(F.struct("model", "key", "vec", "proj"), F.struct("at", "key")).alias("x")).select("x.model", "id", "x.key", "x.vec", "x.proj")


class Tree:
    """A kd-tree by median cuts along the widest dimension; leaves are runs of an order, with their boxes."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        self.bounds: list[tuple[int, int]] = []
        stack = [(0, len(points))]
        while stack:
            a, e = stack.pop()
            if e - a <= leaf:
                self.bounds.append((a, e))
                continue
            idx = self.order[a:e]
            p = points[idx]
            d = int(np.argmax(p.max(0) - p.min(0)))
            mid = (e - a) // 2
            self.order[a:e] = idx[np.argpartition(p[:, d], mid, kind="introselect")]
            stack += [(a, a + mid), (a + mid, e)]
        sorted_ = points[self.order]
        self.low = np.array([sorted_[a:e].min(0) for a, e in self.bounds], np.float32).reshape(-1, points.shape[1])
        self.high = np.array([sorted_[a:e].max(0) for a, e in self.bounds], np.float32).reshape(-1, points.shape[1])

    def box_distance(self, q: np.ndarray) -> np.ndarray:
        return box_distance(q, self.low, self.high)


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(q), len(low)), np.float32)
    for j in range(q.shape[1]):
        x = q[:, j : j + 1]
        gap = np.maximum(np.maximum(low[None, :, j] - x, x - high[None, :, j]), 0)
        out += gap * gap
    return out


def search(tree: Tree, proj: np.ndarray, vec: np.ndarray, q_proj: np.ndarray, q_vec: np.ndarray, bound: np.ndarray, k: int, chi: float, skip: np.ndarray | None = None, block: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, squared distance) of the up to k nearest points of each query below its bound.

    bound: squared true distance beyond which a query wants nothing. skip: for each query the point that is itself.
    """
    p_sorted, v_sorted = proj[tree.order], vec[tree.order]
    p_norm = (p_sorted * p_sorted).sum(1)
    out_q, out_p, out_d = [], [], []
    for s in range(0, len(q_proj), block):
        qp, qv, limit = q_proj[s : s + block], q_vec[s : s + block], bound[s : s + block].astype(np.float32).copy()
        own = skip[s : s + block] if skip is not None else None
        qn = (qp * qp).sum(1)
        n = len(qp)
        near = tree.box_distance(qp)
        turn = np.argsort(near, axis=1, kind="stable")
        best_d = np.full((n, k), np.inf, np.float32)
        best_p = np.full((n, k), -1, np.int64)
        active = np.arange(n)
        for j in range(near.shape[1]):
            leaf = turn[active, j]
            go = near[active, leaf] <= chi * limit[active]  # the chi-square stopping test
            active, leaf = active[go], leaf[go]
            if not len(active):
                break
            by = np.argsort(leaf, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(leaf[by]) > 0])
            new_q, new_p, new_d = [], [], []
            for a, e in zip(starts, np.r_[starts[1:], len(by)]):
                g = active[by[a:e]]
                lo, hi = tree.bounds[leaf[by[a]]]
                d2 = qn[g, None] + p_norm[None, lo:hi] - 2 * (qp[g] @ p_sorted[lo:hi].T)
                hit = d2 <= chi * limit[g, None]
                r, c = np.nonzero(hit)
                if not len(r):
                    continue
                if 8 * len(r) > hit.size:  # most of the pairs pass: one product verifies all of the leaf at less cost, and those the test would miss
                    near_ = qv[g] @ v_sorted[lo:hi].T
                    r, c = np.nonzero(near_ >= (1 - limit[g] / 2)[:, None])
                    t = np.maximum(2 - 2 * near_[r, c], 0)
                    ok = slice(None)
                else:
                    t = np.maximum(2 - 2 * np.einsum("ij,ij->i", qv[g[r]], v_sorted[lo + c]), 0)
                    ok = t <= limit[g[r]]
                    t = t[ok]
                if not len(t):
                    continue
                new_q.append(g[r[ok]])
                new_p.append(tree.order[lo + c[ok]])
                new_d.append(t)
            if not new_q:
                continue
            nq, np_, nd = np.concatenate(new_q), np.concatenate(new_p), np.concatenate(new_d)
            if own is not None:
                other = np_ != own[nq]
                nq, np_, nd = nq[other], np_[other], nd[other]
            if not len(nq):
                continue
            who = np.unique(nq)
            have = best_p[who] >= 0
            row = np.repeat(who, have.sum(1))
            aq, ap, ad = np.r_[nq, row], np.r_[np_, best_p[who][have]], np.r_[nd, best_d[who][have]]
            o = np.lexsort((ap, ad, aq))
            aq, ap, ad = aq[o], ap[o], ad[o]
            first = np.flatnonzero(np.r_[True, np.diff(aq) > 0])
            rank = np.arange(len(aq)) - np.repeat(first, np.diff(np.r_[first, len(aq)]))
            keep = rank < k
            best_d[who], best_p[who] = np.inf, -1
            best_d[aq[keep], rank[keep]] = ad[keep]
            best_p[aq[keep], rank[keep]] = ap[keep]
            limit[who] = np.minimum(limit[who], best_d[who, k - 1])
        q, r = np.nonzero(best_p >= 0)
        out_q.append(q + s)
        out_p.append(best_p[q, r])
        out_d.append(best_d[q, r])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return np.concatenate(out_q), np.concatenate(out_p), np.concatenate(out_d)


def _matrix(col: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    rows = col.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1)


def _by_key(t: pa.Table) -> pa.Table:
    """Rows in the order of their digests, so that nothing depends on the order in which they came."""
    return t.take(pa.array(np.argsort(np.array([*t.column("key").to_pylist(), None], object)[:-1], kind="stable")))


def fit_cells(sample: np.ndarray, cells: int) -> list:
    """Splits of the upper tree as nested tuples (dimension, value, left, right) with cell numbers as leaves."""
    counter = iter(range(cells))

    def grow(p: np.ndarray, n: int):
        if n <= 1 or len(p) < 2:
            return next(counter)
        left = n // 2
        d = int(np.argmax(p.max(0) - p.min(0)))
        v = float(np.quantile(p[:, d], left / n))
        side = p[:, d] <= v
        if side.all() or not side.any():
            return next(counter)
        return (d, v, grow(p[side], left), grow(p[~side], n - left))

    return grow(sample, cells)


def cell_of(node, p: np.ndarray) -> np.ndarray:
    out = np.zeros(len(p), np.int32)
    stack = [(node, np.arange(len(p)))]
    while stack:
        n, idx = stack.pop()
        if isinstance(n, int):
            out[idx] = n
        else:
            side = p[idx, n[0]] <= n[1]
            stack += [(n[2], idx[side]), (n[3], idx[~side])]
    return out


def nearest_classes(reps: DataFrame, k: int, confidence: float, m: int, least_similarity: float | None, cell_rows: int, sample_rows: int, block_rows: int = 200_000, leaf: int = 256) -> DataFrame:
    """(model, q, n, d2): for each distinct vector (model, key, vec, proj) its up to k nearest other distinct ones.

    There are as many cells as ``cell_rows`` asks for. The sample gives the upper cuts, at least eight sampled points to a side; where
    more cells are needed than it can cut, a cell is cut on by ranges of a hash, so that no task grows with the collection.
    """
    chi = chi_square_quantile(confidence, m)
    far = 4.0 if least_similarity is None else max(0.0, 2 - 2 * least_similarity) + 1e-6
    spark = reps.sparkSession
    sizes = {r["model"]: int(r["n"]) for r in reps.groupBy("model").agg(F.count("*").alias("n")).collect()}  # one row per model
    trees = {}
    for model, n in sizes.items():
        share = min(1.0, sample_rows / n)
        rows = reps.filter((F.col("model") == model) & (F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20))))).select("key", "proj").limit(2 * sample_rows).collect()
        p = np.frombuffer(b"".join(bytes(r["proj"]) for r in sorted(rows, key=lambda r: bytes(r["key"]))), np.float32).reshape(-1, m)
        wanted = max(1, math.ceil(n / cell_rows))
        by_cuts = max(1, min(wanted, len(p) // 8))
        trees[model] = (fit_cells(p, by_cuts) if len(p) else 0, math.ceil(wanted / by_cuts))
    sent_trees = spark.sparkContext.broadcast(trees)  # an eighth of the sample's size at most

    def assign(batches):
        for b in batches:
            models = b.column(0).to_pylist()
            p = _matrix(b.column(3)) if len(models) else np.zeros((0, m), np.float32)
            cell = np.zeros(len(models), np.int32)
            keys = b.column(1).to_pylist()
            for x in set(models):
                at = np.flatnonzero([y == x for y in models])
                node, parts = sent_trees.value[x]
                cell[at] = cell_of(node, p[at]) * parts
                if parts > 1:
                    cell[at] += [int.from_bytes(keys[i][:8], "little") % parts for i in at]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=["model", "key", "vec", "proj", "cell"])

    placed = cut(reps.select("model", "key", "vec", "proj").mapInArrow(assign, "model string, key binary, vec binary, proj binary, cell int"))

    def local(t: pa.Table) -> pa.Table:
        t = _by_key(t)
        p, v = _matrix(t.column("proj")), _matrix(t.column("vec"))
        keys = t.column("key")
        q, r, d = search(Tree(p, leaf), p, v, p, v, np.full(len(p), far, np.float32), k, chi, skip=np.arange(len(p)))
        model = t.column("model")[0].as_py()
        worst = np.full(len(p), far, np.float32)
        n = np.bincount(q, minlength=len(p))
        full = np.flatnonzero(n >= k)
        if len(full):
            top = np.zeros(len(p), np.float32)
            np.maximum.at(top, q, d)
            worst[full] = top[full]
        # the box of the cell travels with one row of its own; bounds with each vector's row
        lo, hi = p.min(0).tobytes(), p.max(0).tobytes()
        kinds = np.r_[np.zeros(len(q), np.int8), np.ones(len(p), np.int8), [2]].astype(np.int8)
        none = [None] * len(p)
        return pa.table(
            {
                "model": pa.array([model] * len(kinds)),
                "cell": pa.array([t.column("cell")[0].as_py()] * len(kinds), pa.int32()),
                "kind": pa.array(kinds, pa.int8()),
                "q": pa.array([*keys.take(pa.array(q)).to_pylist(), *keys.to_pylist(), lo], pa.binary()),
                "n": pa.array([*keys.take(pa.array(r)).to_pylist(), *none, hi], pa.binary()),
                "d2": pa.array(np.r_[d, worst, [0]].astype(np.float32)),
            }
        )

    first = cut(placed.groupBy("model", "cell").applyInArrow(local, "model string, cell int, kind byte, q binary, n binary, d2 float"))
    found = first.filter("kind = 0").select("model", "q", "n", "d2")
    if all(isinstance(x, int) and parts == 1 for x, parts in trees.values()):
        return found
    boxes: dict[str, list] = {}
    for r in first.filter("kind = 2").select("model", "cell", "q", "n").collect():  # one row per cell
        boxes.setdefault(r["model"], []).append((r["cell"], np.frombuffer(bytes(r["q"]), np.float32), np.frombuffer(bytes(r["n"]), np.float32)))
    sent_boxes = spark.sparkContext.broadcast({x: (np.array([c for c, _, _ in v]), np.array([a for _, a, _ in v]), np.array([b for _, _, b in v])) for x, v in boxes.items()})
    bounds = first.filter("kind = 1").select(F.col("q").alias("key"), F.col("model").alias("_m"), "d2")
    queries = placed.join(bounds, (F.col("model") == F.col("_m")) & (placed["key"] == bounds["key"])).select("model", placed["key"], "vec", "proj", "cell", "d2")

    def route(batches):
        for b in batches:
            models = b.column(0).to_pylist()
            if not models:
                continue
            p, d2, home = _matrix(b.column(3)), b.column(5).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
            rows, to = [], []
            for x in set(models):
                at = np.flatnonzero([y == x for y in models])
                cells, low, high = sent_boxes.value[x]
                hit = (box_distance(p[at], low, high) <= chi * d2[at, None]) & (cells[None, :] != home[at, None])
                r, c = np.nonzero(hit)
                rows.append(at[r])
                to.append(cells[c])
            i = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(i) for j in (0, 1, 2, 3, 5)), pa.array(np.concatenate(to).astype(np.int32))], names=["model", "key", "vec", "proj", "d2", "cell"])

    visits = queries.mapInArrow(route, "model string, key binary, vec binary, proj binary, d2 float, cell int")
    load = {(r["model"], r["cell"]): int(r["n"]) for r in visits.groupBy("model", "cell").agg(F.count("*").alias("n")).collect()}  # one row per cell
    n_blocks = spark.createDataFrame([(x, c, max(1, math.ceil(n / block_rows))) for (x, c), n in load.items()] or [("", 0, 1)], "model string, cell int, blocks int")
    v = visits.join(F.broadcast(n_blocks), ["model", "cell"]).select("model", "cell", "key", "vec", "proj", "d2", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"))
    res = placed.join(F.broadcast(n_blocks), ["model", "cell"]).select("model", "cell", "key", "vec", "proj", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).toDF("h_model", "h_cell", "key", "vec", "proj", "h_block")

    def visit(guests: pa.Table, hosts: pa.Table) -> pa.Table:
        schema = pa.schema([("model", pa.string()), ("q", pa.binary()), ("n", pa.binary()), ("d2", pa.float32())])
        if not guests.num_rows or not hosts.num_rows:
            return schema.empty_table()
        guests, hosts = _by_key(guests), _by_key(hosts)
        p, w = _matrix(hosts.column("proj")), _matrix(hosts.column("vec"))
        q, r, d = search(Tree(p, leaf), p, w, _matrix(guests.column("proj")), _matrix(guests.column("vec")), guests.column("d2").to_numpy(), k, chi)
        return pa.table({"model": pa.array([hosts.column("h_model")[0].as_py()] * len(q), pa.string()), "q": guests.column("key").take(pa.array(q)), "n": hosts.column("key").take(pa.array(r)), "d2": pa.array(d)}, schema=schema)

    away = v.groupBy("model", "cell", "block").cogroup(res.groupBy("h_model", "h_cell", "h_block")).applyInArrow(visit, "model string, q binary, n binary, d2 float")
    both = found.unionByName(away)
    w = Window.partitionBy("model", "q").orderBy("d2", "n")
    return both.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def similar_vectors(vectors: DataFrame, k: int = 10, confidence: float = 0.95, m: int = 8, least_similarity: float | None = None, cell_rows: int = 16_384, sample_rows: int = 20_000) -> DataFrame:
    """(model, id, neighbour, similarity, rank): the k most similar other vectors of each usable vector.

    With ``least_similarity`` only neighbours at least so similar are looked for, which stops the search far earlier. ``m``
    is the number of projected dimensions, ``sample_rows`` the bound of the sample that the cells are fitted on; every vector is
    indexed.
    """
    u = cut(usable_vectors(vectors, m))
    by_class = Window.partitionBy("model", "key").orderBy("id")
    few = u.select("model", "key", "id").withColumn("_r", F.row_number().over(by_class)).filter(F.col("_r") <= k + 1)
    reps = u.join(few.filter("_r = 1").select("id"), "id", "left_semi").select("model", "key", "vec", "proj")
    near = nearest_classes(reps, k, confidence, m, least_similarity, cell_rows, sample_rows)
    own = reps.select("model", F.col("key").alias("q"), F.col("key").alias("n"), F.lit(0.0).cast("float").alias("d2"))
    members = few.select("model", F.col("key").alias("n"), F.col("id").alias("neighbour"))
    cand = near.unionByName(own).join(members, ["model", "n"])
    w = Window.partitionBy("model", "q").orderBy("d2", "neighbour")
    lists = cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 1).groupBy("model", "q").agg(F.sort_array(F.collect_list(F.struct("d2", "neighbour"))).alias("found"))
    each = u.select("model", F.col("key").alias("q"), "id").join(lists, ["model", "q"])
    top = F.slice(F.filter("found", lambda x: x["neighbour"] != F.col("id")), 1, k)
    out = each.select("model", "id", F.posexplode(top).alias("rank", "x"))
    return out.select("model", "id", F.col("x.neighbour").alias("neighbour"), (1 - F.col("x.d2").cast("double") / 2).alias("similarity"), (F.col("rank") + 1).alias("rank"))


def p4_found(spark, d, least: float = 0.93):
    s = similar_vectors(table(spark, d, "vectors"), least_similarity=least, confidence=0.98).filter(F.col("similarity") >= least)
    return s.select(F.least("id", "neighbour").alias("vector_id_a"), F.greatest("id", "neighbour").alias("vector_id_b")).distinct()


def p4_neighbours(spark, d):
    """The ten most similar others of every usable vector."""
    return similar_vectors(table(spark, d, "vectors"), confidence=0.9)

from pathlib import Path

import numpy as np
import pytest

from inkgrid.llm import neighbours as N


def test_chi_square():
    assert N.chi_square_cdf(15.507, 8) == pytest.approx(0.95, abs=1e-4)
    assert N.chi_square_quantile(0.95, 2) == pytest.approx(5.9915, abs=1e-3)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, embedding array<float>, model_version string, dimensions int, created_at timestamp, key string, model int")


def rows_of(m, model="m", prefix="v"):
    return [(f"{prefix}{i:04d}", [float(v) for v in x], model, len(x), None, None, None) for i, x in enumerate(m)]


def brute(rows, k):
    out = {}
    for mv in {r[2] for r in rows}:
        ids = [r[0] for r in rows if r[2] == mv]
        a = np.array([r[1] for r in rows if r[2] == mv], np.float64)
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        s = a @ a.T
        np.fill_diagonal(s, -9)
        for i, x in enumerate(ids):
            out[x] = {ids[j] for j in np.argsort(-s[i])[:k]}
    return out


@pytest.mark.parametrize("cell_rows", [10_000, 150])
def test_recall(spark, cell_rows):
    r = np.random.default_rng(5)
    topics = r.standard_normal((20, 32))
    rows = rows_of(topics[r.integers(0, 20, 600)] + 0.4 * r.standard_normal((600, 32))) + rows_of(r.standard_normal((80, 16)), "n", "w")
    got = {}
    for x in N.similar_vectors(frame(spark, rows), k=5, confidence=0.95, cell_rows=cell_rows).collect():
        got.setdefault(x["id"], set()).add(x["neighbour"])
    true = brute(rows, 5)
    assert np.mean([len(got[i] & true[i]) / 5 for i in true]) >= 0.9


def test_unusable_repeated_and_few(spark):
    rows = [("a", [1.0, 0.0], "m", 2), ("a", [1.0, 0.0], "m", 2), ("b", [5.0, 0.1], "m", 2), ("z", [0.0, 0.0], "m", 2), ("n", [float("nan"), 1.0], "m", 2), ("i", [float("inf"), 1.0], "m", 2), ("s", [1.0], "m", 2), ("o", None, "m", 2), ("x", [1.0, 0.0], "other", 2), (None, [1.0, 0.0], "m", 2), ("u", [1.0, None], "m", 2)]
    d = frame(spark, [(*r, None, "k", 1) for r in rows])
    got = {(r["id"], r["neighbour"]) for r in N.similar_vectors(d, k=3).collect()}
    assert got == {("a", "b"), ("b", "a")}
    assert N.similar_vectors(d.limit(0), k=3).count() == 0


def test_copies_are_searched_once_and_all_get_neighbours(spark):
    rows = [(f"c{i:03d}", [1.0, 2.0, 3.0], "m", 3, None, None, None) for i in range(200)] + [("far", [-1.0, 0.0, 0.0], "m", 3, None, None, None)]
    got = {}
    for r in N.similar_vectors(frame(spark, rows), k=4).collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got["c150"] == ["c000", "c001", "c002", "c003"] and sorted(got["c001"]) == ["c000", "c002", "c003", "c004"] and len(got) == 201


def test_least_similarity(spark):
    rows = rows_of(np.array([[1.0, 0], [1, 0.1], [0, 1], [-1, 0]]))
    got = {(r["id"], r["neighbour"]) for r in N.similar_vectors(frame(spark, rows), k=3, least_similarity=0.93, confidence=0.99).filter("similarity >= 0.93").collect()}
    assert got == {("v0000", "v0001"), ("v0001", "v0000")}


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").is_dir(), reason="needs the test tables")
@pytest.mark.parametrize("cell_rows", [16_384, 120])
def test_recall_of_the_registered_setting(spark, cell_rows):
    """k = 10 and confidence 0.9, as p4_neighbours has them, against brute force over all usable vectors."""
    v = spark.read.parquet("/root/testdata/sf0.01/vectors.parquet")
    rows = {}
    for r in sorted(v.collect(), key=lambda r: (r["id"], r["created_at"])):
        e = r["embedding"]
        if e is None or len(e) != r["dimensions"] or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            continue
        rows[r["id"]] = (r["id"], e, f"{r['model_version']}/{len(e)}", len(e))
    true, got = brute(list(rows.values()), 10), {}
    for x in N.similar_vectors(v, k=10, confidence=0.9, cell_rows=cell_rows).collect():
        got.setdefault(x["id"], set()).add(x["neighbour"])
    assert set(got) == set(true)
    assert np.mean([len(got[i] & true[i]) / len(true[i]) for i in true if true[i]]) >= 0.9


def test_nothing_depends_on_the_order_of_rows_or_the_size_of_the_sample(spark):
    r = np.random.default_rng(9)
    rows = rows_of(r.standard_normal((5, 24))[r.integers(0, 5, 500)] + 0.3 * r.standard_normal((500, 24)))
    lists = []
    for seed in (1, 2):
        d = frame(spark, [rows[i] for i in np.random.default_rng(seed).permutation(len(rows))]).repartition(3 + seed)
        lists.append(sorted((x["id"], x["rank"], x["neighbour"]) for x in N.similar_vectors(d, k=5, confidence=0.9, cell_rows=50).collect()))
    assert lists[0] == lists[1] and len(lists[0]) == 2500
    # a sample too small for as many cells as are needed: cells are cut on, recall stays
    true, got = brute(rows, 5), {}
    for x in N.similar_vectors(frame(spark, rows), k=5, confidence=0.95, cell_rows=40, sample_rows=30).collect():
        got.setdefault(x["id"], set()).add(x["neighbour"])
    assert np.mean([len(got[i] & true[i]) / 5 for i in true]) >= 0.9

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.llm import containers as C
from inkgrid.llm import mixture as M
from inkgrid.llm.nnls import nnls
from inkgrid.llm.pieces import chunk_pieces, oversized_pieces, split_text
from inkgrid.llm.tokens import token_sizes


def test_nnls_satisfies_the_optimality_conditions():
    r = np.random.default_rng(2)
    for _ in range(30):
        a, b = r.random((12, 20)), r.random(12) * 5
        x = nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and g.max() < 1e-6 and np.abs(g[x > 0]).max(initial=0) < 1e-6


@pytest.mark.parametrize("cap", [2048, 512, 100, 7, 1])
@pytest.mark.parametrize("n", [1, 30, 5000])
def test_plan_places_every_item_within_capacity(cap, n):
    r = np.random.default_rng(cap + n)
    size = np.clip(np.exp(r.normal(np.log(cap / 8 + 1), 0.9, n)).astype(int), 1, cap)
    p = C.make_plan(Counter(size.tolist()), cap)
    seen, rank = Counter(), np.zeros(n, int)
    for i, x in enumerate(size):
        rank[i] = seen[x]
        seen[x] += 1
    at = p.locate(size, rank)
    used = np.bincount(at, weights=size)
    assert (at >= 0).all() and used.max() <= cap and (used > 0).all()
    if n == 5000 and cap >= 100:
        assert size.sum() / (len(used) * cap) > 0.96


def test_frame(spark):
    d = spark.createDataFrame([(i, int(x), 0) for i, x in enumerate([5, 5, 5, 250, 100, 0, 99, 1, 33, 33, 33, 5])] + [(4, 100, 1), (1, None, 1), (99, None, 0)], "doc_id int, n_tokens int, container_id int")
    got = C.pack_items(d, 100).collect()
    used = Counter()
    for r in got:
        used[r["container_id"]] += r["n_tokens"]
        assert r["token_end"] - r["token_start"] == r["n_tokens"] <= 100
    assert max(used.values()) <= 100 and sum(used.values()) == 569
    assert sorted((r["piece_no"], r["token_start"], r["token_end"]) for r in got if r["doc_id"] == 3) == [(0, 0, 100), (1, 100, 200), (2, 200, 250)]
    assert all(r["piece_no"] == 0 for r in got if r["doc_id"] != 3) and {r["doc_id"] for r in got} == set(range(12)) - {5}
    assert C.pack_items(d.limit(0), 100).count() == 0


def test_one_hot_length(spark):
    d = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 40).otherwise(F.col("id") % 90 + 1).alias("n_tokens"))
    rep = C.fill_report(C.pack_items(d, 100), 100).first()
    assert rep["fill"] > 0.88 and rep["most_used"] <= 100 and rep["cuts"] == 0


def test_token_sizes(spark):
    d = spark.createDataFrame([(1, "hello world", 7), (2, None, 7), (3, "", 7), (4, "字" * 3000, 7)], "doc_id int, text string, _text int")
    n = {r["doc_id"]: r["n_tokens"] for r in token_sizes(d, "text", ["doc_id"]).collect()}
    assert n[1] > 0 and n[2] == n[3] == 0 and n[4] >= 1000


def test_mixture(spark):
    r = np.random.default_rng(1)
    rows = [(i, "big" if i % 3 else "small" if i % 2 else None, int(r.integers(0, 60))) for i in range(6000)] + [(0, None, 5), (7, "big", 3)]
    d = spark.createDataFrame(rows, "doc_id int, source string, n_tokens int")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("gone", 0.1, 2), (None, 0.1, 1), ("zero", None, None)], "source string, target_share double, max_repeats int")
    m = M.mixture(d, t, block_tokens=500).cache()
    rep = {x["source"]: x for x in M.share_report(m, t).collect()}
    assert rep["big"]["actual_share"] == pytest.approx(0.5 / 0.9, abs=0.01) and rep["small"]["actual_share"] == pytest.approx(0.4 / 0.9, abs=0.01)
    assert rep["gone"]["actual_share"] == 0 and rep["big"]["most_repeats"] == 1 and rep["small"]["most_repeats"] <= 3
    again = M.mixture(d, t, block_tokens=500)
    assert again.exceptAll(m).count() == 0 and m.filter("source is null").count() == 0
    # early and late halves of the schedule have the same shares
    half = m.agg(F.max("slot")).first()[0] // 2
    a = m.filter(F.col("slot") <= half).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()
    assert next(x["t"] for x in a if x["source"] == "big") / sum(x["t"] for x in a) == pytest.approx(0.5 / 0.9, abs=0.02)
    assert M.mixture(d.limit(0), t).count() == 0


def test_schedule_is_even(spark):
    s = M.schedule(spark, [0.5, 0.3, 0.2], 1000).groupBy("source_no").count().collect()
    assert {x["source_no"]: x["count"] for x in s} == pytest.approx({0: 500, 1: 300, 2: 200}, abs=3)


@pytest.mark.parametrize("t", ["A sentence of words here. " * 300, "para one.\n\npara two goes on. " * 150, "字" * 5000, "x" * 4000, ("ก" * 50 + " ") * 100, "é" * 4000, "ab " * 3000, "\n" * 4000])
def test_pieces_keep_the_limits_and_cover_the_text(t):
    p = split_text(t, 450, 1800, 80)
    seen = np.zeros(len(t), bool)
    for i, (a, e, w, o) in enumerate(p):
        assert e - a <= 1800 and w <= 450 and w == len(t[a:e].split())
        seen[a:e] = True
        if i:
            assert p[i - 1][0] < a <= p[i - 1][1] + 4 and o <= 80
    assert all(s or c.isspace() for s, c in zip(seen, t))


def test_cuts_fall_on_the_strongest_boundary():
    t = ("Words of a sentence. " * 60).strip() + "\n\n" + ("More of the words. " * 60).strip()
    p = split_text(t, 450, 1800, 10)
    assert t[: p[0][1]].endswith(".") and t[p[0][1] : p[0][1] + 2] == "\n\n"
    assert len(t[p[1][0] : p[0][1]].split()) == 10
    assert not any(t[e : e + 1] == "́" for _, e, _, _ in split_text("é" * 2000, 450, 1800, 10))


def test_oversized_frame(spark):
    big = "Word and word. " * 200
    meta = "named_struct('start_char_offset', {}, 'end_char_offset', {}) metadata"
    rows = [("a", "d", big, 100, 100 + len(big)), ("a", "d", big, 100, 100 + len(big)), ("b", "d", big, 0, 0), ("c", "d", "short", 0, 5), ("n", "d", None, 0, 0), ("e", "d", "", 0, 0), ("f", None, big + "!", 0, 0)]
    c = spark.createDataFrame(rows, "id string, document_id string, content string, s int, e int").selectExpr("*", meta.format("s", "e"), "1 as piece_no")
    docs = spark.createDataFrame([("d", "xy " + big), ("z", None)], "document_id string, text string")
    lim = spark.createDataFrame([("chunk", 450, 80, 1800)], "item string, max_tokens int, overlap_tokens int, max_chars int")
    got = chunk_pieces(c, docs, lim).orderBy("chunk_id", "piece_no").collect()
    assert {r["chunk_id"] for r in got} == {"a", "b", "f"}
    first = {r["chunk_id"]: (r["start_char_offset"], r["offset_source"]) for r in got if r["piece_no"] == 0}
    assert first == {"a": (100, "stored"), "b": (3, "located"), "f": (None, "unknown")}
    assert len([r for r in got if r["chunk_id"] == "a"]) == len(split_text(big, 450, 1800, 80))
    assert oversized_pieces(c.limit(0), 450, 1800, 80).count() == 0


@pytest.mark.parametrize("word", ["eleven-char", "fifteen-letters"])
def test_overlap_of_long_words_is_whole(word):
    t = " ".join(f"{word}{i % 7}" + (".\n\n" if i % 50 == 49 else "") for i in range(600))
    p = split_text(t, 450, 1800, 80)
    assert len(p) > 2 and all(x[3] == 80 for x in p[1:]) and all(b - a <= 1800 for a, b, _, _ in p)
    assert all(x[1] < y[1] and x[0] < y[0] <= x[1] for x, y in zip(p, p[1:])) and p[-1][1] == len(t.rstrip())


@pytest.mark.parametrize("gap", [1700, 1799, 1800, 4000])
def test_pieces_advance_over_wide_gaps(gap):
    t = ("ab " * 100 + " " * gap) * 4 + "字" * 2500 + " " * gap + "end"
    p = split_text(t, 450, 1800, 80)
    assert all(x[1] < y[1] for x, y in zip(p, p[1:])) and all(b - a <= 1800 for a, b, _, _ in p)
    assert not "".join(t[x[1] : y[0]] for x, y in zip(p, p[1:])).strip() and p[-1][1] == len(t)


def test_a_tiny_source_does_not_shrink_the_mixture(spark):
    have, w, slots, b = M.plan_mixture({"big": (10**13, 10**9), "mid": (10**12, 10**8), "tiny": (100, 3)}, {"big": (0.6, 1), "mid": (0.3, 1), "tiny": (0.1, 4)})
    assert slots * b >= 0.5 * 1.1e13 and b <= 65_536
    tokens = {s: x * slots * b for s, x in zip(have, w)}
    assert tokens["tiny"] == pytest.approx(400, abs=b) and tokens["mid"] == pytest.approx(10**12) and tokens["big"] <= 10**13 + b
    assert M.plan_mixture({"a": (1000, 9), "b": (1000, 9)}, {"a": (0.5, 2), "b": (0.5, 2)}, total_tokens=600)[1:] == ([0.5, 0.5], 600, 1)
    rows = [(i, "big", 10) for i in range(3000)] + [(10_000 + i, "tiny", 10) for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    t = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.5, 3)], "source string, target_share double, max_repeats int")
    r = {x["source"]: x for x in M.share_report(M.mixture(d, t), t).collect()}
    assert r["tiny"]["tokens"] == pytest.approx(150, abs=40) and r["tiny"]["most_repeats"] <= 3 and r["big"]["tokens"] == pytest.approx(14_900, rel=0.02)


@pytest.mark.parametrize("size", [10, 100, 300, 999])
def test_quotas(size):
    q = M.quotas([50.0, 500.0, 30.0], [0.2, 0.5, 0.3], size)
    assert sum(q) == pytest.approx(min(size, 580)) and all(a <= c + 1e-9 for a, c in zip(q, [50, 500, 30]))


def test_versions_of_an_item_do_not_mix(spark):
    old, new = "Old words here. " * 200, "New words there. " * 300
    rows = [("a", old, "2030-01-01"), ("a", new, "2030-01-02"), ("a", new, "2030-01-02"), ("b", old, None), ("b", new, None)]
    c = spark.createDataFrame(rows, "id string, content string, at string").withColumn("created_at", F.col("at").cast("timestamp")).withColumn("_k", F.lit(1)).withColumn("_v", F.lit(2)).withColumn("text", F.lit("other"))
    got = {}
    for r in oversized_pieces(c, 450, 1800, 80).orderBy("id", "piece_no").collect():
        got.setdefault(r["id"], []).append(r["piece"])
    assert len(got["a"]) == len(split_text(new, 450, 1800, 80)) and all(x.startswith(("New", "words", "there")) and "Old" not in x for x in got["a"])
    assert len({"Old" in x for x in got["b"]}) == 1

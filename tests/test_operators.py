import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.operators import dedup, keywords, lines, lsh, metrics, providers, quality, search, segment, store, structure


def test_quality(spark):
    rows = ["The quick brown fox jumps over the lazy dog", "aaaaaaaaaaaaaaaaaaaa bb cc dd", "1234 5678 9012 3456 7890 abcd efgh", "abab", None, ""]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = d.select("i", quality.quality_score(F.col("t")).alias("s"), quality.passes_gate(F.col("t")).alias("g")).orderBy("i").collect()
    assert [r["s"] for r in got] == pytest.approx([0.452209, 0.2, 0.1, 0.0, 0.0, 0.0], abs=1e-6)
    assert [r["g"] for r in got] == [True, False, True, False, False, False]
    stop = d.filter("i = 0").select(quality.quality_score(F.col("t"), ["the", "over"]).alias("s")).first()["s"]
    assert stop == pytest.approx(0.452209 + 0.4 * 3 / 9, abs=1e-6)


def test_profile_of_blank(spark):
    r = quality.with_profile(spark.createDataFrame([("",), ("A b. c",)], "t string"), "t").orderBy("t").collect()
    assert (r[0]["sentence_count"], r[0]["token_count"]) == (0, 0) and (r[1]["sentence_count"], r[1]["token_count"]) == (2, 3)


def test_keywords(spark):
    d = spark.createDataFrame([(1, "Deep learning is fun. Deep learning models, big data is big."), (2, None), (3, "")], "id int, t string")
    got = [(r["keyword"], r["score"]) for r in keywords.top_keywords(d, "id", "t").orderBy("id", "rank").collect()]
    assert got == [("deep learning models", 8.0), ("deep learning", 5.0), ("big data", 3.5), ("big", 1.5), ("fun", 1.0)]
    assert keywords.top_keywords(d, "id", "t", 0).count() == 0


def test_chunk_ranges():
    assert segment.chunk_ranges([200, 200, 60, 40, 30, 300, 200], 450, 80) == [(1, 3), (3, 7)]
    rng = np.random.default_rng(1)
    for _ in range(500):
        t = rng.integers(0, 50, rng.integers(0, 12)).tolist()
        budget, overlap = int(rng.integers(1, 90)), int(rng.integers(0, 60))
        out, cur, s = [], 0, 1
        for i, x in enumerate(t, 1):
            cur += x
            if cur >= budget or i == len(t):
                out.append((s, i))
                k = i + 1
                while k > s and sum(t[k - 2 : i]) <= overlap:
                    k -= 1
                s, cur = k, sum(t[k - 1 : i])
        assert segment.chunk_ranges(t, budget, overlap) == out


@pytest.mark.parametrize("n, starts", [(1000, [0, 370, 740]), (450, [0]), (451, [0, 370])])
def test_token_windows(spark, n, starts):
    d = spark.createDataFrame([("d", 1, 1, " ".join(f"w{i}" for i in range(n)))], "document_id string, line_no int, page int, text string")
    got = segment.token_windows(d).orderBy("chunk_index").collect()
    assert [r["content"].split()[0] for r in got] == [f"w{s}" for s in starts] and got[-1]["content"].split()[-1] == f"w{n - 1}"


def test_char_windows(spark):
    d = spark.createDataFrame([("d", 1, 1, "x" * 3999)], "document_id string, line_no int, page int, text string")
    got = [(r["start_char_offset"], r["end_char_offset"]) for r in segment.char_windows(d).orderBy("chunk_index").collect()]
    assert got == [(0, 1800), (1480, 3280), (2960, 4000)]


def test_sentences(spark):
    d = spark.createDataFrame([("Hi there. Dr. X ok! Yes",)], "t string")
    assert d.select(segment.sentences(F.col("t")).alias("s")).first()["s"] == ["Hi there.", "Dr.", "X ok!", "Yes"]
    assert d.select(segment.sentences(F.col("t"), ("dr",)).alias("s")).first()["s"] == ["Hi there.", "Dr. X ok!", "Yes"]
    one = spark.createDataFrame([("d", 1, 1, "A. B! C? D")], "document_id string, line_no int, page int, text string")
    assert [r["text"] for r in segment.sentence_units(one).orderBy("unit_no").collect()] == ["A.", "B!", "C?", "D"]


def test_strategies(spark):
    d = spark.createDataFrame([("d", 1, 1, "A b. C d"), ("d", 2, 1, ""), ("d", 3, 2, "E f")], "document_id string, line_no int, page int, text string")
    versions = {s: segment.chunk_documents(d, s).first()["parser_version"] for s in ("EXACT", "sentence", "nonsense", "character-based")}
    assert versions == {"EXACT": "tiktoken-exact-1.0", "sentence": "tiktoken-sentence-1.0", "nonsense": "tiktoken-paragraph-1.0", "character-based": "character-based-1.0"}
    assert segment.step_of(1, 5) == 1 and segment.step_of(10, 4) == 6
    assert segment.chunk_documents(d.limit(0)).count() == 0


def test_pages(spark):
    d = spark.createDataFrame([("a", "p1a\np1b\n\fp2a"), ("b", None), ("c", "x\n\ny")], "id string, t string")
    got = [(r["id"], r["page"], r["text"]) for r in lines.split_pages(d, "id", "t").orderBy("id", "line_no").collect()]
    assert got == [("a", 1, "p1a"), ("a", 1, "p1b"), ("a", 2, "p2a"), ("c", 1, "x"), ("c", 1, ""), ("c", 1, "y")]


def test_running_lines(spark):
    rows = [("d", p * 3 + k, p + 1, t) for p in range(3) for k, t in enumerate(["ACME Report", f"body {p}", "Page"])]
    one = [("e", i, 1, "ACME Report") for i in range(3)]
    d = spark.createDataFrame(rows + one, "document_id string, line_no int, page int, text string")
    got = lines.remove_running_lines(d).groupBy("document_id", "text").count().collect()
    assert {(r["document_id"], r["text"]): r["count"] for r in got} == {("d", "body 0"): 1, ("d", "body 1"): 1, ("d", "body 2"): 1, ("d", "Page"): 3, ("e", "ACME Report"): 3}


def test_boilerplate(spark):
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a long paragraph", "another long one", "a  LONG paragraph", "short", "short"])], "doc_id int, para_no int, text string")
    assert [r["text"] for r in lines.drop_boilerplate(d).orderBy("para_no").collect()] == ["another long one", "short", "short"]


def test_structure():
    got = structure.elements("# H\n\npara\n\n- a\n\n1. x")
    assert [(t, s, h, lv, n) for t, s, h, lv, n in got] == [("HEADING", "H", "H", 1, 1), ("PARAGRAPH", "para", "H", 0, 2), ("BULLET_LIST", "a", "H", 0, 3), ("NUMBERED_LIST", "x", "H", 0, 4)]
    code = structure.elements("```py\na\nb\n```\nafter")
    assert code[0][0] == "CODE_BLOCK" and code[0][1] == "a\nb\n" and code[1][4] == 3
    assert structure.elements("Title\n===\ntext")[0] == ("HEADING", "Title", "Title", 1, 1)
    assert structure.elements("  ") == [] and structure.elements(None) == []


def test_upsert_keeps_id_and_takes_content(spark):
    s = "id string, hash string, embedding array<float>, model_version string, dimensions int, created_at timestamp"
    ts = "2030-01-0{} 00:00:00"
    old = spark.createDataFrame([("v1", "h1", [1.0], "m1", 1, ts.format(1)), ("v9", "", [1.0], "m1", 1, ts.format(1))], s.replace("timestamp", "string")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    new = spark.createDataFrame([("v2", "h1", [2.0], "m2", 1, ts.format(2)), ("v3", "h2", [3.0], "m2", 1, ts.format(2)), ("v4", "h2", [4.0], "m2", 1, ts.format(3))], s.replace("timestamp", "string")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    up = store.upsert_vectors(old, new)
    assert {(r["id"], r["hash"], r["embedding"][0], r["model_version"]) for r in up.collect()} == {("v1", "h1", 2.0, "m2"), ("v3", "h2", 4.0, "m2")}
    again = store.upsert_vectors(up, new)
    assert {(r["id"], r["hash"], r["embedding"][0]) for r in again.collect()} == {("v1", "h1", 2.0), ("v3", "h2", 4.0)}
    c = spark.createDataFrame([("c1", "h1", "v2"), ("c2", "zz", "v7")], "id string, hash string, vector_id string")
    assert {(r["id"], r["vector_id"]) for r in store.surviving_ids(up, c).collect()} == {("c1", "v1"), ("c2", "v7")}


def test_dedup(spark):
    u = spark.createDataFrame([("a", "t", "x"), ("b", "t", "x"), ("c", "t2", "x"), ("d", "t", None), ("e", "t", None)], "id string, tenant_id string, checksum string")
    assert {r["id"] for r in dedup.new_documents(u, None, ["id"]).collect()} == {"a", "c", "d", "e"}
    known = spark.createDataFrame([("t", "x")], "tenant_id string, checksum string")
    assert {r["id"] for r in dedup.new_documents(u, known, ["id"]).collect()} == {"c", "d", "e"}
    c = spark.createDataFrame([("1", "h"), ("2", "h"), ("3", "k"), ("4", ""), ("5", "")], "id string, hash string")
    v = spark.createDataFrame([("v", "k")], "id string, hash string")
    dup, fresh = dedup.split_duplicates(dedup.dedup_chunks(c, v, ["id"]))
    assert {r["id"] for r in fresh.collect()} == {"1", "4", "5"} and {r["id"] for r in dup.collect()} == {"2", "3"}


def test_search(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], 2, "m"), ("b", [0.6, 0.8], 2, "m"), ("z", [0.0, 0.0], 2, "m"), ("n", [float("nan"), 1.0], 2, "m"), ("s", [1.0], 2, "m"), ("o", None, 2, "m")], "id string, embedding array<float>, dimensions int, model_version string")
    c = spark.createDataFrame([(f"c{x}", x, "d1" if x == "a" else "missing", 0, "t", None if x == "b" else "q") for x in "abznso"], "id string, vector_id string, document_id string, chunk_index int, content string, tenant string")
    c = c.withColumn("metadata", F.struct(F.col("tenant").alias("tenant_id"))).withColumn("created_at", F.lit(None).cast("timestamp"))
    d = spark.createDataFrame([("d1", "n", "k", "ten")], "id string, name string, file_key string, tenant_id string")
    got = search.search(c, v, d, [1.0, 0.0]).collect()
    assert [(r["chunk_id"], r["similarity"], r["document_name"]) for r in got] == [("ca", 1.0, "n"), ("cb", 0.6, "")]
    assert [r["chunk_id"] for r in search.search(c, v, d, [1.0, 0.0], tenant="ten").collect()] == ["ca"]
    assert [r["chunk_id"] for r in search.search(c, v, d, [1.0, 0.0], min_similarity=0.7).collect()] == ["ca"]
    assert "TakeOrderedAndProject" in search.search(c, v, d, [1.0, 0.0])._jdf.queryExecution().toString()


def test_exact_neighbours(spark):
    r = np.random.default_rng(0)
    m = r.standard_normal((60, 5))
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id bigint, embedding array<float>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = search.exact_neighbours(e.filter("id % 7 = 0"), e, 3, block=4, shard_rows=20).collect()
    for q in range(0, 60, 7):
        assert [int(x["row_id"]) for x in sorted((x for x in got if x["query_id"] == str(q)), key=lambda x: x["rank"])] == np.argsort(-s[q])[:3].tolist()


def test_near_duplicates_find_every_link(spark):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    base = [[words[j] for j in r.integers(0, 300, 60)] for _ in range(12)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:58], "x", "y"]) for b in base[:6]] + [" ".join(base[0]).upper(), "", None, "   "]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    sh = lambda t: {" ".join(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    true = {(a, b) for a in range(18) for b in range(a + 1, 18) if len(sh(texts[a]) & sh(texts[b])) / len(sh(texts[a]) | sh(texts[b])) >= 0.8}
    assert {(x["id_a"], x["id_b"]) for x in lsh.similar_pairs(d.filter("id < 18"), "id", "t").collect()} == true and len(true) == 6
    got = {x["id"]: (x["class_id"], x["links"]) for x in lsh.near_duplicate_classes(d, "id", "t").collect()}
    assert got[18] == got[0] == got[12] == (0, 1) and got[11] == (11, 0) and set(got) == set(range(19))
    near = {x["id"]: x["near_id"] for x in lsh.probe(lsh.buckets(lsh.signatures(d, "id", "t"))).collect()}
    assert all(near.get(b) == a for a, b in true)


def test_components_of_a_long_chain(spark):
    p = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "id_a int, id_b int")
    got = {r["id"]: r["component"] for r in lsh.connected(p).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100


def test_providers(spark):
    d = spark.createDataFrame([("The cat of the house is on the mat",), (None,), ("Die Katze ist auf der Matte und das Haus",), ("猫は家にいる",)], "t string")
    assert {r["t"]: r["language"] for r in providers.apply_provider(d, "language", "t", "language", batch=2).collect()} == {"The cat of the house is on the mat": "en", None: None, "Die Katze ist auf der Matte und das Haus": "de", "猫は家にいる": "ja"}
    e = providers.embed(d, "t", dimensions=64).collect()
    assert all(r["dimensions"] == 64 for r in e if r["t"]) and next(r for r in e if r["t"] is None)["embedding"] is None
    calls = []

    def flaky(x):
        calls.append(len(x))
        if len(calls) < 3:
            raise OSError("busy")
        return [1] * len(x)

    assert providers.call_with_retry(flaky, [1, 2], pause=0) == [1, 1] and len(calls) == 3
    with pytest.raises(ValueError):
        providers.call_with_retry(lambda x: [], [1], pause=0)
    with pytest.raises(KeyError):
        providers.provider("embedder", "none")
    assert providers.default_entities(["He met Anna Berg at Acmeon Inc yesterday."]) == [[("Acmeon Inc", "ORG"), ("Anna Berg", "PERSON")]]


def test_metrics(spark):
    d = spark.createDataFrame([("a", 0.5), ("a", 7.0), ("b", None)], "k string, v double")
    assert {(r["k"], r["requests"]) for r in metrics.counters(d, ["k"]).collect()} == {("a", 2), ("b", 1)}
    assert {(r["bucket"], r["n"], r["upper_edge"]) for r in metrics.latency_histogram(d, "v", [1.0, 5.0]).collect()} == {(0, 1, 1.0), (2, 1, None)}
    o, seen = metrics.observed(d, "stage", nulls=F.count_if(F.col("v").isNull()))
    o.collect()
    assert seen.get == {"rows": 3, "nulls": 1}
    assert metrics.health(spark).first()["status"] == "ok"


TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def test_bpe_windows(spark):
    import os

    d = spark.createDataFrame([("d", i, 1, f"word{i} and more words of the line") for i in range(60)], "document_id string, line_no int, page int, text string")
    broken = segment.chunk_documents(d, "exact", ranks_file="/nowhere")
    assert broken.first()["parser_version"] == "paragraph-1.0"
    if not os.path.exists(TOKENIZER):
        pytest.skip("no vocabulary here")
    whole = segment.chunk_documents(d, "exact", 10_000, 20, ranks_file=TOKENIZER).collect()
    parts = segment.chunk_documents(d, "exact", 100, 20, ranks_file=TOKENIZER).orderBy("chunk_index").collect()
    enc = segment.load_bpe(open(TOKENIZER, "rb").read())
    tok = enc.encode_ordinary(whole[0]["content"])
    assert len(whole) == 1 and [enc.encode_ordinary(p["content"]) for p in parts][0] == tok[:100]
    assert "".join(enc.decode(tok[80 * k : 80 * k + (80 if k + 1 < len(parts) else 100)]) for k in range(len(parts))) == whole[0]["content"]


def test_ttl(spark):
    d = spark.sql("select * from values ('a', timestamp'2030-01-01'), ('b', timestamp'2030-01-09'), ('c', cast(null as timestamp)) t(hash, created_at)")
    assert [r["hash"] for r in dedup.within_ttl(d, "2030-01-10 00:00:00").collect()] == ["b"]


def test_stored_objects(spark, tmp_path):
    from inkgrid.sources import files

    o = spark.createDataFrame([("k1", bytearray(b"x")), ("k1", bytearray(b"x")), ("k2", bytearray(b"y"))], "file_key string, content binary")
    files.write_objects(o, str(tmp_path / "objects"))
    assert files.stored_objects(spark, str(tmp_path / "objects")).count() == 2
    assert [bytes(r["content"]) for r in files.stored_objects(spark, str(tmp_path / "objects"), o.filter("file_key = 'k2'")).collect()] == [b"y"]


def test_batches_of_several_tables_are_read_together_or_not_at_all(spark, tmp_path):
    a, b = spark.createDataFrame([("a1",), ("a2",)], "id string"), spark.createDataFrame([("b1",)], "id string")
    for _ in range(2):
        store.publish_together({"a": a, "b": b}, str(tmp_path), 1)
    store.publish(a.limit(1), f"{tmp_path}/a", 2)  # a batch that broke off before its mark
    assert store.read_together(spark, str(tmp_path), "a", "id string").count() == 2
    assert store.read_together(spark, str(tmp_path), "b", "id string").count() == 1


def test_statistics_of_a_text(spark):
    from inkgrid.functions import text as T

    d = spark.createDataFrame([("  Ab 12 c\u3000\u00e9 ",), ("",), (None,), ("\u5b57" * 3,), ("x" * 100_000,)], "t string")
    got = [tuple(r["s"]) for r in d.select(T.text_stats(F.col("t")).alias("s")).collect()]
    assert got[0][:6] == (12, 9, 4, 4, 2, 1) and got[1] == (0, 0, 0, 0, 0, 0, 0.0) and got[2] == (None,) * 7
    assert got[3] == (9, 3, 1, 3, 0, 0, 0.0) and got[4][1] == 100_000


def test_index_entries_are_renewed_when_seen(spark):
    index = spark.createDataFrame([("a", "2030-01-01"), ("b", "2030-01-01")], "hash string, t string").select("hash", F.col("t").cast("timestamp").alias("created_at"))
    seen = spark.createDataFrame([("a",), ("a",), ("c",), ("",), (None,)], "hash string")
    got = {r["hash"]: str(r["created_at"])[:10] for r in dedup.refresh(index, seen, "2030-01-07 00:00:00").collect()}
    assert got == {"a": "2030-01-07", "b": "2030-01-01", "c": "2030-01-07"}
    assert {r["hash"] for r in dedup.within_ttl(dedup.refresh(index, seen, "2030-01-07 00:00:00"), "2030-01-09 00:00:00").collect()} == {"a", "c"}


def test_a_slow_provider_fails_in_time():
    import time

    with pytest.raises(TimeoutError):
        providers.call_with_retry(lambda b: time.sleep(5) or b, [1], attempts=2, pause=0.01, timeout=0.05)
    assert providers.call_with_retry(lambda b: b, [1, 2], timeout=5) == [1, 2]

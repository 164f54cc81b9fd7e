from pyspark.sql import functions as F

from inkgrid import schemas
from inkgrid.config import EngineConfig
from inkgrid.plans import pipeline

TEXT = ["The night operator counted the tenant settings during the nightly run and the parser stored them.", "", "A second paragraph of the document names the shipping manifest and the glossary of terms."]


def test_from_upload_to_answer(spark):
    up = spark.createDataFrame([("t", "one", None, None, bytearray("\n".join(TEXT).encode())), ("t", "copy", None, None, bytearray("\n".join(TEXT).encode()))], "tenant_id string, name string, description string, content_type string, content binary")
    docs, events, rejected = pipeline.ingest(up, None, "2030-01-01 00:00:00")
    assert docs.count() == events.count() == 1 and rejected.count() == 0
    assert pipeline.ingest(up, docs, "2030-01-02 00:00:00")[0].count() == 0
    doc = docs.first()["id"]
    lines = spark.createDataFrame([(doc, i, 1, t) for i, t in enumerate(TEXT)] + [("other", i, 1, t) for i, t in enumerate(TEXT)] + [("bad", 0, 1, "zz")], schemas.LINES)
    cfg = EngineConfig(chunk_budget=10, chunk_overlap=2)
    none = spark.createDataFrame([], schemas.VECTORS)
    vectors, chunks = pipeline.process(lines, none, spark.createDataFrame([], "document_id string, chunk_index int"), cfg, "2030-01-01 00:00:00")
    vectors, chunks = vectors.cache(), chunks.cache()
    assert vectors.count() == 2 and chunks.count() == 4 and chunks.select("vector_id").distinct().count() == 2
    assert chunks.filter("keywords is not null").count() == 2
    again_v, again_c = pipeline.process(lines, vectors, chunks.select("document_id", "chunk_index"), cfg, "2030-01-02 00:00:00")
    assert again_c.count() == 0 and {r["id"] for r in again_v.collect()} == {r["id"] for r in vectors.collect()}
    c = chunks.withColumn("metadata", F.struct(F.lit("t").alias("tenant_id")))
    hits = pipeline.answer("glossary of terms and the shipping manifest", c, vectors, docs, cfg, min_similarity=0.2).collect()
    assert hits and "glossary" in hits[0]["content"]


def test_near_duplicates_of_new_chunks(spark):
    a = "the night operator counted the tenant settings during the nightly run and the parser stored them all in the archive of the office"
    c = spark.createDataFrame([("c1", a), ("c2", a + " again"), ("c3", "something else that nobody has written before in any of these many texts")], "id string, content string")
    index = spark.createDataFrame([], "band int, bucket_key string, id string")
    off, none = pipeline.near_duplicates(c, index, EngineConfig())
    assert off.filter("near_id is not null").count() == 0 and none.count() == 0
    cfg = EngineConfig(enrich_duplicates=True)
    first, rows = pipeline.near_duplicates(c, index, cfg)
    assert {r["id"]: r["near_id"] for r in first.collect()} == {"c1": None, "c2": "c1", "c3": None} and rows.count() == 3 * 16
    again, _ = pipeline.near_duplicates(spark.createDataFrame([("n1", a)], "id string, content string"), rows, cfg)
    assert again.first()["near_id"] == "c1"

from inkgrid import core_queries
from inkgrid.functions.text import fnv1a64_value


def test_fnv_hash_of_whole_texts(spark, tmp_path):
    texts = {1: "a short text", 2: "Größe 字 " * 5000, 3: "", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["hash"] for r in core_queries.fnv_hash(spark, str(tmp_path)).collect()}
    assert got == {k: str(fnv1a64_value(v.encode())) for k, v in texts.items() if v is not None}

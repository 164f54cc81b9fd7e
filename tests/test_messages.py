from pyspark.sql import functions as F

from inkgrid.operators import messages

U = "01b8dbcb-aeb8-74f3-96c8-44a1c82bdef7"
S = "event_id string, document_id string, delivery_seq bigint, received_at timestamp, message_key string, extra int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, i) for i, r in enumerate(rows)], S)


def test_one_of_each_message(spark):
    rows = [(U, "a", 5), (U.upper(), "b", 3), ("{" + U + "}", "c", 9), ("urn:uuid:" + U, None, 4), (f" {U} ", "d", 8), (U.replace("-", ""), "e", 7), ("x", "f", 1), ("x", "f", 2), ("", "g", 10), (None, "h", 11), ("  ", "i", 12)]
    d = frame(spark, rows)
    kept = messages.keep_one(d)
    assert sorted(r["delivery_seq"] for r in kept.collect()) == [1, 3, 10, 11, 12]
    assert sorted(r["delivery_seq"] for r in messages.keep_one(d, keep_unidentified=False).collect()) == [1, 3]
    assert sorted(r["delivery_seq"] for r in messages.repeated_deliveries(d).collect()) == [2, 4, 5, 7, 8, 9]


def test_ties_nulls_and_empty(spark):
    d = frame(spark, [("x", "b", 1), ("x", "a", 1), ("x", "a", 1), ("x", "z", None), ("y", None, None)])
    a = messages.keep_one(d).select("event_id", "document_id", "delivery_seq", "extra").collect()
    b = messages.keep_one(d.orderBy(F.desc("extra"))).select("event_id", "document_id", "delivery_seq", "extra").collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) == 2
    assert messages.keep_one(d.limit(0)).count() == 0 and messages.repeated_deliveries(d.limit(0)).count() == 0


def test_hot_message(spark):
    d = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(U)).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("event_id"), F.lit("d").alias("document_id"), F.col("id").alias("delivery_seq"), F.lit(None).cast("timestamp").alias("received_at"))
    assert messages.keep_one(d).count() == 20_001
    assert messages.repeated_deliveries(d).count() == 9_999


def test_columns_of_any_name_are_kept(spark):
    rows = [(U, 1, "2030-01-01", "x", 1, 2, 3, 4), (U.upper(), 2, "2030-01-02", "y", 5, 6, 7, 8), (U, 1, "2030-01-01", "x", 1, 2, 3, 4)]
    d = spark.createDataFrame(rows, "event_id string, delivery_seq bigint, received_at string, _o string, _order0 int, _key0 int, _first0 int, _written0 int")
    got = messages.keep_one(d).collect()
    assert len(got) == 1 and (got[0]["_o"], got[0]["_order0"], got[0]["_key0"], got[0]["_first0"], got[0]["_written0"]) == ("x", 1, 2, 3, 4)

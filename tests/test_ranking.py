from pyspark.sql import functions as F

from inkgrid.operators.ranking import sharded_position


def test_ranks_and_sums_match_a_plain_window(spark):
    d = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5).alias("g"), (F.col("id") % 11).alias("v"))
    r = sharded_position(d, ["g"], F.xxhash64("id"), ["id"], value="v", shards=7).collect()
    groups = {}
    for x in r:
        groups.setdefault(x["g"], []).append((x["rank"], x["v"], x["v_before"]))
    for rows in groups.values():
        rows.sort()
        assert [a for a, _, _ in rows] == list(range(len(rows)))
        total = 0
        for _, v, before in rows:
            assert before == total
            total += v
    assert len(r) == 5000


def test_empty(spark):
    d = spark.range(0).select("id", F.lit(1).alias("g"))
    assert sharded_position(d, ["g"], F.xxhash64("id"), ["id"]).count() == 0

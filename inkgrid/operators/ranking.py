"""Row numbers and running sums inside groups of any size.

A plain window over a group runs in one task; with a third of all rows in a group that task never ends. Here each
group is cut into shards by a hash of the row's key, windows run inside the shards, and the small table of shard
totals gives each shard its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sharded_position(df: DataFrame, group: list[str], order_hash: Column, tie: list[str], value: str | None = None, shards: int | None = None, rank: str = "rank", total: str | None = None) -> DataFrame:
    """Adds to each row its 0-based rank in its group (and, with ``value``, the sum of value over the rows before it).

    The order is that of ``order_hash`` (a bigint), ties by the columns of ``tie``: shards are ranges of the
    hash, so the order over shards is the order of the hash. Null group values form a group. A null ``value`` counts 0.
    There are four shards for each shuffle partition of the session unless ``shards`` says otherwise, so they grow with what a
    cluster is set up for; the result does not depend on their number.
    """
    shards = shards or max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shard = F.shiftrightunsigned(order_hash, 33)  # 31 bits, not negative
    d = df.withColumn("_oh", F.shiftrightunsigned(order_hash, 1)).withColumn("_shard", F.floor(shard * F.lit(shards) / F.lit(1 << 31)).cast("int"))
    keys = [*group, "_shard"]
    w = Window.partitionBy(*keys).orderBy("_oh", *tie)
    d = d.withColumn("_in", F.row_number().over(w) - 1)
    sums = [F.count("*").alias("_n")]
    if value:
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        d = d.withColumn("_sum_in", F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0))).over(before), F.lit(0)))
        sums.append(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("_v"))
    totals = df.withColumn("_shard", F.floor(shard * F.lit(shards) / F.lit(1 << 31)).cast("int")).groupBy(*keys).agg(*sums)
    past = Window.partitionBy(*group).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    off = totals.withColumn("_on", F.coalesce(F.sum("_n").over(past), F.lit(0)))
    if value:
        off = off.withColumn("_ov", F.coalesce(F.sum("_v").over(past), F.lit(0)))
    keep = off.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_on", *(["_ov"] if value else []))
    cond = None
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        cond = c if cond is None else cond & c
    out = d.join(keep, cond, "left").withColumn(rank, (F.col("_in") + F.col("_on")).cast("bigint"))
    if value:
        out = out.withColumn(total or f"{value}_before", (F.col("_sum_in") + F.col("_ov")).cast("bigint"))
    return out.drop("_oh", "_shard", "_in", "_sum_in", "_on", "_ov", *[f"_k{i}" for i in range(len(keys))])

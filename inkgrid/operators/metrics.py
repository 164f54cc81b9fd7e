"""Counters, latency histograms and run observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import providers


def counters(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Requests by label values; null is a value of its own."""
    return df.groupBy(*labels).agg(F.count("*").alias("requests"))


def latency_histogram(df: DataFrame, value: str, edges: Sequence[float], labels: Sequence[str] = ()) -> DataFrame:
    """(labels, bucket, upper_edge, n, total): values by the first edge they do not exceed; the last bucket has no edge. Nulls are left out."""
    b = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        b = F.when(F.col(value) <= edges[i], F.lit(i)).otherwise(b)
    d = df.filter(F.col(value).isNotNull()).withColumn("bucket", b)
    upper = F.get(F.array(*[F.lit(float(e)) for e in edges]), F.col("bucket"))
    return d.groupBy(*labels, "bucket").agg(F.count("*").alias("n"), F.sum(value).alias("total")).withColumn("upper_edge", upper)


def observed(df: DataFrame, name: str, **measures) -> tuple[DataFrame, Observation]:
    """df with counts that are filled in while it runs: the counts of a stage without a second pass."""
    o = Observation(name)
    return df.observe(o, F.count("*").alias("rows"), *[c.alias(k) for k, c in measures.items()]), o


def health(spark) -> DataFrame:
    """One row: the session answers, and which providers there are."""
    p = [f"{k}:{n}" for k, n in providers.available()]
    return spark.range(1).select(F.lit("ok").alias("status"), F.lit(spark.version).alias("spark"), F.array(*[F.lit(x) for x in p]).alias("providers"))

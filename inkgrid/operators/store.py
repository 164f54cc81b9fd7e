"""Tables on files: upserts, idempotent appends and lookups without a transactional format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert_vectors(existing: DataFrame, incoming: DataFrame, seq: str = "created_at") -> DataFrame:
    """One row for each hash: the id of the earliest row, the other columns of the latest.

    Stored rows come before incoming ones; within a side the order is by ``seq`` and id. Rows without a hash are dropped.
    """
    both = existing.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1))).filter(F.length("hash") > 0)
    o = F.struct("_side", F.col(seq), "id")
    g = both.groupBy("hash").agg(F.min_by("id", o).alias("id"), F.max_by(F.struct("embedding", "model_version", "dimensions", "created_at"), o).alias("v"))
    return g.select("id", "hash", "v.*")


def surviving_ids(upserted: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose vector_id is that of the surviving vector of their hash; others keep theirs."""
    ids = upserted.select("hash", F.col("id").alias("_vid"))
    return chunks.join(ids, "hash", "left").withColumn("vector_id", F.coalesce("_vid", "vector_id")).drop("_vid")


def append_chunks(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming chunks that are not stored yet by (document_id, chunk_index); of repeated ones the earliest by created_at and id."""
    row = F.struct(*[F.col(f"`{c}`") for c in incoming.columns])
    once = incoming.groupBy("document_id", "chunk_index").agg(F.min_by(row, F.struct("created_at", "id")).alias("r")).select("r.*")
    return once.join(existing.select("document_id", "chunk_index"), ["document_id", "chunk_index"], "left_anti").select(*incoming.columns)


def point_lookup(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with a value, at most one; the filter reaches the scan."""
    return df.filter(F.col(column) == F.lit(value)).limit(1)


def document_by_checksum(documents: DataFrame, checksum: str, tenant: str = "") -> DataFrame:
    """The stored document of a content hash (of a tenant, unless that is empty); nothing for an empty hash."""
    d = documents.filter(F.lit(bool(checksum)) & (F.col("checksum") == F.lit(checksum)))
    return (d.filter(F.col("tenant_id") == F.lit(tenant)) if tenant else d).orderBy("created_at", "id").limit(1)


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """The latest row of each key, of the columns that df has: select what is needed before. Ties are broken by the row's content.

    Rows shrink on the map side, so a key with very many rows leaves each task as one.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    return df.groupBy(F.col(f"`{key}`").alias("_k")).agg(F.max_by(F.struct(*cols), F.struct(F.col(f"`{by}`"), F.xxhash64(*cols))).alias("_r")).select("_r.*")


def publish(df: DataFrame, path: str, batch_id: int | str) -> str:
    """Writes a batch into its own folder, replacing what an earlier attempt of the same batch left there: all or nothing, and a
    replay changes nothing. Readers read the folders of all batches."""
    to = f"{path}/batch={batch_id}"
    df.write.mode("overwrite").parquet(to)
    return to


def publish_together(tables: dict[str, DataFrame], path: str, batch_id: int | str) -> None:
    """Writes the batches of several tables as one transaction: readers see all of them or none.

    Every table's rows go to a folder of the batch first; the batch counts once its mark, written last, is there. A replay replaces
    folders and mark and changes nothing.
    """
    for name, df in tables.items():
        publish(df, f"{path}/{name}", batch_id)
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(str(batch_id), ",".join(sorted(tables)))], "batch string, tables string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_committed_batches/batch={batch_id}")


def read_together(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The rows of a table in all batches whose transaction was completed."""
    rows = spark.read.option("basePath", f"{path}/{name}").schema(schema + ", batch string").parquet(f"{path}/{name}")
    marks = spark.read.schema("tables string, batch string").option("basePath", f"{path}/_committed_batches").parquet(f"{path}/_committed_batches/batch=*")
    done = marks.filter(F.array_contains(F.split("tables", ","), name)).select("batch")
    return rows.join(F.broadcast(done), "batch", "left_semi").drop("batch")  # one row per batch

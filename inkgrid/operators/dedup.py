"""Exact duplicates: documents by checksum, chunks by canonical hash, inside a batch and against what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an order, all columns; rows with a null key are not compared and stay.

    ``min_by`` combines on the map side, so a key with very many rows is no bottleneck.
    """
    known = df.filter(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 0)
    row, o = F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*[F.col(c) for c in order])
    first = known.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, o).alias("_r")).select("_r.*")
    rest = df.filter(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 1)
    return first.unionByName(rest)


def new_documents(uploads: DataFrame, existing: DataFrame | None, order: list[str], tenant: str = "tenant_id", checksum: str = "checksum") -> DataFrame:
    """Uploads whose content the tenant does not have: the first of the batch by order, minus the stored ones."""
    first = first_by(uploads, [tenant, checksum], order)
    if existing is None:
        return first
    known = existing.filter(F.col(checksum).isNotNull()).select(F.col(tenant).alias("_t"), F.col(checksum).alias("_c")).distinct()
    return first.join(known, (F.col(tenant) == F.col("_t")) & (F.col(checksum) == F.col("_c")), "left_anti")


def semi(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the keys (an IN list of any size)."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def anti(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def dedup_chunks(chunks: DataFrame, vectors: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``known_vector_id`` (of a stored vector with the chunk's hash) and ``first_id`` (the first chunk of the batch with it).

    A chunk needs a new vector if no vector is known and it is the first of its hash; blank hashes are never duplicates.
    """
    v = vectors.filter(F.length("hash") > 0).groupBy("hash").agg(F.min("id").alias("known_vector_id"))
    first = chunks.filter(F.length("hash") > 0).groupBy("hash").agg(F.min_by("id", F.struct(*order)).alias("first_id"))
    c = chunks.join(v, "hash", "left").join(first, "hash", "left")
    return c.withColumn("first_id", F.coalesce("first_id", "id"))


def split_duplicates(deduped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(duplicates, to embed) of :func:`dedup_chunks`' rows."""
    fresh = F.col("known_vector_id").isNull() & (F.col("first_id") == F.col("id"))
    return deduped.filter(~fresh), deduped.filter(fresh)


def recent_hashes(vectors: DataFrame, n: int = 10_000) -> DataFrame:
    """The n latest non-empty hashes; planned as a top-n, never a full sort."""
    return vectors.filter(F.length("hash") > 0).select("hash", "id", "created_at").orderBy(F.desc("created_at"), "hash", "id").limit(n)


def within_ttl(index: DataFrame, at: str, days: int = 7, seen: str = "created_at") -> DataFrame:
    """The entries of an index seen within the last days before a moment; older ones have expired. A null time has expired."""
    t = F.lit(at).cast("timestamp")
    return index.filter((F.col(seen) > t - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col(seen) <= t))


def refresh(index: DataFrame, seen: DataFrame, at: str, key: str = "hash", time: str = "created_at") -> DataFrame:
    """(key, time): the index with the entries seen now renewed or added, each once with its latest time. Null and empty keys are no entries."""
    now = seen.select(key, F.lit(at).cast("timestamp").alias(time))
    return index.select(key, time).unionByName(now).filter(F.length(key) > 0).groupBy(key).agg(F.max(time).alias(time))

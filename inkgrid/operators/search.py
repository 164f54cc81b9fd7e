"""Thresholded, tenant-aware similarity search and exact nearest neighbours of a stated set of queries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import latest


def usable(embedding: Column, dimensions: Column | None = None) -> Column:
    """Whether an embedding can be compared: not null or all zero, only finite values, of its stated length."""
    ok = embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(embedding, lambda x: x != 0)
    return ok & (F.size(embedding) == dimensions) if dimensions is not None else ok


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(embedding: Column, query: Sequence[float]) -> Column:
    """Cosine similarity in double precision with a literal query; its norm is computed once, here."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = float(np.sqrt(sum(float(x) * float(x) for x in query)))
    return dot(embedding, q) / (F.sqrt(dot(embedding, embedding)) * F.lit(norm))


def _once(df: DataFrame, key: str, at: str, *columns: str | Column) -> DataFrame:
    """These columns of the latest row of each key, and its time as ``_at``; a table without the time column has none to go by."""
    time = F.col(at) if at in df.columns else F.lit(None).cast("timestamp")
    return latest(df.select(*columns, time.alias("_at")), key, "_at")


def search(chunks: DataFrame, vectors: DataFrame, documents: DataFrame, query: Sequence[float], top_k: int = 10, min_similarity: float = 0.18, tenant: str = "", metadata_equals: dict[str, str] | None = None, model_version: str | None = None) -> DataFrame:
    """The top_k chunks by similarity to a query vector, with their document's name and file key (empty if it is missing).

    top_k <= 0 means 10, min_similarity <= 0 means 0.18. Of repeated rows of a vector, chunk or document the latest counts. Vectors that
    cannot be compared (other length, null, zero, not finite) take no part. Similarities are compared unrounded; ties go to the smaller id.

    Vectors are scored in the scan; what moves is an id, a time and a score. Only hits are joined to the narrow columns of chunks and
    documents, and texts and metadata are fetched for the top_k at the end.
    """
    top_k = top_k if top_k > 0 else 10
    min_similarity = min_similarity if min_similarity > 0 else 0.18
    e = F.col("embedding")
    score = F.when(usable(e) & (F.size(e) == len(query)), cosine(e, query))
    v = _once(vectors, "vector_id", "created_at", F.col("id").alias("vector_id"), "model_version", score.alias("_score")).filter(F.col("_score") >= min_similarity)
    if model_version is not None:
        v = v.filter(F.col("model_version") == model_version)
    meta = metadata_equals or {}
    fields = [F.col(f"metadata.{k}").cast("string").alias(f"_m{i}") for i, k in enumerate(meta)]
    c = _once(chunks, "id", "created_at", "id", "document_id", "vector_id", F.col("metadata.tenant_id").alias("_t"), *fields)
    x = c.drop("_at").join(v.drop("_at"), "vector_id")
    for i, val in enumerate(meta.values()):
        x = x.filter(F.col(f"_m{i}") == F.lit(val))
    d = _once(documents, "document_id", "updated_at", F.col("id").alias("document_id"), F.col("name").alias("_name"), F.col("file_key").alias("_key"), F.col("tenant_id").alias("_tenant"))
    x = x.join(d.drop("_at"), "document_id", "left")
    if tenant:
        x = x.filter((F.col("_t") == tenant) | (F.col("_tenant") == tenant))
    top = x.orderBy(F.desc("_score"), "id").limit(top_k).select(F.col("id").alias("_id"), "model_version", F.coalesce("_name", F.lit("")).alias("document_name"), F.coalesce("_key", F.lit("")).alias("file_key"), "_score")
    wanted = chunks.join(F.broadcast(top.select("_id")), F.col("id") == F.col("_id"), "left_semi")  # at most top_k ids
    full = _once(wanted, "id", "created_at", *[F.col(f"`{x}`") for x in chunks.columns if x != "created_at"])
    out = full.join(F.broadcast(top), F.col("id") == F.col("_id")).select(
        F.col("id").alias("chunk_id"), "document_id", "document_name", "file_key", "vector_id", F.col("chunk_index").alias("index"), "content",
        F.round("_score", 6).alias("similarity"), "model_version", "metadata", "_at", "_score",
    )
    return out.withColumnRenamed("_at", "created_at").orderBy(F.desc("_score"), "chunk_id").drop("_score")


def exact_neighbours(queries: DataFrame, rows: DataFrame, k: int, block: int = 1024, shard_rows: int = 100_000) -> DataFrame:
    """(query_id, row_id, similarity, rank): the k most similar rows of each query, by comparing all, in blocks.

    ``queries`` and ``rows``: id, embedding (unit length or not). Queries go in blocks of about ``block`` to shards of about ``shard_rows``
    rows, as many as there are rows for; every (block, shard) is one matrix product that leaves k rows a query, so memory is bounded by block
    and shard and the result by k. A row is not its own neighbour.
    """
    n_blocks = max(1, -(-queries.count() // block))
    shards = max(1, -(-rows.count() // shard_rows))
    q = queries.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("e"), F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"))
    r = rows.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("e"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"))

    def matrix(t: pa.Table) -> np.ndarray:
        flat = t.column("e").combine_chunks().values.to_numpy(zero_copy_only=False).astype(np.float64)
        x = flat.reshape(t.num_rows, -1)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.string()), ("row_id", pa.string()), ("similarity", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        b = b.take(pa.array(np.argsort(np.array(b.column("id").to_pylist(), object), kind="stable")))  # a tie then goes to the earlier row
        qi, ri = a.column("id").to_pylist(), np.array(b.column("id").to_pylist(), object)
        s = np.round(matrix(a) @ matrix(b).T, 6)
        some = min(k + 1, s.shape[1])
        out_q, out_r, out_s = [], [], []
        for i, name in enumerate(qi):
            least = np.partition(s[i], -some)[-some]
            near = np.flatnonzero(s[i] >= least)
            o = [j for j in near[np.argsort(-s[i][near], kind="stable")] if ri[j] != name][:k]
            out_q += [name] * len(o)
            out_r += [ri[j] for j in o]
            out_s += [float(s[i, j]) for j in o]
        return pa.table({"query_id": out_q, "row_id": out_r, "similarity": out_s}, schema=schema)

    pairs = q.groupBy("b", "s").cogroup(r.groupBy("b", "s")).applyInArrow(product, "query_id string, row_id string, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "row_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def response(results: DataFrame) -> DataFrame:
    """The count of the results that a response states."""
    return results.agg(F.count("*").alias("total"))

"""The three entry points end to end: ingestion, document pipeline, query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text as T
from ..operators import dedup, keywords, lines, lsh, providers, quality, search, segment, store
from ..runtime import cut
from ..sources import files


def ingest(uploads: DataFrame, existing: DataFrame | None, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, events, rejected) of uploads (tenant_id, name, description, content_type, content): new content only."""
    ok, rejected = files.validate_uploads(uploads)
    new = dedup.new_documents(ok, existing, ["name", "id"])
    t = F.lit(at).cast("timestamp")
    docs = new.select("id", "tenant_id", "name", "description", "file_key", "file_size", "content_type", "checksum", F.lit("INGESTED").alias("status"), t.alias("created_at"), t.alias("updated_at"))
    return docs, files.document_events(docs), rejected


def enrich(chunks: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Normalised content, score, profile, keywords, entities and language; chunks below the threshold and empty ones go."""
    n = chunks.withColumn("normalized", T.normalize_text(F.col("content"))).filter(F.length("normalized") > 0)
    s = n.withColumn("score", quality.quality_score(F.col("normalized"), cfg.stop_words)).filter(F.col("score") >= cfg.quality_threshold)
    k = keywords.top_keywords(s, "id", "normalized", cfg.keywords_per_chunk, cfg.stop_words).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]).alias("keywords"))
    e = providers.apply_provider(s, "entities", "normalized", "_entities")
    e = providers.apply_provider(e.withColumn("entities", T.entity_labels(F.col("_entities"))).drop("_entities"), "language", "normalized", "language")
    return e.join(k, "id", "left").withColumn("token_count", T.word_count(F.col("normalized")))


def process(document_lines: DataFrame, vectors: DataFrame, chunks_stored: DataFrame, cfg: EngineConfig, at: str, model_version: str = "local") -> tuple[DataFrame, DataFrame]:
    """(vectors after the upsert, new chunks) of the lines of documents.

    Running lines go, the text is cut into chunks, chunks whose hash is known are linked to the stored vector, the others are scored,
    enriched and embedded once for each hash; everything is joined by key, never by position.
    """
    clean = lines.remove_running_lines(document_lines)
    c = segment.chunk_documents(clean, cfg.chunk_strategy, cfg.chunk_budget, cfg.chunk_overlap, cfg).withColumn("hash", T.canonical_hash(F.col("content"))).withColumn("created_at", F.lit(at).cast("timestamp"))
    d = dedup.dedup_chunks(c, vectors, ["document_id", "chunk_index"])
    dups, fresh = dedup.split_duplicates(d)
    good = cut(enrich(fresh.drop("language", "token_count"), cfg))  # both results read it; no chunk is embedded twice
    text = "normalized" if cfg.embed_on == "normalized" else "content"
    new_vectors = cut(providers.vector_rows(providers.embed(good, text, dimensions=cfg.embed_dimensions, batch=cfg.embed_batch, timeout=cfg.embed_timeout_seconds), model_version))
    merged = store.upsert_vectors(vectors.select("id", "hash", "embedding", "model_version", "dimensions", "created_at"), new_vectors)
    cols = ["id", "document_id", "chunk_index", "content", "hash", "created_at", "start_page", "end_page", "language", "parser_version", "token_count", "entities", "keywords"]
    kept = good.withColumn("content", F.col("normalized")).select(*cols).unionByName(dups.select(*[c_ for c_ in cols if c_ not in ("entities", "keywords")]), allowMissingColumns=True)
    linked = kept.join(merged.select("hash", F.col("id").alias("vector_id")), "hash")
    return merged, linked.join(chunks_stored.select("document_id", "chunk_index"), ["document_id", "chunk_index"], "left_anti")


def near_duplicates(chunks: DataFrame, index: DataFrame, cfg: EngineConfig, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(chunks with ``near_id``, bucket rows to append to the index): new chunks probed against the stored index and against each other.

    With ``enrich_duplicates`` unset nothing is probed and ``near_id`` is null.
    """
    if not cfg.enrich_duplicates:
        return chunks.withColumn("near_id", F.lit(None).cast("string")), index.limit(0)
    rows = cut(lsh.buckets(lsh.signatures(chunks, "id", text, cfg.minhash_count), cfg.minhash_bands))
    stored, own = lsh.probe(rows, index), lsh.probe(rows)
    near = stored.select("id", "near_id", F.lit(0).alias("o")).unionByName(own.select("id", "near_id", F.lit(1).alias("o"))).groupBy("id").agg(F.min_by("near_id", "o").alias("near_id"))
    return chunks.join(near, "id", "left"), rows


def answer(query: str, chunks: DataFrame, vectors: DataFrame, documents: DataFrame, cfg: EngineConfig, tenant: str = "", top_k: int | None = None, min_similarity: float | None = None, embedder: str = "default") -> DataFrame:
    """Results of a text query; a blank one is an error."""
    q = query.strip()
    if not q:
        raise ValueError("query is required")
    if not q.lower().startswith(cfg.query_prefix.strip().lower()):
        q = cfg.query_prefix + q
    vec = providers.call_with_retry(providers.provider("embedder", embedder), [q], cfg.embed_attempts, timeout=cfg.embed_timeout_seconds)[0]
    return search.search(chunks, vectors, documents, vec, top_k or cfg.search_top_k, min_similarity or cfg.search_min_similarity, tenant)

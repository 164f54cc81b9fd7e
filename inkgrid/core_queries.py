"""Queries of the core operators by name; their SQL is in core_sql."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core_sql import SQL  # noqa: F401
from .functions import text as T
from .operators import dedup, keywords, lines, lsh, messages, metrics, providers, quality, search, segment, store, structure
from .runtime import cut, shared_folder, table
from .sources import files
from .streaming import events as ev

C = F.col
SPLIT_TIME = "2030-05-01 00:00:00"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of scanned uploads, each once."""
    return table(spark, d, "extracted_lines").groupBy("document_id", "line_no").agg(F.max("page").alias("page"), F.coalesce(F.max("text"), F.lit("")).alias("text"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(C("text").isNotNull())


def _vectors(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    v = table(spark, d, "vectors")
    return store.latest(v.select(*columns) if columns else v, "id", "created_at")


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return store.latest(c.select(*columns) if columns else c, "id", "created_at")


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    r = table(spark, d, "vectors").filter(search.usable(C("embedding"), C("dimensions")) & (C("dimensions") == 64)).select("id", "embedding").orderBy("id").first()
    return list(r["embedding"])


def _search(spark, d, k, tenant="", least=0.18):
    r = search.search(table(spark, d, "chunks"), table(spark, d, "vectors"), table(spark, d, "uploads"), _query_vector(spark, d), k, least, tenant)
    return r.select("chunk_id", "document_id", "document_name", "file_key", "vector_id", C("index").alias("chunk_index"), "similarity", "model_version")


def similarity_search(spark, d):
    return _search(spark, d, 10)


def similarity_search_tenant(spark, d):
    return _search(spark, d, 10, "default")


def similarity_threshold_count(spark, d):
    q = _query_vector(spark, d)
    score = F.when(search.usable(C("embedding"), C("dimensions")) & (F.size("embedding") == len(q)), search.cosine(C("embedding"), q))
    s = store.latest(table(spark, d, "vectors").select("id", "created_at", score.alias("s")), "id", "created_at").filter(C("s").isNotNull())
    return s.select(F.explode(F.array(*[F.lit(x) for x in (0.18, 0.3, 0.5)])).alias("threshold"), "s").groupBy("threshold").agg(F.count_if(C("s") >= C("threshold")).alias("n"))


def similarity_all_pairs_topk(spark, d):
    e = table(spark, d, "embeddings").select(C("vec_id").alias("id"), "embedding")
    return search.exact_neighbours(e.filter(C("id") % 50 == 0), e, 5).select("query_id", "row_id", "similarity", "rank")


def vector_codec(spark, d):
    v = _vectors(spark, d).filter(search.usable(C("embedding"), C("dimensions")))
    back = T.parse_vector(T.format_vector(C("embedding")))
    return v.select("id", (back == C("embedding")).alias("same"), F.size(back).alias("n"))


def canonical_hash(spark, d):
    return _docs(spark, d).select("doc_id", T.canonical_hash(C("text")).alias("hash"))


def canonical_hash_dups(spark, d):
    h = canonical_hash(spark, d).filter("hash <> ''")
    return h.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


def document_checksum_dedup(spark, d):
    u = _docs(spark, d).withColumn("checksum", T.checksum(C("text")))
    return dedup.new_documents(u.select("doc_id", "tenant_id", "checksum"), None, ["doc_id"])


def dedup_anti_join(spark, d):
    u = _docs(spark, d).select("doc_id", T.checksum(C("text")).alias("checksum"))
    return dedup.anti(u.filter("doc_id % 2 = 1"), u.filter("doc_id % 2 = 0"), "checksum")


def dedup_semi_join(spark, d):
    u = _docs(spark, d).select("doc_id", T.checksum(C("text")).alias("checksum"))
    return dedup.semi(u.filter("doc_id % 2 = 1"), u.filter("doc_id % 2 = 0"), "checksum")


def chunk_dedup(spark, d):
    c = _chunks(spark, d, "id", "hash", "document_id", "chunk_index", "created_at")
    v = _vectors(spark, d, "id", "hash", "created_at").filter(C("created_at") < F.lit(SPLIT_TIME).cast("timestamp"))
    r = dedup.dedup_chunks(c, v, ["document_id", "chunk_index", "id"])
    dups, fresh = dedup.split_duplicates(r)
    return dups.select("id", "known_vector_id", "first_id", F.lit("duplicate").alias("kind")).unionByName(fresh.select("id", "known_vector_id", "first_id", F.lit("embed").alias("kind")))


def _upserted(spark, d):
    v = _vectors(spark, d)
    old = C("created_at") < F.lit(SPLIT_TIME).cast("timestamp")
    return store.upsert_vectors(v.filter(old), v.filter(~old))


def vector_upsert(spark, d):
    return _upserted(spark, d).select("id", "hash", "model_version", "dimensions", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


def vector_id_remap(spark, d):
    return store.surviving_ids(_upserted(spark, d).select("id", "hash"), _chunks(spark, d, "id", "hash", "vector_id", "created_at").drop("created_at")).select("id", "vector_id")


def recent_hashes_topn(spark, d):
    return dedup.recent_hashes(_vectors(spark, d, "id", "hash", "created_at")).select("id", "hash")


def chunk_append_idempotent(spark, d):
    c = table(spark, d, "chunks").select("id", "document_id", "chunk_index", "created_at")
    old = C("created_at") < F.lit(SPLIT_TIME).cast("timestamp")
    return store.append_chunks(c.filter(old), c).select("id", "document_id", "chunk_index")


def document_lookup(spark, d):
    u = table(spark, d, "uploads")
    first = u.agg(F.min("checksum").alias("c"), F.min("id").alias("i"), F.min("file_key").alias("f")).first()
    a = store.document_by_checksum(u, first["c"]).select(F.lit("checksum").alias("by"), "id")
    b = store.point_lookup(u, "id", first["i"]).select(F.lit("id").alias("by"), "id")
    return a.unionByName(b).unionByName(store.point_lookup(u, "file_key", first["f"]).select(F.lit("file_key").alias("by"), "id"))


def strip_control(spark, d):
    return _docs(spark, d).select("doc_id", T.strip_control(F.concat("text", F.lit("\r\x07a\tb"))).alias("clean"))


def collapse_ws(spark, d):
    return _docs(spark, d).select("doc_id", T.collapse_ws(C("text")).alias("clean"))


def normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize_text(C("text")).alias("clean"))


def clean_chunk_text(spark, d):
    return _docs(spark, d).select("doc_id", T.clean_chunk_text(C("text")).alias("clean"))


def query_prefix(spark, d):
    return table(spark, d, "uploads").filter(C("name").isNotNull()).select("id", T.query_text(C("name")).alias("query")).distinct()


def fnv_hash(spark, d):
    return _docs(spark, d).select("doc_id", T.fnv1a64(C("text")).cast("string").alias("hash"))


def metadata_fields(spark, d):
    m = F.from_json(T.metadata_json(C("metadata")), "struct<document_id:string,language:string,token_count:int,entities:array<string>>")
    return _chunks(spark, d, "id", "metadata", "created_at").select("id", m.alias("m")).select("id", "m.document_id", "m.language", "m.token_count", C("m.entities").isNull().alias("no_entities"))


def recurring_lines_removed(spark, d):
    return lines.remove_running_lines(_lines(spark, d))


def page_split(spark, d):
    t = _docs(spark, d).select(C("doc_id").cast("string").alias("doc_id"), F.replace("text", F.lit("\n\n"), F.lit("\n\f")).alias("text"))
    return lines.split_pages(t, "doc_id", "text").groupBy("id").agg(F.count("*").cast("bigint").alias("lines"), F.max("page").cast("bigint").alias("pages"), F.sum(F.length("text")).alias("chars"))


def char_ratios(spark, d):
    t = C("text")
    return _docs(spark, d).select("doc_id", F.round(T.letter_share(t), 6).alias("letters"), F.round(T.digit_share(t), 6).alias("digits"), F.round(T.space_share(t), 6).alias("spaces"), F.round(T.upper_share(t), 6).alias("uppers"))


def char_entropy(spark, d):
    return _docs(spark, d).select("doc_id", F.round(T.entropy(C("text")), 6).alias("entropy"))


def quality_score(spark, d):
    return _docs(spark, d).select("doc_id", F.round(quality.quality_score(C("text")), 6).alias("score"))


def quality_gate(spark, d):
    return _docs(spark, d).select("doc_id", quality.passes_gate(C("text")).alias("passes"))


def boilerplate_filter(spark, d):
    p = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n\n", -1)).alias("para_no", "text"))
    return lines.drop_boilerplate(p).select("doc_id", "para_no", "text")


def doc_profile(spark, d):
    p = quality.with_profile(_docs(spark, d).select("doc_id", "text"), "text").drop("text")
    return p.select("doc_id", "sentence_count", F.round("avg_sentence_len", 6).alias("avg_sentence_len"), F.round("lexical_diversity", 6).alias("lexical_diversity"), F.round("digit_ratio", 6).alias("digit_ratio"), F.round("uppercase_ratio", 6).alias("uppercase_ratio"), "token_count")


def language_id(spark, d):
    return providers.apply_provider(_docs(spark, d).select("doc_id", "text"), "language", "text", "language").select("doc_id", "language")


def entities(spark, d):
    e = providers.apply_provider(_docs(spark, d).select("doc_id", "text"), "entities", "text", "entities")
    return e.select("doc_id", T.entity_labels(C("entities")).alias("labels"))


def keywords_topn(spark, d):
    return keywords.top_keywords(_docs(spark, d), "doc_id", "text").select(C("id").alias("doc_id"), "rank", "keyword", F.round("score", 6).alias("score"))


def word_scores(spark, d):
    s = keywords.word_scores(keywords.phrase_rows(_docs(spark, d), "doc_id", "text"))
    return s.select(C("id").alias("doc_id"), "word", "freq", "degree", F.round("score", 6).alias("score"))


def phrase_counts(spark, d):
    p = keywords.phrase_rows(_docs(spark, d), "doc_id", "text")
    return p.select(C("id").alias("doc_id"), F.array_join("words", " ").alias("phrase")).groupBy("doc_id", "phrase").agg(F.count("*").alias("n"))


def sentence_split(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(segment.sentences(C("text"))).alias("sentence_no", "sentence"))


def sentence_units(spark, d):
    return segment.sentence_units(_lines(spark, d)).select("document_id", "unit_no", "text")


def paragraph_units(spark, d):
    return segment.paragraph_units(_lines(spark, d)).select("document_id", "unit_no", "text")


def token_windows(spark, d):
    return segment.token_windows(_lines(spark, d), 100, 20).select("document_id", C("chunk_index").cast("bigint").alias("chunk_index"), "content")


def char_windows(spark, d):
    return segment.char_windows(_lines(spark, d), 100, 20).select("document_id", C("chunk_index").cast("bigint").alias("chunk_index"), "content", C("start_char_offset").cast("bigint").alias("a"), C("end_char_offset").cast("bigint").alias("e"))


def chunk_paragraph(spark, d):
    return segment.pack_units(segment.paragraph_units(_lines(spark, d)), 100, 20).select("document_id", C("chunk_index").cast("bigint").alias("chunk_index"), "first_unit", "last_unit", "content", "start_char_offset", "end_char_offset")


def chunk_sentence(spark, d):
    return segment.pack_units(segment.sentence_units(_lines(spark, d)), 60, 15).select("document_id", C("chunk_index").cast("bigint").alias("chunk_index"), "first_unit", "last_unit", "content", "start_char_offset", "end_char_offset")


def chunk_strategies(spark, d):
    out = None
    for s in ("exact", "paragraph", "sentence", "character-based", "other"):
        c = segment.chunk_documents(_lines(spark, d), s).groupBy("parser_version").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens")).withColumn("strategy", F.lit(s))
        out = c if out is None else out.unionByName(c)
    return out


def shingle_jaccard_pairs(spark, d):
    docs = _docs(spark, d).select("doc_id", "text")
    copies = lsh.copy_classes(docs, "doc_id", "text")
    reps = docs.join(copies.filter("id = class_id").select(C("id").alias("doc_id")), "doc_id", "left_semi")
    return lsh.similar_pairs(reps, "doc_id", "text")


def copy_classes(spark, d):
    return lsh.copy_classes(_docs(spark, d), "doc_id", "text")


def near_dup_clusters(spark, d):
    return lsh.near_duplicate_classes(_docs(spark, d).select("doc_id", "text"), "doc_id", "text")


def minhash_signature(spark, d):
    return lsh.signatures(_docs(spark, d), "doc_id", "text")


def lsh_candidates(spark, d):
    return lsh.probe(cut(lsh.buckets(lsh.signatures(_docs(spark, d), "doc_id", "text"))))


def structure_elements(spark, d):
    return structure.structure(_docs(spark, d), "doc_id", "text")


def embed_documents(spark, d):
    e = providers.embed(_docs(spark, d).select("doc_id", "text"), "text")
    return e.select("doc_id", "dimensions", F.round(search.dot(C("embedding"), C("embedding")), 4).alias("norm"))


def event_parse_dlq(spark, d):
    e = table(spark, d, "events_in")
    good = F.to_json(F.struct("event_id", "event_type", "document_id", "tenant_id", "name", "file_key", "file_size", "content_type", "timestamp"))
    raw = e.select("delivery_seq", F.coalesce("_corrupt_record", good).alias("value"))
    return ev.route(ev.decode(raw)).select("delivery_seq", "event_id", "target", "error_reason")


def dead_letters(spark, d):
    e = ev.route(table(spark, d, "events_in"))
    return ev.dead_letters(e, "2031-01-01 00:00:00").select("raw_payload", "error_reason", "attempt_count")


def retry_backoff_plan(spark, d):
    e = table(spark, d, "events_in").filter(C("_corrupt_record").isNull()).select("delivery_seq", (C("delivery_seq") % 7).alias("attempt_count"))
    return ev.backoff_plan(e).select("delivery_seq", "action", "delay_seconds")


def request_counters(spark, d):
    return metrics.counters(table(spark, d, "events"), ["event_type"])


def latency_histogram(spark, d):
    h = metrics.latency_histogram(table(spark, d, "events"), "value", [1.0, 5.0, 10.0, 25.0, 50.0, 100.0], ["event_type"])
    return h.select("event_type", "bucket", "n", F.round("total", 4).alias("total"), "upper_edge")


def health(spark, d):
    return metrics.health(spark).select("status")


def _work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for what a query writes and reads back."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stream_dedup_replay(spark, d):
    """The feed as a stream in micro-batches, run twice into the same folders; readers merge the batches."""
    work = _work_folder(spark, "stream")
    e = table(spark, d, "events_in")
    for attempt in range(2):
        s = spark.readStream.schema(e.schema).parquet(f"{d}/events_in.parque[t]")
        ev.run(s, lambda df, i: messages.keep_one(df, keep_unidentified=False), f"{work}/out", f"{work}/state{attempt}").awaitTermination()
    return messages.keep_one(spark.read.parquet(f"{work}/out/main"), keep_unidentified=False).select("delivery_seq", "message_key")


def retry_until_dead(spark, d):
    """Some events fail at every delivery until they are dead, others succeed at the third: attempts travel with the pending events."""
    new = cut(messages.keep_one(table(spark, d, "events_in"), keep_unidentified=False).drop("message_key"))

    def work(df, i):
        bad = (C("delivery_seq") % 11 == 0) | ((C("delivery_seq") % 7 == 0) & (C("attempt_count") < 2))
        return df.filter(~bad), df.filter(bad)

    pending, out = None, None
    for k in range(5):  # as many deliveries as an event gets
        o = ev.deliver(new if k == 0 else new.limit(0), pending, work, k, now=f"2031-01-01 00:0{k}:30", seconds=2)
        pending = cut(o.pending)
        r = o.results.select("event_id", "attempt_count", F.lit("done").alias("outcome")).unionByName(o.dead.select("event_id", "attempt_count", F.lit("dead").alias("outcome")))
        out = r if out is None else out.unionByName(r)
    return out


def transaction_commit(spark, d):
    """Vectors and chunks of two batches and of one that broke off before its mark: only the first two are there to read."""
    work = _work_folder(spark, "commit")
    v, c = _vectors(spark, d, "id", "hash", "created_at"), _chunks(spark, d, "id", "vector_id", "created_at")
    old = C("created_at") < F.lit(SPLIT_TIME).cast("timestamp")
    store.publish_together({"vectors": v.filter(old), "chunks": c.filter(old)}, work, 1)
    for _ in range(2):  # a replay changes nothing
        store.publish_together({"vectors": v.filter(~old), "chunks": c.filter(~old)}, work, 2)
    store.publish(v.withColumn("id", F.concat(F.lit("lost-"), "id")), f"{work}/vectors", 3)
    both = store.read_together(spark, work, "vectors", "id string, hash string, created_at timestamp").select("id", F.lit("vectors").alias("of"))
    return both.unionByName(store.read_together(spark, work, "chunks", "id string, vector_id string, created_at timestamp").select("id", F.lit("chunks").alias("of")))


def documents_insert(spark, d):
    """Uploads written to the documents table in two batches, one of them twice, and read back."""
    work = _work_folder(spark, "documents")
    u = store.latest(table(spark, d, "uploads"), "id", "updated_at")
    for part, batch in (("default", 1), ("other", 2), ("other", 2)):
        files.insert_documents(u.filter((C("tenant_id") == "default") == F.lit(part == "default")), work, batch)
    return files.read_documents(spark, work).select("id", "tenant_id", "checksum", "file_size")


STOP_WORDS = ("the", "of", "and", "to", "in", "is", "was", "that", "for", "with", "on", "as", "by", "from", "der", "die", "und", "los", "las", "que")
HONORIFICS = ("mr", "mrs", "ms", "dr", "prof", "st", "sr", "sra", "fig", "sec")


def quality_score_stop_words(spark, d):
    return _docs(spark, d).select("doc_id", F.round(quality.quality_score(C("text"), STOP_WORDS), 6).alias("score"))


def keywords_stop_words(spark, d):
    return keywords.top_keywords(_docs(spark, d), "doc_id", "text", 8, STOP_WORDS).select(C("id").alias("doc_id"), "rank", "keyword", F.round("score", 6).alias("score"))


def sentence_split_honorifics(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(segment.sentences(C("text"), HONORIFICS)).alias("sentence_no", "sentence"))


def chunk_paragraph_production(spark, d):
    """Paragraphs at the production budget of 450 words with an overlap of 80."""
    return segment.pack_units(segment.paragraph_units(_lines(spark, d)), 450, 80).select("document_id", C("chunk_index").cast("bigint").alias("chunk_index"), "first_unit", "last_unit", "content", "start_char_offset", "end_char_offset")


def chunk_sentence_production(spark, d):
    return segment.pack_units(segment.sentence_units(_lines(spark, d)), 450, 80).select("document_id", C("chunk_index").cast("bigint").alias("chunk_index"), "first_unit", "last_unit", "content", "start_char_offset", "end_char_offset")


def lsh_index_probe(spark, d):
    """New documents (odd ids) probed against the stored index of the others."""
    work = _work_folder(spark, "index")
    rows = lsh.buckets(lsh.signatures(_docs(spark, d).filter("doc_id % 2 = 0"), "doc_id", "text"))
    path = store.publish(rows, work, 1)
    new = lsh.buckets(lsh.signatures(_docs(spark, d).filter("doc_id % 2 = 1"), "doc_id", "text"))
    return lsh.probe(new, spark.read.schema("band int, bucket_key string, id bigint").parquet(path))


def p3_found(spark, d):
    return messages.repeated_deliveries(table(spark, d, "events_in"))


def p3_kept(spark, d):
    kept = messages.keep_one(table(spark, d, "events_in"))
    return kept.select("delivery_seq", "message_key", "document_id", C("timestamp").cast("string").alias("sent_at"))


QUERIES = {
    f.__name__: f
    for f in (
        similarity_search, similarity_search_tenant, similarity_threshold_count, similarity_all_pairs_topk, vector_codec,
        canonical_hash, canonical_hash_dups, document_checksum_dedup, dedup_anti_join, dedup_semi_join, chunk_dedup,
        vector_upsert, vector_id_remap, recent_hashes_topn, chunk_append_idempotent, document_lookup,
        strip_control, collapse_ws, normalize_text, clean_chunk_text, query_prefix, fnv_hash, metadata_fields,
        recurring_lines_removed, page_split, char_ratios, char_entropy, quality_score, quality_gate, boilerplate_filter, doc_profile,
        language_id, entities, keywords_topn, word_scores, phrase_counts, sentence_split, sentence_units, paragraph_units,
        token_windows, char_windows, chunk_paragraph, chunk_sentence, chunk_strategies,
        shingle_jaccard_pairs, copy_classes, near_dup_clusters, minhash_signature, lsh_candidates, structure_elements, embed_documents,
        event_parse_dlq, dead_letters, retry_backoff_plan, request_counters, latency_histogram, health, stream_dedup_replay,
        retry_until_dead, transaction_commit, documents_insert, quality_score_stop_words, keywords_stop_words, sentence_split_honorifics,
        chunk_paragraph_production, chunk_sentence_production, lsh_index_probe,
        p3_found, p3_kept,
    )
}

"""Reading and writing of objects, events and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..operators import providers
from ..operators.lines import split_pages
from ..operators.store import publish


def read_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file_key, file_size, modified, content) of the objects under a path."""
    o = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return o.select(F.col("path").alias("file_key"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"), "content")


def write_objects(objects: DataFrame, path: str) -> None:
    """Stores the content of objects under their key, as a table that :func:`stored_objects` reads.

    A key is written once: of repeated ones the content of the least digest, and none that the table has already.
    """
    o = objects.filter(F.col("file_key").isNotNull()).groupBy("file_key").agg(F.min_by("content", F.sha2("content", 256)).alias("content"))
    old = stored_objects(objects.sparkSession, path).select("file_key") if _exists(objects.sparkSession, path) else None
    (o if old is None else o.join(old, "file_key", "left_anti")).write.mode("append").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def insert_documents(documents: DataFrame, path: str, batch_id: int | str) -> str:
    """Writes new documents as one batch of the documents table: all of them or none, and a replay of the batch changes nothing."""
    cols = [f.split()[0] for f in schemas.DOCUMENTS.split(", ")]
    return publish(documents.select(*cols), path, batch_id)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents of all batches."""
    return spark.read.schema(schemas.DOCUMENTS).parquet(f"{path}/batch=*")


def stored_objects(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """(file_key, content) of stored objects, of some keys or of all."""
    o = spark.read.schema("file_key string, content binary").parquet(path)
    return o if keys is None else o.join(keys.select("file_key").distinct(), "file_key", "left_semi")


def extract_lines(objects: DataFrame, id_col: str = "file_key", extractor: str = "default") -> DataFrame:
    """Lines with pages of each object, by the extractor provider; an object that gives no text has no lines."""
    t = providers.apply_provider(objects.select(id_col, "content"), "extractor", "content", "text", extractor)
    return split_pages(t.filter(F.length("text") > 0), id_col, "text").withColumnRenamed("id", "document_id")


def validate_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reason): name and content are required; the content type defaults to PDF; checksum, size and key are added."""
    reason = F.when(F.col("name").isNull() | (F.trim("name") == ""), F.lit("name is required")).when(F.col("content").isNull(), F.lit("file is required"))
    d = uploads.withColumn("reason", reason)
    ok = d.filter(F.col("reason").isNull()).drop("reason")
    sha = T.checksum(F.col("content"))
    ok = ok.withColumn("content_type", F.when(F.length("content_type") > 0, F.col("content_type")).otherwise("application/pdf")).withColumn("checksum", sha).withColumn("file_size", F.octet_length("content").cast("bigint"))
    ok = ok.withColumn("id", T.stable_id(F.col("tenant_id"), F.col("checksum"))).withColumn("file_key", F.concat(F.lit("documents/"), F.col("id"), F.lit(".pdf")))
    return ok, d.filter(F.col("reason").isNotNull())


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines; undecodable ones keep their text in ``_corrupt_record``."""
    return spark.read.schema(schemas.EVENTS).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def write_events(events: DataFrame, path: str) -> None:
    events.select(F.to_json(F.struct(*[F.col(c) for c in events.columns])).alias("value")).write.mode("append").text(path)


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """The event landing folder as a stream with bounded batches."""
    return spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def document_events(documents: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """document.created events; with ``chunks`` only for documents that have none (also those whose first event was lost).

    The trace context of the request (``traceparent``, ``tracestate``) goes along where the documents carry one.
    """
    trace = [F.col(c) if c in documents.columns else F.lit(None).cast("string").alias(c) for c in ("traceparent", "tracestate")]
    d = documents if chunks is None else documents.join(chunks.select(F.col("document_id").alias("id")).distinct(), "id", "left_anti")
    return d.select(T.stable_id(F.lit("event"), F.col("id")).alias("event_id"), F.lit("document.created").alias("event_type"), F.col("id").alias("document_id"), "tenant_id", "name", "file_key", "file_size", "content_type", F.col("created_at").alias("timestamp"), *trace)

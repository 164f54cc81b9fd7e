"""At-least-once event processing: decoding, retries, dead letters, idempotent batches."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from .. import schemas
from ..operators import messages
from ..operators.store import publish


def decode(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Event columns from JSON texts; what cannot be decoded has only ``_corrupt_record``."""
    e = F.from_json(F.col(value_col), schemas.EVENTS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return raw.withColumn("_e", e).select(*[c for c in raw.columns if c != value_col], "_e.*")


def route(events: DataFrame, attempts: DataFrame | None = None, max_deliveries: int = 5) -> DataFrame:
    """Adds ``target`` (process, skip or dlq) and ``error_reason``.

    Undecodable events and those out of attempts are dead; events without a document are successes without work.
    ``attempts``: event_id, attempt_count of failures so far; events may bring an ``attempt_count`` of their own.
    """
    if attempts is not None:
        events = events.drop("attempt_count").join(attempts.select("event_id", "attempt_count"), "event_id", "left")
    e = events if "attempt_count" in events.columns else events.withColumn("attempt_count", F.lit(0).cast("bigint"))
    n = F.coalesce("attempt_count", F.lit(0))
    corrupt, empty = F.col("_corrupt_record").isNotNull(), F.coalesce(F.trim("document_id"), F.lit("")) == ""
    target = F.when(corrupt | (n >= max_deliveries), "dlq").when(empty, "skip").otherwise("process")
    reason = F.when(corrupt, "undecodable").when(n >= max_deliveries, "max deliveries")
    return e.withColumn("attempt_count", n).withColumn("target", target).withColumn("error_reason", reason)


def backoff_plan(failures: DataFrame, max_deliveries: int = 5, seconds: int = 2) -> DataFrame:
    """(…, action, delay_seconds): failed deliveries are retried after seconds * attempt, or go to the dead letters at the last one."""
    last = F.col("attempt_count") >= max_deliveries
    return failures.withColumn("action", F.when(last, "dlq").otherwise("retry")).withColumn("delay_seconds", F.when(~last, F.col("attempt_count") * seconds))


def dead_letters(routed: DataFrame, failed_at: str | None = None) -> DataFrame:
    """Dead letters of routed events, with the raw text of undecodable ones."""
    d = routed.filter("target = 'dlq'")
    t = F.lit(failed_at).cast("timestamp") if failed_at else F.current_timestamp()
    raw = F.coalesce("_corrupt_record", F.to_json(F.struct("event_id", "event_type", "document_id", "tenant_id", "name", "file_key", "file_size", "content_type", "timestamp")))
    return d.select("event_id", "document_id", "file_key", F.col("attempt_count").cast("bigint").alias("attempt_count"), "error_reason", t.alias("failed_timestamp"), raw.alias("raw_payload"))


def deduplicated(stream: DataFrame, ttl: str = "7 days", time_col: str = "timestamp") -> DataFrame:
    """A stream without repeats of a message within the ttl; state older than that is dropped."""
    keyed = stream.withColumn("message_key", messages.message_key(F.col("event_id")))
    return keyed.withWatermark(time_col, ttl).dropDuplicatesWithinWatermark(["message_key"])


Process = Callable[[DataFrame, int], "DataFrame | tuple[DataFrame, DataFrame]"]


class Outcome(NamedTuple):
    """What one delivery of some events came to: results, dead letters and what waits for its next delivery."""

    results: DataFrame
    dead: DataFrame
    pending: DataFrame


def deliver(new: DataFrame, pending: DataFrame | None, process: Process, batch_id: int = 0, now: str | None = None, key: str = "event_id", max_deliveries: int = 5, seconds: int = 2) -> Outcome:
    """Delivers new events and the pending ones that are due.

    ``process`` gives its results, or results and failures: rows with ``key``. A failed event waits ``seconds`` times its attempts and goes to
    the dead letters at the last one; its attempts travel with it in ``pending`` (the event's columns, attempt_count, due).
    """
    t = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    fresh = new.withColumn("attempt_count", F.lit(0).cast("bigint"))
    later = None
    if pending is not None:
        fresh = fresh.unionByName(pending.filter(F.col("due") <= t).drop("due"), allowMissingColumns=True)
        later = pending.filter(F.col("due") > t)
    routed = route(fresh, max_deliveries=max_deliveries)
    work = routed.filter("target = 'process'")
    done = process(work.drop("target", "error_reason"), batch_id)
    results, failures = done if isinstance(done, tuple) else (done, None)
    dead = dead_letters(routed, now)
    cols = [*new.columns, "attempt_count"]
    if failures is None:
        waiting = work.limit(0).select(*cols).withColumn("due", t)
    else:
        failed = work.join(failures.select(key).distinct(), key, "left_semi").withColumn("attempt_count", F.col("attempt_count") + 1)
        out = failed.filter(F.col("attempt_count") >= max_deliveries).withColumn("target", F.lit("dlq")).withColumn("error_reason", F.lit("max deliveries"))
        dead = dead.unionByName(dead_letters(out, now))
        waiting = failed.filter(F.col("attempt_count") < max_deliveries).select(*cols).withColumn("due", t + F.make_interval(secs=(F.col("attempt_count") * seconds).cast("decimal(18,6)")))
    return Outcome(results, dead, waiting if later is None else waiting.unionByName(later.select(*waiting.columns)))


def run(stream: DataFrame, process: Process, out: str, checkpoint: str, available_now: bool = True, key: str = "event_id", max_deliveries: int = 5, seconds: int = 2) -> StreamingQuery:
    """Processes a stream in micro-batches. Results, dead letters and the pending events of a batch replace what an earlier attempt of it wrote, so that
    a replay after a failure changes nothing; the checkpoint advances only after all are written.

    Pending events of the batch before are delivered again when they are due; each batch leaves all that still wait, so only one folder is read.
    """

    def each(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        schema = StructType([*df.schema.fields, StructField("attempt_count", LongType()), StructField("due", TimestampType())])
        pending = spark.read.schema(schema).parquet(f"{out}/pending/batch={batch_id - 1}") if batch_id else None
        df = df.persist()
        try:
            o = deliver(df, pending, process, batch_id, key=key, max_deliveries=max_deliveries, seconds=seconds)
            publish(o.results, f"{out}/main", batch_id)
            publish(o.dead, f"{out}/dlq", batch_id)
            publish(o.pending, f"{out}/pending", batch_id)
        finally:
            df.unpersist()

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()

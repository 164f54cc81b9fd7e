import json
import os

from pyspark.sql import functions as F

from inkgrid.operators import messages
from inkgrid.sources import files
from inkgrid.streaming import events as ev


def test_bad_events_go_to_the_dead_letters_and_replays_change_nothing(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    good = [{"event_id": f"e{i % 4}", "document_id": f"d{i % 4}", "timestamp": "2030-01-01T00:00:00Z"} for i in range(6)]
    (src / "a.json").write_text("\n".join(json.dumps(x) for x in good) + '\n{"event_id": "tr')
    (src / "b.json").write_text(json.dumps({"event_id": "e9", "document_id": ""}))
    seen = []
    for k in range(2):
        s = files.stream_events(spark, str(src), 1)
        ev.run(s, lambda df, i: df.dropDuplicates(["event_id"]), str(tmp_path / "out"), str(tmp_path / f"state{k}")).awaitTermination()
        main = messages.keep_one(spark.read.parquet(str(tmp_path / "out/main")).withColumn("delivery_seq", F.lit(0)).withColumn("received_at", F.col("timestamp")))
        dead = spark.read.parquet(str(tmp_path / "out/dlq"))
        seen.append((sorted(r["event_id"] for r in main.collect()), [(r["raw_payload"], r["error_reason"]) for r in dead.collect()]))
    assert seen[0] == seen[1] == (["e0", "e1", "e2", "e3"], [('{"event_id": "tr', "undecodable")])


def test_routing_and_backoff(spark):
    raw = spark.createDataFrame([('{"event_id":"a","document_id":"d"}',), ("{oops",), ('{"event_id":"b","document_id":" "}',)], "value string")
    attempts = spark.createDataFrame([("a", 5)], "event_id string, attempt_count bigint")
    assert [r["target"] for r in ev.route(ev.decode(raw)).collect()] == ["process", "dlq", "skip"]
    r = ev.route(ev.decode(raw), attempts).filter("event_id = 'a'").first()
    assert (r["target"], r["error_reason"]) == ("dlq", "max deliveries")
    plan = ev.backoff_plan(spark.createDataFrame([(1,), (4,), (5,)], "attempt_count int")).collect()
    assert [(x["action"], x["delay_seconds"]) for x in plan] == [("retry", 2), ("retry", 8), ("dlq", None)]


def test_stream_without_repeats(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("select * from values ('a', timestamp'2030-01-01 00:00:00'), ('A', timestamp'2030-01-01 00:00:01'), ('{0}', timestamp'2030-01-01 00:00:02') t(event_id, timestamp)").coalesce(1).write.parquet(str(src))
    s = spark.readStream.schema("event_id string, timestamp timestamp").parquet(str(src))
    q = ev.deduplicated(s).writeStream.format("memory").queryName("uniq").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("uniq").count() == 3


def test_upload_sources(spark, tmp_path):
    (tmp_path / "o").mkdir()
    (tmp_path / "o/x.txt").write_bytes("a\nb\fc".encode())
    lines = files.extract_lines(files.read_objects(spark, str(tmp_path / "o"))).orderBy("line_no").collect()
    assert [(r["page"], r["text"]) for r in lines] == [(1, "a"), (1, "b"), (2, "c")]
    up = spark.createDataFrame([("t", "n", None, "", bytearray(b"abc")), ("t", "", None, "x", bytearray(b"abc")), ("t", "m", None, "x", None)], "tenant_id string, name string, description string, content_type string, content binary")
    ok, bad = files.validate_uploads(up)
    assert [r["content_type"] for r in ok.collect()] == ["application/pdf"]
    assert sorted(r["reason"] for r in bad.collect()) == ["file is required", "name is required"]
    files.write_events(files.document_events(ok.withColumn("created_at", F.lit("2030-01-01").cast("timestamp"))), str(tmp_path / "ev"))
    assert files.read_events(spark, str(tmp_path / "ev")).select("event_type", "document_id").first()["event_type"] == "document.created"


def test_a_failing_event_is_delivered_again_until_it_is_dead(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(4):
        (src / f"{k}.json").write_text(json.dumps({"event_id": f"e{k}", "document_id": "bad" if k in (0, 3) else "d"}))
        os.utime(src / f"{k}.json", (1_900_000_000 + k, 1_900_000_000 + k))  # files come in the order of their times
    s = files.stream_events(spark, str(src), 1)
    q = ev.run(s, lambda df, i: (df.filter("document_id = 'd'"), df.filter("document_id = 'bad'")), str(tmp_path / "out"), str(tmp_path / "state"), max_deliveries=3, seconds=0)
    q.awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out/main")).collect()) == ["e1", "e2"]
    dead = spark.read.parquet(str(tmp_path / "out/dlq")).collect()
    assert [(r["event_id"], r["attempt_count"], r["error_reason"]) for r in dead] == [("e0", 3, "max deliveries")]
    left = spark.read.parquet(str(tmp_path / "out/pending/batch=3")).collect()
    assert [(r["event_id"], r["attempt_count"]) for r in left] == [("e3", 1)]


def test_pending_events_wait_until_they_are_due(spark):
    new = spark.createDataFrame([("a", "d"), ("b", "d")], "event_id string, document_id string").withColumn("_corrupt_record", F.lit(None).cast("string"))
    for c in ("event_type", "tenant_id", "name", "file_key", "content_type"):
        new = new.withColumn(c, F.lit(None).cast("string"))
    new = new.withColumn("file_size", F.lit(1).cast("bigint")).withColumn("timestamp", F.lit("2030-01-01").cast("timestamp"))
    fail_a = lambda df, i: (df.filter("event_id <> 'a'"), df.filter("event_id = 'a'"))
    o = ev.deliver(new, None, fail_a, now="2030-01-01 00:00:00")
    assert [r["event_id"] for r in o.results.collect()] == ["b"] and [(r["attempt_count"], str(r["due"])[-8:]) for r in o.pending.collect()] == [(1, "00:00:02")]
    early = ev.deliver(new.limit(0), o.pending, fail_a, now="2030-01-01 00:00:01")
    assert early.results.count() == 0 and early.pending.count() == 1 and early.dead.count() == 0
    late = ev.deliver(new.limit(0), o.pending, lambda df, i: df, now="2030-01-01 00:00:02")
    assert [(r["event_id"], r["attempt_count"]) for r in late.results.collect()] == [("a", 1)] and late.pending.count() == 0


def test_objects_are_written_once_and_events_carry_their_trace(spark, tmp_path):
    o = spark.createDataFrame([("k1", bytearray(b"b")), ("k1", bytearray(b"a")), (None, bytearray(b"x"))], "file_key string, content binary")
    for _ in range(2):
        files.write_objects(o, str(tmp_path / "obj"))
    assert files.stored_objects(spark, str(tmp_path / "obj")).count() == 1
    d = spark.createDataFrame([("d", "t", "n", "k", 1, "pdf", "00-abc-01", None)], "id string, tenant_id string, name string, file_key string, file_size bigint, content_type string, traceparent string, tracestate string").withColumn("created_at", F.lit("2030-01-01").cast("timestamp"))
    r = files.document_events(d).first()
    assert (r["traceparent"], r["tracestate"]) == ("00-abc-01", None) and files.document_events(d.drop("traceparent", "tracestate")).first()["traceparent"] is None

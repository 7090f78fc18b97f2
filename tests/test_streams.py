"""Streams that stop, start again, lose their checkpoint, or meet late rows."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from logloom.functions.base import show_ts
from logloom.operators.filters import LogQuery
from logloom.session import scratch
from logloom.streaming import jobs

NOW = "2026-02-01 00:00:00"


def text(lines):
    body = "\n".join(json.dumps(x) for x in lines)
    return json.dumps({"format": "clef", "source": "svc", "body": base64.b64encode(body.encode()).decode()})


def event(second):
    return {"@t": f"2026-01-01T00:00:{second:02d}Z", "@m": f"m{second}"}


def deliver(spark, inbox, *messages):
    for name, body in messages:
        spark.createDataFrame([(name, body)], "id string, body string").coalesce(1).write.mode("append").json(inbox)


def ingest(spark, inbox, root, checkpoint):
    jobs.ingest_stream(spark, inbox, root, checkpoint, NOW, max_files=1).awaitTermination()
    return sorted(r["message"] for r in jobs.landed_events(spark, root).collect())


def test_nothing_is_stored_twice(spark):
    inbox, root, checkpoint = (scratch(spark, x) for x in ("inbox", "landing", "checkpoint"))
    deliver(spark, inbox, ("a", text([event(1)])), ("blank", text([])), ("b", text([event(2), event(3)])), ("bad", "no json"))
    once = ["m1", "m2", "m3"]
    assert ingest(spark, inbox, root, checkpoint) == once
    assert ingest(spark, inbox, root, scratch(spark, "checkpoint")) == once  # the checkpoint is lost
    deliver(spark, inbox, ("b", text([event(2), event(3)])), ("c", text([event(4)])))  # delivered again, and a new one
    assert ingest(spark, inbox, root, checkpoint) == [*once, "m4"]
    moved = scratch(spark, "inbox")
    deliver(spark, moved, ("c", text([event(4)])), ("blank", text([])), ("d", text([event(5)])), ("b", text([event(2), event(3)])), ("a", text([event(1)])))
    assert ingest(spark, moved, root, scratch(spark, "checkpoint")) == [*once, "m4", "m5"]
    assert jobs.landed_dead_letters(spark, root).count() == 1


def test_a_batch_that_stopped_half_way_is_completed(spark):
    inbox, root, checkpoint = (scratch(spark, x) for x in ("inbox", "landing", "checkpoint"))
    deliver(spark, inbox, ("a", text([event(1), event(2)])))
    rows = jobs.stored_rows(jobs.parse_messages(spark.read.json(inbox).selectExpr("id message_id", "body raw"), NOW), NOW)
    spark.createDataFrame([(json.dumps({"id": "run-1"}),)], "value string").coalesce(1).write.text(f"{checkpoint}/metadata")
    half = rows.filter("message = 'm1'").withColumn("batch", F.lit("run-1-0")).select(*jobs.STORED.fieldNames())
    jobs.write_landing(half, root)  # the job died here: a part is stored, nothing is in the ledger
    for _ in range(2):  # replayed once before and once after its ids reached the ledger
        jobs.LandingWriter(root, checkpoint)(rows, 0)
        assert sorted(r["message"] for r in jobs.landed_events(spark, root).collect()) == ["m1", "m2"]


@pytest.fixture
def landing(spark):
    path = scratch(spark, "landed")

    def land(*rows):
        frame = spark.createDataFrame(list(rows), "id string, t string, level string, source string").withColumn("timestamp", F.col("t").cast("timestamp"))
        frame.drop("t").withColumn("dt", F.to_date("timestamp")).write.mode("append").partitionBy("dt").parquet(path)
        return path
    return land


def test_late_rows_count(spark, landing):
    table, checkpoint = scratch(spark, "buckets"), scratch(spark, "checkpoint")
    schema = "id string, level string, source string, timestamp timestamp, dt date"

    def follow(path, upkeep):
        upkeep.run(spark.readStream.schema(schema).parquet(path), checkpoint).awaitTermination()
        return {r[0]: (r["count"], r["errors"]) for r in jobs.kept_buckets(spark, table).select(
            show_ts(F.col("bucket_start")), "count", "errors").collect()}

    path = landing(("1", "2026-01-02 10:00:05", "Error", "a"), ("2", "2026-01-02 10:00:50", "Debug", "a"))
    make = lambda: jobs.rolling_metrics(lambda s: s.read.schema(schema).parquet(path), table)
    assert follow(path, make()) == {"2026-01-02 10:00:00": (2, 1)}  # the newest window is there at once
    landing(("3", "2025-12-30 23:59:59", "Error", "a"), ("4", "2026-01-02 10:00:10", "Fatal", "a"))
    want = {"2026-01-02 10:00:00": (3, 2), "2025-12-30 23:59:00": (1, 1)}
    assert follow(path, make()) == want
    upkeep = make()
    upkeep(spark.read.schema(schema).parquet(path), 7)  # a replay changes nothing
    assert {r[0]: r["count"] for r in jobs.kept_buckets(spark, table).select(show_ts(F.col("bucket_start")), "count").collect()} == {
        k: v[0] for k, v in want.items()}


def test_sliding_rule_over_midnight(spark, landing):
    table = scratch(spark, "buckets")
    path = landing(("1", "2026-01-01 23:59:30", "Error", "a"), ("2", "2026-01-02 00:01:10", "Error", "b"), ("3", "2026-01-02 00:00:10", "Debug", "a"))
    events = lambda s: s.read.parquet(path)
    upkeep = jobs.sliding_rule(events, table, LogQuery("a", "Error"), "3 minutes", "1 minute")
    upkeep(events(spark), 0)
    upkeep(events(spark).filter("id = '3'"), 1)  # touches no match
    got = {r[0]: r["cnt"] for r in jobs.kept_buckets(spark, table).select(show_ts(F.col("bucket_end")), "cnt").collect()}
    assert got == {"2026-01-02 00:00:00": 1, "2026-01-02 00:01:00": 1, "2026-01-02 00:02:00": 1}


def test_the_first_batch_after_a_start_reaches_the_ledger(spark):
    inbox, root, checkpoint = (scratch(spark, x) for x in ("inbox", "landing", "checkpoint"))
    deliver(spark, inbox, ("a", text([event(1)])))
    ingest(spark, inbox, root, checkpoint)
    deliver(spark, inbox, ("b", text([event(2)])))
    assert ingest(spark, inbox, root, checkpoint) == ["m1", "m2"]
    ids = spark.read.schema(jobs.LEDGER).parquet(f"{root}/_ledger")  # the write of the events must not empty what is kept of the batch
    assert sorted(r["message_id"] for r in ids.collect()) == ["a", "b"]


@pytest.fixture
def many_parts(spark, tmp_path):
    """200 events, and a session that leaves small shuffle partitions apart."""
    rows = spark.range(200).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield str(tmp_path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_delivery_is_written_and_read_by_many_tasks(spark, many_parts, monkeypatch):
    from logloom.suite import QUERIES

    seen, real = {}, jobs.ingest_stream

    def ingest_stream(spark, inbox, *args, max_files, **more):
        seen.update(files=len(spark.read.text(inbox).inputFiles()), batch=max_files)
        return real(spark, inbox, *args, max_files=max_files, **more)

    monkeypatch.setattr(jobs, "ingest_stream", ingest_stream)
    assert QUERIES["stream_tail"](spark, many_parts).count() == 50  # the second of four messages
    assert seen["batch"] > 1 and seen["files"] == 2 * seen["batch"]  # a delivery is a batch of its own


def test_nested_requests_are_parsed_by_many_tasks(spark, many_parts):
    from logloom.suite import QUERIES

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")  # as usual: few bytes would become one task
    got = QUERIES["ingest_otlp_nested"](spark, many_parts)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r["no"] for r in got.select("no").collect()) == list(range(200))

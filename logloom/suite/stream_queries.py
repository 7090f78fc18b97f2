"""Streams run over what is available and stored as tables; each is checked against a batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.base import show_ts
from logloom.operators.aggregates import count_rows
from logloom.operators.filters import LogQuery
from logloom.operators.search import newest_first
from logloom.session import scratch
from logloom.streaming import jobs
from logloom.suite.base import AS_OF, CTES, TEXT_TIME, log_events, query
from logloom.suite.ingest_queries import _ID, _N, LINES_PER_MESSAGE, clef_messages, mixed_messages
from logloom.suite.rule_queries import SPECS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark, sf: str) -> DataFrame:
    """The log events as a stream of stored files."""
    path = scratch(spark, "stream-in")
    log_events(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp")).write.parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def kept(spark, sf: str, upkeep) -> DataFrame:
    """Buckets kept over events that land in four batches, each with rows of all days: most come a day late or more."""
    path, table = scratch(spark, "landed"), scratch(spark, "buckets")
    events = log_events(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    events.repartition(4, F.crc32("id")).withColumn("dt", F.to_date("timestamp")).write.parquet(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    upkeep(lambda s: s.read.schema(schema).parquet(path), table).run(stream, scratch(spark, "buckets-checkpoint")).awaitTermination()
    return jobs.kept_buckets(spark, table)


def finish(stream: DataFrame, label: str) -> DataFrame:
    spark = stream.sparkSession
    out = scratch(spark, label)
    jobs.to_parquet(stream, out, scratch(spark, f"{label}-checkpoint"))
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_ingest", """
SELECT 'event' AS outcome, CAST(sum(CASE o_orderkey % 10 WHEN 0 THEN 2 WHEN 3 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM orders
UNION ALL SELECT 'dead_letter', count(*) FROM orders WHERE o_orderkey % 10 IN (4, 5, 6, 7, 9)""")
def _(spark, sf):
    """Message files to events and dead letters; a second run over a lost checkpoint adds nothing twice."""
    inbox, root = scratch(spark, "inbox"), scratch(spark, "landing")
    mixed_messages(spark, sf).select(F.col("message_id").alias("id"), F.col("raw").alias("body")).hint("rebalance").write.json(inbox)
    for _ in range(2):
        jobs.ingest_stream(spark, inbox, root, scratch(spark, "checkpoint"), AS_OF.isoformat(" ")).awaitTermination()
    events = jobs.landed_events(spark, root).agg(count_rows().alias("n")).select(F.lit("event").alias("outcome"), "n")
    dead = jobs.landed_dead_letters(spark, root).agg(count_rows().alias("n")).select(F.lit("dead_letter").alias("outcome"), "n")
    return events.unionByName(dead)


@query("stream_ingest_matches_batch", "SELECT level, message, count(*) AS n FROM log_events GROUP BY level, message", "log_events")
def _(spark, sf):
    inbox, root = scratch(spark, "inbox"), scratch(spark, "landing")
    clef_messages(spark, sf).select(F.col("message_id").alias("id"), F.col("raw").alias("body")).write.json(inbox)
    jobs.ingest_stream(spark, inbox, root, scratch(spark, "checkpoint"), AS_OF.isoformat(" ")).awaitTermination()
    return jobs.landed_events(spark, root).groupBy("level", "message").agg(count_rows().alias("n"))


@query("stream_rolling_metrics", f"""
SELECT strftime(date_trunc('minute', timestamp), {TEXT_TIME}) AS bucket, count(*) AS count, count(*) FILTER (WHERE level IN ('Error', 'Fatal')) AS errors,
       count(*) FILTER (WHERE level = 'Warning') AS warnings FROM log_events GROUP BY 1""", "log_events")
def _(spark, sf):
    """Every window of the whole table, the last ones and those of late rows included."""
    return jobs.shown(kept(spark, sf, jobs.rolling_metrics))


@query("stream_sliding_rule", f"""
SELECT strftime(e, {TEXT_TIME}) AS evaluated_at, count(*) AS cnt FROM (
  SELECT unnest(generate_series(date_trunc('minute', timestamp) + INTERVAL 1 MINUTE, date_trunc('minute', timestamp) + INTERVAL 5 MINUTE,
         INTERVAL 1 MINUTE)) AS e FROM log_events WHERE level = 'Error') GROUP BY e""", "log_events")
def _(spark, sf):
    """Every window that holds a match, however late it came."""
    counts = kept(spark, sf, lambda events, table: jobs.sliding_rule(events, table, LogQuery(level="Error")))
    return counts.select(show_ts(F.col("bucket_end")).alias("evaluated_at"), "cnt")


@query("stream_tail", f"""
SELECT id FROM (SELECT {_ID} AS id, date_trunc('millisecond', timestamp) AS t FROM log_events WHERE ({_N} // {LINES_PER_MESSAGE}) % 3 = 1)
ORDER BY t DESC, id LIMIT 500""", "log_events")
def _(spark, sf):
    """Every message is delivered twice, each id lands and is shown once; the page keeps the newest 500."""
    inbox, root = scratch(spark, "inbox"), scratch(spark, "landing")
    messages = clef_messages(spark, sf).select(F.col("message_id").alias("id"), F.col("raw").alias("body"))
    for delivery in range(2):
        messages.write.mode("append").json(inbox)
        files = len(spark.read.text(inbox).inputFiles()) if not delivery else files
    jobs.ingest_stream(spark, inbox, root, scratch(spark, "checkpoint"), AS_OF.isoformat(" "), max_files=max(1, files)).awaitTermination()
    landed = spark.readStream.schema(jobs.STORED).parquet(root).filter(F.col("outcome") == jobs.EVENTS)
    return newest_first(finish(jobs.tail(landed, LogQuery("app-1")), "tail"), 500).select("id")


@query("stream_tick", """
SELECT 'service-quiet' AS id, CAST(0 AS BIGINT) AS cnt UNION ALL
SELECT 'service-fatal', count(*) FILTER (WHERE source = 'svc-0' AND level = 'Fatal' AND timestamp > TIMESTAMP '2024-01-31' - INTERVAL 20000 MINUTE) FROM log_events""", "log_events")
def _(spark, sf):
    out = jobs.tick(log_events(spark, sf), [s for s in SPECS if s.id in ("service-quiet", "service-fatal")], AS_OF)
    return out.select("id", "cnt")


COOLDOWN_SQL = f"""
WITH RECURSIVE log_events AS ({CTES['log_events']}),
trig AS (SELECT DISTINCT source, date_trunc('minute', timestamp) AS timestamp FROM log_events WHERE level = 'Fatal'),
fired(id, fired_at) AS (
  SELECT source, min(timestamp) FROM trig GROUP BY source
  UNION ALL SELECT f.id, min(t.timestamp) FROM fired f JOIN trig t ON t.source = f.id AND t.timestamp >= f.fired_at + INTERVAL 1 HOUR * (12 + 12 * (length(f.id) % 2)) GROUP BY f.id)
SELECT id, strftime(fired_at, {TEXT_TIME}) AS fired_at FROM fired"""


@query("stream_cooldown", COOLDOWN_SQL)
def _(spark, sf):
    """Each rule has a cooldown of its own (half a day or a day), counted from its own last firing."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    path = scratch(spark, "triggers")
    minute = F.date_trunc("MINUTE", F.col("timestamp").cast("timestamp"))
    (log_events(spark, sf).filter(F.col("level") == "Fatal").select(F.col("source").alias("id"), minute.alias("triggered_at"))
     .distinct().withColumn("cooldown_seconds", F.when(F.length("id") % 2 == 1, 86400).otherwise(43200)).write.parquet(path))
    stream = spark.readStream.schema("id string, triggered_at timestamp, cooldown_seconds int").parquet(path)
    fired = finish(jobs.cooldown(stream), "cooldown")
    return fired.select("id", show_ts(F.col("triggered_at")).alias("fired_at"))

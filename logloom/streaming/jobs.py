"""Structured Streaming: ingest, rolling metrics, live tail, sliding rules, cooldown."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from logloom.functions.base import show_ts, ts_lit
from logloom.operators.aggregates import count_rows, error_count
from logloom.operators.filters import LogQuery, matches, where
from logloom.operators.rules import RuleSpec, rule_counts
from logloom.plans.ingest import parse_messages
from logloom.schema import DEAD_LETTER, EVENT
from logloom.sources.event_table import TABLE, arranged
from logloom.sources.messages import read_messages
from logloom.sources.storage import exists
from pyspark.sql import types as T

EVENTS, DEAD = "event", "dead_letter"
STORED = T.StructType([*EVENT.fields, *[f for f in DEAD_LETTER.fields if f.name not in EVENT.fieldNames()],
                       T.StructField("batch", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("dt", T.DateType())])


# --- ingest ------------------------------------------------------------------------------------------

def stored_rows(parsed: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """Parsed rows in the layout of the landing table: events by day, rejected payloads beside them."""
    now = F.current_timestamp() if as_of is None else ts_lit(as_of)
    rejected = F.col("reason").isNotNull()
    ts = F.date_trunc("MILLISECOND", F.when(rejected, now).otherwise(F.col("timestamp")))
    return (parsed.withColumn("timestamp", ts)
            .withColumn("outcome", F.when(rejected, DEAD).otherwise(EVENTS))
            .withColumn("batch", F.lit(None).cast("string")).withColumn("dt", F.to_date("timestamp")).select(*STORED.fieldNames()))


def write_landing(rows: DataFrame, root: str) -> None:
    """Events and dead letters in one job."""
    arranged(rows, "outcome", "dt").write.mode("append").partitionBy("outcome", "dt").parquet(root)


def landed_events(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(root).filter(F.col("outcome") == EVENTS).select(*TABLE.fieldNames())


def landed_dead_letters(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(root).filter(F.col("outcome") == DEAD).select(*DEAD_LETTER.fieldNames())


LEDGER = T.StructType([T.StructField("message_id", T.StringType()), T.StructField("part", T.IntegerType())])


class LandingWriter:
    """Micro-batch sink for parsed rows that stores every message once.

    Each batch is followed by its message ids in a ledger, which is partitioned by a hash of the id. Rows whose message is
    in the ledger are left out; a batch looks into the partitions of its own ids only. So neither a message that the queue
    delivers again nor a run over a lost checkpoint stores anything twice, whatever the order of files. The first batch
    after a start may be the replay of one that stopped half-way: its rows that are stored already are left out too.
    """

    def __init__(self, root: str, checkpoint: str, parts: int = 256):
        self.root, self.checkpoint, self.parts = root.rstrip("/"), checkpoint.rstrip("/"), parts
        self.run = ""

    @property
    def ledger(self) -> str:
        return f"{self.root}/_ledger"  # readers of the landing table skip names with an underscore

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("message_id"), F.lit(self.parts)).cast("int")

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        spark, starting = rows.sparkSession, not self.run
        if starting:  # a checkpoint has an id of its own
            self.run = json.loads(spark.read.text(f"{self.checkpoint}/metadata").first()[0])["id"]
        token = f"{self.run}-{batch_id}"
        rows = rows.withColumn("batch", F.lit(token)).select(*STORED.fieldNames()).dropDuplicates(["id"]).withColumn("part", self._part())
        # what is kept reads neither the landing table nor the ledger: a write to either would drop it and parse the batch again
        rows = rows.persist()
        try:
            fresh = rows
            if exists(spark, self.ledger):
                parts = [r["part"] for r in rows.select("part").distinct().collect()]  # at most the number of parts
                known = spark.read.schema(LEDGER).parquet(self.ledger).filter(F.col("part").isin(parts))
                fresh = rows.join(known, ["part", "message_id"], "left_anti")
            unstored = fresh
            if starting and exists(spark, self.root):
                half = spark.read.schema(STORED).parquet(self.root).filter(F.col("batch") == token).select("id")
                unstored = fresh.join(half, "id", "left_anti")
            write_landing(unstored.select(*STORED.fieldNames()), self.root)
            ids = fresh.select("message_id", "part").distinct()  # with those whose rows were stored by a batch that stopped
            ids.hint("rebalance", "part").write.mode("append").partitionBy("part").parquet(self.ledger)
        finally:
            rows.unpersist()


def ingest_stream(spark: SparkSession, inbox: str, root: str, checkpoint: str, as_of: datetime | str | None = None,
                  max_files: int = 100, every: str | None = None) -> StreamingQuery:
    """Ingest message files; without ``every`` it stops when the folder is read.

    Parsing is part of the streaming plan, which is built once; a micro-batch only runs it.
    """
    rows = stored_rows(parse_messages(read_messages(spark, inbox, stream=True, max_files=max_files), as_of), as_of)
    writer = rows.writeStream.foreachBatch(LandingWriter(root, checkpoint)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


# --- derived streams -----------------------------------------------------------------------------------

def event_time(stream: DataFrame) -> DataFrame:
    """Watermarks need a TIMESTAMP with time zone."""
    return stream.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


class BucketUpkeep:
    """Keeps a table of time buckets right as events land, however late they come.

    For the buckets that a batch touches, the measures are computed anew from the landed events and appended with a rising
    version; the highest version of a bucket counts. Nothing waits for a watermark, nothing is lost behind one, and a
    replayed batch only writes the same measures once more. ``events`` gives the landed rows (with the batch's among them).
    """

    def __init__(self, events: Callable[[SparkSession], DataFrame], table: str, measures: Callable[[], list[Column]],
                 width: str, slide: str | None = None, touching: Callable[[], Column] | None = None):
        self.events, self.table, self.measures = events, table, measures
        self.width, self.slide, self.touching = width, slide or width, touching
        self.before: int | None = None

    def _bucketed(self, events: DataFrame) -> DataFrame:
        return event_time(events).withColumn("w", F.window("timestamp", self.width, self.slide))

    def _version(self, spark: SparkSession, batch_id: int) -> int:
        if self.before is None:
            known = spark.read.parquet(self.table).agg(F.max("version")).first()[0] if exists(spark, self.table) else None
            self.before = 0 if known is None else known + 1
        return self.before + batch_id

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        hits = rows if self.touching is None else rows.filter(self.touching())
        touched = self._bucketed(hits).select("w").distinct().persist()
        try:
            span = touched.agg(F.min("w.start").alias("lo"), F.max("w.end").alias("hi"),
                               F.collect_set(F.to_date("w.start")).alias("first"), F.collect_set(F.to_date("w.end")).alias("last")).first()
            if span["lo"] is None:
                return
            landed = event_time(self.events(spark))
            if "dt" in landed.columns:  # days of the batch only
                landed = landed.filter(F.col("dt").isin(sorted({*span["first"], *span["last"]})))
            near = landed.filter((F.col("timestamp") >= F.lit(span["lo"])) & (F.col("timestamp") < F.lit(span["hi"])))
            counted = self._bucketed(near).join(touched, "w", "left_semi").groupBy("w").agg(*self.measures())
            names = [c for c in counted.columns if c != "w"]
            (counted.select(F.col("w.start").alias("bucket_start"), F.col("w.end").alias("bucket_end"), *names,
                            F.lit(self._version(spark, batch_id)).cast("bigint").alias("version"), F.to_date("w.start").alias("dt"))
             .hint("rebalance", "dt").write.mode("append").partitionBy("dt").parquet(self.table))
        finally:
            touched.unpersist()

    def run(self, stream: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Follow a stream of landed events; without ``every`` it stops when all of them are seen."""
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def kept_buckets(spark: SparkSession, table: str) -> DataFrame:
    """The latest measures of every bucket; one state per bucket and task before the shuffle."""
    rows = spark.read.parquet(table)
    names = [c for c in rows.columns if c not in ("bucket_start", "bucket_end", "version", "dt")]
    latest = F.max_by(F.struct(*names), "version").alias("m")
    return rows.groupBy("dt", "bucket_start", "bucket_end").agg(latest).select("bucket_start", "bucket_end", "m.*")


def rolling_metrics(events: Callable[[SparkSession], DataFrame], table: str, width: str = "1 minute") -> BucketUpkeep:
    """Counts, errors and warnings per tumbling window."""
    return BucketUpkeep(events, table, lambda: [
        count_rows().alias("count"), error_count().alias("errors"), F.count_if(F.col("level") == "Warning").alias("warnings")], width)


def sliding_rule(events: Callable[[SparkSession], DataFrame], table: str, query: LogQuery, width: str = "5 minutes",
                 slide: str = "1 minute") -> BucketUpkeep:
    """How many matching rows each sliding window holds; windows that no matching row touches have no row."""
    return BucketUpkeep(events, table, lambda: [F.count_if(matches(query)).alias("cnt")], width, slide, lambda: matches(query))


def tick(events: DataFrame, specs: list[RuleSpec], as_of: datetime) -> DataFrame:
    """Batch evaluation for one clock tick: also rules that wait for silence get their zero."""
    return rule_counts(events, specs, as_of).withColumn("evaluated_at", ts_lit(as_of))


def tail(stream: DataFrame, query: LogQuery) -> DataFrame:
    """Matching rows as they land. ``LandingWriter`` stores each id once, so there is no state to keep or to lose rows by."""
    return where(event_time(stream), query)


COOLDOWN_OUTPUT = "id string, triggered_at timestamp"


class Cooldown(StatefulProcessor):
    """Keeps each rule's last firing; lets a trigger through when the cooldown since then is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.last.get()
        last = pd.Timestamp(stored[0]) if stored is not None else None
        if last is not None and last.tzinfo is not None:
            last = last.tz_convert("UTC").tz_localize(None)
        fired = []
        # at most one row per rule and evaluation tick arrives here
        for moment, seconds in sorted(pair for chunk in rows for pair in zip(chunk["triggered_at"], chunk["cooldown_seconds"])):
            if last is None or (moment - last).total_seconds() >= seconds:
                last = moment
                fired.append(moment)
        if fired:
            self.last.update((last.to_pydatetime(),))
            yield pd.DataFrame({"id": [key[0]] * len(fired), "triggered_at": fired})

    def close(self) -> None:
        pass


def cooldown(triggers: DataFrame, seconds: int | None = None) -> DataFrame:
    """Stream of (id, triggered_at, cooldown_seconds) reduced to the firings that respect their rule's cooldown.

    ``seconds`` gives one cooldown to all rules instead.

    Needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider.
    """
    if seconds is not None:
        triggers = triggers.withColumn("cooldown_seconds", F.lit(seconds))
    return triggers.groupBy("id").transformWithStateInPandas(
        Cooldown(), outputStructType=COOLDOWN_OUTPUT, outputMode="Append", timeMode="None")


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over what is available and store its appended rows."""
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def shown(metrics: DataFrame) -> DataFrame:
    return metrics.select(show_ts(F.col("bucket_start")).alias("bucket"), "count", "errors", "warnings")

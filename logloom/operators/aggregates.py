"""Counts, rates, trends and discovery over the event table.

Every grouping here is an algebraic aggregate: partial results are combined before the shuffle, so one
source holding a large share of the rows costs its scan and nothing more.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.base import percent, show_ts, ts_lit, type_of
from logloom.operators.filters import LogQuery, has_props, is_plausible, last_interval, require_filter, time_between, where
from logloom.operators.search import newest_first
from logloom.schema import ERROR_LEVELS, PROBLEM_LEVELS
from logloom.session import scratch

# --- fixed values -------------------------------------------------------------------------------
GRANULARITIES = {"minute": "MINUTE", "hour": "HOUR", "day": "DAY"}
# ------------------------------------------------------------------------------------------------
DAY = timedelta(hours=24)


def is_error() -> Column:
    return F.col("level").isin(*ERROR_LEVELS)


def count_rows() -> Column:
    return F.count(F.lit(1))


def error_count() -> Column:
    return F.count_if(is_error())


def bucket(df: DataFrame, granularity: str) -> Column:
    """Start of the minute, hour or day, in the type of the timestamp column."""
    unit = GRANULARITIES.get(granularity, "HOUR")
    return F.date_trunc(unit, F.col("timestamp")).cast(type_of(df, "timestamp"))


def _per_bucket(df: DataFrame, granularity: str, name: str, *measures: Column) -> DataFrame:
    grouped = df.groupBy(bucket(df, granularity).alias("_bucket")).agg(*measures)
    return grouped.orderBy("_bucket").select(show_ts(F.col("_bucket")).alias(name),
                                             *[c for c in grouped.columns if c != "_bucket"])


def service_stats(df: DataFrame, as_of: datetime) -> DataFrame:
    return (last_interval(df, DAY, as_of).groupBy("source")
            .agg(count_rows().alias("total_count"), error_count().alias("error_count"), F.max("timestamp").alias("_last"))
            .orderBy(F.desc("total_count"), "source")
            .select("source", "total_count", "error_count", show_ts(F.col("_last")).alias("last_log")))


def time_series(df: DataFrame, as_of: datetime, minutes: int = 60) -> DataFrame:
    recent = last_interval(df, timedelta(minutes=minutes), as_of)
    return _per_bucket(recent, "minute", "minute", count_rows().alias("count"), error_count().alias("errors"))


def error_rate_series(df: DataFrame, as_of: datetime, minutes: int = 60) -> DataFrame:
    recent = last_interval(df, timedelta(minutes=minutes), as_of)
    return _per_bucket(recent, "minute", "minute", percent(error_count(), count_rows(), 2).alias("error_rate"))


def current_metrics(df: DataFrame, as_of: datetime) -> DataFrame:
    """One row over the last day; the last-minute count comes from the same scan."""
    minute_ago = ts_lit(as_of - timedelta(minutes=1), type_of(df, "timestamp"))
    per_source = last_interval(df, DAY, as_of).groupBy("source").agg(
        F.count_if(F.col("timestamp") > minute_ago).alias("m"), count_rows().alias("n"), error_count().alias("e"))
    return _totals(per_source)


def _totals(per_source: DataFrame) -> DataFrame:
    """The figures of a day from (source, n rows, e errors, m of the last minute)."""
    total, errors = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("e"), F.lit(0))
    return per_source.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("logs_per_minute"),
        total.alias("total_logs_24h"),
        errors.alias("total_errors_24h"),
        percent(errors, total, 2).alias("error_rate_24h"),
        F.count_if(F.col("n") > 0).alias("active_services"),
        F.count_if(F.col("e") > 0).alias("services_with_errors"))


def hour_over_hour(df: DataFrame, as_of: datetime) -> DataFrame:
    hour_ago = ts_lit(as_of - timedelta(hours=1), type_of(df, "timestamp"))
    current, previous = F.count_if(F.col("timestamp") > hour_ago), F.count_if(F.col("timestamp") <= hour_ago)
    return last_interval(df, timedelta(hours=2), as_of).agg(
        current.alias("current_hour_count"), previous.alias("previous_hour_count"),
        percent(current - previous, previous, 1).alias("trend_percent"))


def top_services_by_errors(df: DataFrame, as_of: datetime, k: int = 5) -> DataFrame:
    return (last_interval(df, DAY, as_of).groupBy("source")
            .agg(count_rows().alias("total_count"), error_count().alias("error_count"),
                 percent(error_count(), count_rows(), 2).alias("error_rate"), F.max("timestamp").alias("_last"))
            .orderBy(F.desc("error_count"), "source").limit(k)
            .select("source", "total_count", "error_count", "error_rate", show_ts(F.col("_last")).alias("last_log")))


def _hours(hours: int) -> timedelta:
    if hours < 1:
        raise ValueError("hours must be at least 1")
    return timedelta(hours=hours)


def error_summary(df: DataFrame, as_of: datetime, source: str = "", hours: int = 24, limit: int = 20) -> DataFrame:
    """Problem levels by template; the sample is the smallest message, so that it is the same on every run."""
    df = last_interval(df, _hours(hours), as_of).filter(F.col("level").isin(*PROBLEM_LEVELS))
    if source:
        df = df.filter(F.col("source") == source)
    return (df.groupBy("message_template", "level")
            .agg(count_rows().alias("count"), F.max("timestamp").alias("_last"), F.min("message").alias("sample_message"))
            .orderBy(F.desc("count"), "message_template", "level").limit(limit)
            .select("message_template", "level", "count", show_ts(F.col("_last")).alias("latest_timestamp"), "sample_message"))


def log_volume(df: DataFrame, as_of: datetime, source: str = "", hours: int = 24, granularity: str = "hour") -> DataFrame:
    df = last_interval(df, _hours(hours), as_of)
    if source:
        df = df.filter(F.col("source") == source)
    return _per_bucket(df, granularity, "bucket", count_rows().alias("total"), error_count().alias("errors"),
                       F.count_if(F.col("level") == "Warning").alias("warnings"),
                       F.count_if(F.col("level") == "Information").alias("info"))


def count_logs(df: DataFrame, query: LogQuery) -> DataFrame:
    require_filter(query, "count")
    return where(df, query).agg(count_rows().alias("count"))


def distinct_sources(df: DataFrame, as_of: datetime, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    return time_between(df, start, end, as_of).select("source").distinct().orderBy("source")


def active_levels(df: DataFrame, as_of: datetime) -> DataFrame:
    return last_interval(df, DAY, as_of).select("level").distinct().orderBy("level")


def table_totals(df: DataFrame, as_of: datetime) -> DataFrame:
    """All rows, rows of the last day, and the plausible time range, in one scan."""
    kind = type_of(df, "timestamp")
    usable = F.when(is_plausible(kind), F.col("timestamp"))
    return df.agg(count_rows().alias("total_logs"), F.count_if(F.col("timestamp") > ts_lit(as_of - DAY, kind)).alias("total_logs_24h"),
                  show_ts(F.min(usable)).alias("oldest_log"), show_ts(F.max(usable)).alias("newest_log"))


def partition_rows(df: DataFrame) -> DataFrame:
    """Rows per day, newest first."""
    day = F.col("dt") if "dt" in df.columns else F.to_date("timestamp")
    return (df.groupBy(F.date_format(day, "yyyyMMdd").alias("partition")).agg(count_rows().alias("rows"))
            .orderBy(F.desc("partition")))


def partition_stats(table: DataFrame) -> DataFrame:
    """Rows, files and bytes per day of a stored event table, newest first."""
    files = table.groupBy("dt", F.col("_metadata.file_path").alias("f")).agg(
        count_rows().alias("n"), F.max("_metadata.file_size").alias("size"))
    return (files.groupBy(F.date_format("dt", "yyyyMMdd").alias("partition"))
            .agg(F.sum("n").alias("rows"), F.sum("size").alias("size_bytes"), count_rows().alias("files"))
            .orderBy(F.desc("partition")))


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and bytes of every stored table, largest first."""
    out = None
    for name, frame in tables.items():
        files = frame.groupBy(F.col("_metadata.file_path").alias("f")).agg(
            count_rows().alias("n"), F.max("_metadata.file_size").alias("size"))
        row = files.agg(F.lit(name).alias("table"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                        F.coalesce(F.sum("size"), F.lit(0)).alias("size_bytes"))
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("size_bytes"), "table")


def property_keys(df: DataFrame, as_of: datetime | None = None, sample: int | None = None) -> DataFrame:
    """Top-level property names with a count and the first value seen (by time, then id).

    Without ``sample`` all rows count. With it, only the newest ``sample`` rows of the last hour do, which is
    the quick look the interactive pages use.
    """
    if as_of is not None:
        df = last_interval(df, timedelta(hours=1), as_of)
    df = df.filter(has_props())
    if sample is not None:
        df = newest_first(df, sample)
    members = (df.select("timestamp", "id", F.try_parse_json("properties").alias("_v"))
               .lateralJoin(_exploded()).filter(~F.is_variant_null(F.col("value"))))
    shape = F.schema_of_variant(F.col("value"))
    text = (F.when(shape.startswith("OBJECT") | shape.startswith("ARRAY"), "(object)")
            .otherwise(F.try_variant_get(F.col("value"), "$", "string")))
    return (members.select("key", text.alias("text"), F.struct("timestamp", "id").alias("seen"))
            .groupBy("key").agg(F.min_by("text", "seen").alias("sample_value"), count_rows().alias("count"))
            .orderBy("key"))


def _exploded() -> DataFrame:
    from pyspark.sql import SparkSession

    return SparkSession.active().tvf.variant_explode(F.col("_v").outer()).select("key", "value")


def overview(df: DataFrame, as_of: datetime, limit: int = 10) -> dict[str, DataFrame]:
    """The three parts of the landing page from one scan of the last 24 hours.

    One aggregation by source and, for problem levels, template and level is written to the shared folder; it grows with
    sources and templates, not with rows. The parts, with the columns of ``current_metrics``, ``service_stats`` and
    ``error_summary``, add its rows up and do not read the events again.
    """
    spark, minute_ago = df.sparkSession, ts_lit(as_of - timedelta(minutes=1), type_of(df, "timestamp"))
    problem = F.col("level").isin(*PROBLEM_LEVELS)
    saved = scratch(spark, "overview")
    (last_interval(df, DAY, as_of)
     .groupBy("source", F.when(problem, F.col("message_template")).alias("message_template"), F.when(problem, F.col("level")).alias("problem"))
     .agg(count_rows().alias("n"), error_count().alias("e"), F.count_if(F.col("timestamp") > minute_ago).alias("m"),
          F.max("timestamp").alias("last"), F.min("message").alias("sample")).write.parquet(saved))
    slice_ = spark.read.parquet(saved)
    per_source = slice_.groupBy("source").agg(*[F.sum(c).alias(c) for c in "nem"], F.max("last").alias("last"))
    services = (per_source.orderBy(F.desc("n"), "source")
                .select("source", F.col("n").alias("total_count"), F.col("e").alias("error_count"), show_ts(F.col("last")).alias("last_log")))
    errors = (slice_.filter(F.col("problem").isNotNull()).groupBy("message_template", F.col("problem").alias("level"))
              .agg(F.sum("n").alias("count"), F.max("last").alias("_last"), F.min("sample").alias("sample_message"))
              .orderBy(F.desc("count"), "message_template", "level").limit(limit)
              .select("message_template", "level", "count", show_ts(F.col("_last")).alias("latest_timestamp"), "sample_message"))
    return {"metrics": _totals(per_source), "services": services, "errors": errors}


def totals_from_services(stats: DataFrame) -> DataFrame:
    total, errors = F.coalesce(F.sum("total_count"), F.lit(0)), F.coalesce(F.sum("error_count"), F.lit(0))
    return stats.agg(total.alias("total_logs"), errors.alias("total_errors"), percent(errors, total, 2).alias("error_rate"))


def service_error_rates(stats: DataFrame) -> DataFrame:
    return stats.select("*", percent(F.col("error_count"), F.col("total_count"), 1).alias("error_rate"))


def sources_recent(df: DataFrame, as_of: datetime, minutes: int = 10) -> DataFrame:
    return (last_interval(df, timedelta(minutes=minutes), as_of).groupBy("source")
            .agg(count_rows().alias("count"), F.max("timestamp").alias("_last"))
            .orderBy(F.desc("count"), "source").select("source", "count", show_ts(F.col("_last")).alias("last_seen")))


def level_series(df: DataFrame, granularity: str, levels: dict[str, list[str]]) -> DataFrame:
    """Several conditional counts per time bucket (multi-series charts)."""
    return _per_bucket(df, granularity, "time",
                       *[F.count_if(F.col("level").isin(*names)).alias(label) for label, names in levels.items()])


def count_by(df: DataFrame, column: str, k: int, name: str = "name") -> DataFrame:
    """The ``k`` most frequent values (bar and pie charts)."""
    return (df.groupBy(F.col(column).alias(name)).agg(count_rows().alias("count"))
            .orderBy(F.desc("count"), name).limit(k))


def retention_policies(keys: DataFrame) -> DataFrame:
    """Longest retention per source among enabled keys; 0 means forever and is left out."""
    return (keys.filter((F.col("enabled") == 1) & (F.col("retention_days") > 0))
            .groupBy(F.col("name").alias("source")).agg(F.max("retention_days").alias("retention_days")))


def snapshot_totals(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size"),
                         F.count_if(F.col("type").isin("full", "legacy")).alias("full_count"),
                         F.count_if(F.col("type") == "incremental").alias("incremental_count"))

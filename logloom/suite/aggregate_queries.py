"""Counts, rates, trends, discovery, scaling."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from logloom.operators import aggregates as a
from logloom.operators import windows as w
from logloom.operators.filters import LogQuery, PropertyFilter
from logloom.operators.search import table_sort, union_formats
from logloom.session import scratch
from logloom.sources.event_table import read_events, write_events
from logloom.suite.base import AS_OF, NOW, TEXT_TIME, api_keys, doc_events, log_events, policy_log, query, snapshots

ERRORS = "count(*) FILTER (WHERE level IN ('Error', 'Fatal'))"
RATE = f"round({ERRORS} * CAST(100 AS DOUBLE) / count(*), 2)"
DAY = f"timestamp > {NOW} - INTERVAL 24 HOUR"
LAST = f"strftime(max(timestamp), {TEXT_TIME})"


@query("service_stats", f"""
SELECT source, count(*) AS total_count, {ERRORS} AS error_count, {LAST} AS last_log FROM log_events WHERE {DAY} GROUP BY source""", "log_events")
def _(spark, sf):
    return a.service_stats(log_events(spark, sf), AS_OF)


@query("time_series", f"""
SELECT strftime(date_trunc('minute', timestamp), {TEXT_TIME}) AS minute, count(*) AS count, {ERRORS} AS errors
FROM log_events WHERE timestamp > {NOW} - INTERVAL 43200 MINUTE GROUP BY date_trunc('minute', timestamp)""", "log_events")
def _(spark, sf):
    return a.time_series(log_events(spark, sf), AS_OF, 43200)


@query("error_rate_series", f"""
SELECT strftime(date_trunc('minute', timestamp), {TEXT_TIME}) AS minute, {RATE} AS error_rate
FROM log_events WHERE timestamp > {NOW} - INTERVAL 2880 MINUTE GROUP BY date_trunc('minute', timestamp)""", "log_events")
def _(spark, sf):
    return a.error_rate_series(log_events(spark, sf), AS_OF, 2880)


@query("current_metrics", f"""
SELECT count(*) FILTER (WHERE timestamp > {NOW} - INTERVAL 1 MINUTE) AS logs_per_minute, count(*) AS total_logs_24h,
       {ERRORS} AS total_errors_24h, CASE WHEN count(*) > 0 THEN {RATE} ELSE 0.0::DOUBLE END AS error_rate_24h,
       count(DISTINCT source) AS active_services,
       count(DISTINCT source) FILTER (WHERE level IN ('Error', 'Fatal')) AS services_with_errors
FROM log_events WHERE {DAY}""", "log_events")
def _(spark, sf):
    return a.current_metrics(log_events(spark, sf), AS_OF)


@query("hour_over_hour", f"""
SELECT cur AS current_hour_count, prev AS previous_hour_count,
       CASE WHEN prev > 0 THEN round((cur - prev) * CAST(100 AS DOUBLE) / prev, 1) ELSE 0.0::DOUBLE END AS trend_percent
FROM (SELECT count(*) FILTER (WHERE timestamp > {NOW} - INTERVAL 1 HOUR) AS cur,
             count(*) FILTER (WHERE timestamp <= {NOW} - INTERVAL 1 HOUR) AS prev
      FROM log_events WHERE timestamp > {NOW} - INTERVAL 2 HOUR)""", "log_events")
def _(spark, sf):
    return a.hour_over_hour(log_events(spark, sf), AS_OF)


@query("top_services_by_errors", f"""
SELECT source, count(*) AS total_count, {ERRORS} AS error_count, {RATE} AS error_rate, {LAST} AS last_log
FROM log_events WHERE {DAY} GROUP BY source ORDER BY error_count DESC, source LIMIT 5""", "log_events")
def _(spark, sf):
    return a.top_services_by_errors(log_events(spark, sf), AS_OF)


@query("error_summary", f"""
SELECT message_template, level, count(*) AS count, {LAST} AS latest_timestamp, min(message) AS sample_message
FROM log_events WHERE level IN ('Error', 'Fatal', 'Warning') AND timestamp > {NOW} - INTERVAL 1000 HOUR
GROUP BY message_template, level ORDER BY count DESC, message_template, level LIMIT 100""", "log_events")
def _(spark, sf):
    return a.error_summary(log_events(spark, sf), AS_OF, hours=1000, limit=500)


@query("error_summary_of_source", f"""
SELECT message_template, level, count(*) AS count, {LAST} AS latest_timestamp, min(message) AS sample_message
FROM log_events WHERE level IN ('Error', 'Fatal', 'Warning') AND {DAY} AND source = 'svc-2'
GROUP BY message_template, level ORDER BY count DESC, message_template, level LIMIT 20""", "log_events")
def _(spark, sf):
    return a.error_summary(log_events(spark, sf), AS_OF, "svc-2")


def _volume(name: str, granularity: str, hours: int, source: str = "") -> None:
    own = f" AND source = '{source}'" if source else ""

    @query(name, f"""
SELECT strftime(date_trunc('{granularity}', timestamp), {TEXT_TIME}) AS bucket, count(*) AS total, {ERRORS} AS errors,
       count(*) FILTER (WHERE level = 'Warning') AS warnings, count(*) FILTER (WHERE level = 'Information') AS info
FROM log_events WHERE timestamp > {NOW} - INTERVAL {hours} HOUR{own} GROUP BY date_trunc('{granularity}', timestamp)""", "log_events")
    def _(spark, sf):
        return a.log_volume(log_events(spark, sf), AS_OF, source, hours, granularity)


_volume("log_volume_minute", "minute", 24)
_volume("log_volume_hour", "hour", 168)
_volume("log_volume_day", "day", 168)
_volume("log_volume_of_source", "hour", 72, "svc-4")


@query("count_logs", """
SELECT count(*) AS count FROM log_events
WHERE source = 'svc-3' AND level = 'Debug' AND message LIKE '%view%' AND coalesce(CAST(properties->>'k' AS DOUBLE), 0) < 60""", "log_events")
def _(spark, sf):
    return a.count_logs(log_events(spark, sf), LogQuery("svc-3", "Debug", "view", (PropertyFilter("k", "60", "<"),)))


@query("distinct_sources", f"SELECT DISTINCT source FROM log_events WHERE {DAY}", "log_events")
def _(spark, sf):
    return a.distinct_sources(log_events(spark, sf), AS_OF)


@query("distinct_sources_in_range", "SELECT DISTINCT source FROM doc_events WHERE timestamp <= TIMESTAMP '2024-01-30 01:00:00'", "doc_events")
def _(spark, sf):
    return a.distinct_sources(doc_events(spark, sf), AS_OF, end=datetime(2024, 1, 30, 1))


@query("active_levels", f"SELECT DISTINCT level FROM log_events WHERE {DAY}", "log_events")
def _(spark, sf):
    return a.active_levels(log_events(spark, sf), AS_OF)


@query("table_totals", f"""
SELECT count(*) AS total_logs, count(*) FILTER (WHERE {DAY}) AS total_logs_24h,
       strftime(min(timestamp), {TEXT_TIME}) AS oldest_log, {LAST} AS newest_log FROM log_events""", "log_events")
def _(spark, sf):
    return a.table_totals(log_events(spark, sf), AS_OF)


@query("partition_rows", "SELECT strftime(timestamp, '%Y%m%d') AS partition, count(*) AS rows FROM log_events GROUP BY 1", "log_events")
def _(spark, sf):
    return a.partition_rows(log_events(spark, sf))


@query("partition_stats", """
SELECT strftime(timestamp, '%Y%m%d') AS partition, count(*) AS rows, true AS has_files, true AS has_bytes FROM log_events GROUP BY 1""", "log_events")
def _(spark, sf):
    """Sizes depend on the writer, so the check only asks that they are there."""
    path = scratch(spark, "events")
    write_events(log_events(spark, sf), path)
    return a.partition_stats(read_events(spark, path)).select(
        "partition", "rows", (F.col("files") > 0).alias("has_files"), (F.col("size_bytes") > 0).alias("has_bytes"))


@query("table_sizes", """
SELECT 'log_events' AS "table", (SELECT count(*) FROM log_events) AS rows, true AS has_bytes
UNION ALL SELECT 'doc_events', (SELECT count(*) FROM doc_events), true""", ["log_events", "doc_events"])
def _(spark, sf):
    tables = {}
    for name, frame in (("log_events", log_events(spark, sf)), ("doc_events", doc_events(spark, sf))):
        path = scratch(spark, name)
        write_events(frame, path)
        tables[name] = read_events(spark, path)
    return a.table_sizes(tables).select("table", "rows", (F.col("size_bytes") > 0).alias("has_bytes"))


@query("property_keys", """
SELECT key, min_by(val, (timestamp, CAST(id AS VARCHAR))) AS sample_value, count(*) AS count FROM (
  SELECT id, timestamp, 'lang' AS key, properties->>'lang' AS val FROM doc_events
  UNION ALL SELECT id, timestamp, 'n', '(object)' FROM doc_events) GROUP BY key""", "doc_events")
def _(spark, sf):
    return a.property_keys(doc_events(spark, sf))


@query("property_keys_sampled", f"""
SELECT 'k' AS key, min_by(properties->>'k', (timestamp, id)) AS sample_value, count(*) AS count FROM (
  SELECT * FROM log_events WHERE timestamp > {NOW} - INTERVAL 1 HOUR ORDER BY timestamp DESC, id LIMIT 100) HAVING count(*) > 0""", "log_events")
def _(spark, sf):
    return a.property_keys(log_events(spark, sf), AS_OF, sample=100)


@query("overview", f"""
SELECT 'metric' AS part, 'total' AS name, count(*) AS n FROM log_events WHERE {DAY}
UNION ALL SELECT 'service', source, count(*) FROM log_events WHERE {DAY} GROUP BY source
UNION ALL SELECT * FROM (SELECT 'error', level, count(*) AS n FROM log_events WHERE {DAY} AND level IN ('Error', 'Fatal', 'Warning')
  GROUP BY message_template, level ORDER BY n DESC, level LIMIT 10)""", "log_events")
def _(spark, sf):
    parts = a.overview(log_events(spark, sf), AS_OF)
    return union_formats(
        parts["metrics"].select(F.lit("metric").alias("part"), F.lit("total").alias("name"), F.col("total_logs_24h").alias("n")),
        parts["services"].select(F.lit("service").alias("part"), F.col("source").alias("name"), F.col("total_count").alias("n")),
        parts["errors"].select(F.lit("error").alias("part"), F.col("level").alias("name"), F.col("count").alias("n")))


@query("service_totals", f"""
SELECT count(*) AS total_logs, {ERRORS} AS total_errors, {RATE} AS error_rate FROM log_events WHERE {DAY}""", "log_events")
def _(spark, sf):
    return a.totals_from_services(a.service_stats(log_events(spark, sf), AS_OF))


@query("service_error_rates", f"""
SELECT source, count(*) AS total_count, round({ERRORS} * CAST(100 AS DOUBLE) / count(*), 1) AS error_rate
FROM log_events WHERE {DAY} GROUP BY source""", "log_events")
def _(spark, sf):
    return a.service_error_rates(a.service_stats(log_events(spark, sf), AS_OF)).select("source", "total_count", "error_rate")


@query("sources_recent", f"""
SELECT source, count(*) AS count, {LAST} AS last_seen FROM log_events WHERE timestamp > {NOW} - INTERVAL 600 MINUTE GROUP BY source""", "log_events")
def _(spark, sf):
    return a.sources_recent(log_events(spark, sf), AS_OF, 600)


@query("level_series", f"""
SELECT strftime(date_trunc('hour', timestamp), {TEXT_TIME}) AS time, {ERRORS} AS errors,
       count(*) FILTER (WHERE level = 'Warning') AS warnings FROM log_events GROUP BY date_trunc('hour', timestamp)""", "log_events")
def _(spark, sf):
    return a.level_series(log_events(spark, sf), "hour", {"errors": ["Error", "Fatal"], "warnings": ["Warning"]})


@query("top_values", """
SELECT source AS name, count(*) AS count FROM log_events WHERE level = 'Error' GROUP BY source ORDER BY count DESC, name LIMIT 8""", "log_events")
def _(spark, sf):
    return a.count_by(log_events(spark, sf).filter(F.col("level") == "Error"), "source", 8)


@query("retention_policies", """
SELECT name AS source, max(retention_days) AS retention_days FROM api_keys WHERE enabled = 1 AND retention_days > 0 GROUP BY name""", "api_keys")
def _(spark, sf):
    return a.retention_policies(api_keys(spark, sf))


@query("snapshot_totals", """
SELECT CAST(sum(size_bytes) AS BIGINT) AS total_size, count(*) FILTER (WHERE type IN ('full', 'legacy')) AS full_count,
       count(*) FILTER (WHERE type = 'incremental') AS incremental_count FROM snapshots""", "snapshots")
def _(spark, sf):
    return a.snapshot_totals(snapshots(spark, sf))


@query("latest_policies", "SELECT source, retention_days FROM policies", ["policy_log", "policies"])
def _(spark, sf):
    latest = w.latest_by(policy_log(spark, sf), "source", "updated_at")
    return latest.filter(F.col("retention_days") > 0).select("source", "retention_days")


HOURLY = "SELECT date_trunc('hour', timestamp) AS h, count(*) AS n FROM log_events GROUP BY 1"


@query("scaled_to_max", """
SELECT strftime(timestamp, '%Y%m%d') AS partition, count(*) AS rows,
       round(count(*) * CAST(100 AS DOUBLE) / max(count(*)) OVER (), 6) AS width_percent FROM log_events GROUP BY 1""", "log_events")
def _(spark, sf):
    scaled = w.scale_to_max(a.partition_rows(log_events(spark, sf)), "rows")
    return scaled.withColumn("width_percent", F.round("width_percent", 6))


@query("sparkline", f"""
SELECT strftime(h, {TEXT_TIME}) AS bucket, round((n - least(min(n) OVER (), 0)) / CAST(greatest(max(n) OVER (), 1) - least(min(n) OVER (), 0) AS DOUBLE)
       * 100, 6) AS height_percent FROM ({HOURLY})""", "log_events")
def _(spark, sf):
    hourly = a.level_series(log_events(spark, sf), "hour", {"n": ["Verbose", "Debug", "Information", "Warning", "Error", "Fatal"]})
    return w.sparkline(hourly, "n").select(F.col("time").alias("bucket"), F.round("height_percent", 6).alias("height_percent"))


@query("axis_labels_days", f"""
SELECT strftime(h, {TEXT_TIME}) AS time, strftime(h, '%b %-d') AS label FROM ({HOURLY})""", "log_events")
def _(spark, sf):
    hourly = a.level_series(log_events(spark, sf), "hour", {"n": ["Error"]})
    return w.axis_labels(hourly, "time").select("time", "label")


@query("axis_labels_hours", f"""
SELECT strftime(h, {TEXT_TIME}) AS time, strftime(h, '%I:%M %p') AS label FROM ({HOURLY}) WHERE h >= TIMESTAMP '2024-01-30 00:00:00'""", "log_events")
def _(spark, sf):
    recent = log_events(spark, sf).filter(F.col("timestamp") >= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))
    return w.axis_labels(a.level_series(recent, "hour", {"n": ["Error"]}), "time").select("time", "label")


@query("newest_snapshots", "SELECT name FROM snapshots ORDER BY right(name, 17) DESC, name LIMIT 50", "snapshots")
def _(spark, sf):
    return w.newest(snapshots(spark, sf), 50).select("name")


@query("table_sorted", """
SELECT id, CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN NULL ELSE CAST(properties->>'k' AS BIGINT) END AS k FROM log_events
ORDER BY k DESC NULLS LAST""", "log_events")
def _(spark, sf):
    ev = log_events(spark, sf)
    k = F.when(F.col("id").cast("bigint") % 7 == 0, F.lit(None)).otherwise(F.get_json_object("properties", "$.k").cast("bigint"))
    return table_sort(ev.select("id", k.alias("k")), "k")

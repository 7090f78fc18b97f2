"""Stored tables: deleting, retention, renaming, snapshots, config upkeep, user SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from logloom.operators.aggregates import count_rows
from logloom.operators.filters import LogQuery, PropertyFilter
from logloom.operators.joins import current_policies
from logloom.plans import maintenance as m
from logloom.plans import snapshots as sn
from logloom.plans import sqlapi
from logloom.session import scratch
from logloom.sources.config_tables import delete_rows, read_config, update_where, upsert_rows, write_config
from logloom.sources.event_table import append_event, compact, file_list, marked_shares, read_events, write_events
from logloom.suite.base import AS_OF, NOW, TEXT_TIME, alerts, api_keys, endpoints, log_events, policy_log, query, snapshots
from logloom.suite.join_queries import POLICY_CTES, TOO_OLD


def stored(spark, sf: str, label: str) -> str:
    path = scratch(spark, label)
    write_events(log_events(spark, sf), path)
    return path


GONE = "source = 'svc-2' AND coalesce(CAST(properties->>'k' AS DOUBLE), 0) >= 30"


@query("deleted_rows", f"""
SELECT source, count(*) AS n, (SELECT count(*) FROM log_events WHERE {GONE}) AS deleted FROM log_events WHERE NOT ({GONE}) GROUP BY source""", "log_events")
def _(spark, sf):
    """Delete by filter: the days that hold matches are rewritten, the rest stays."""
    path = stored(spark, sf, "delete")
    gone = m.delete_where(spark, path, LogQuery("svc-2", properties=(PropertyFilter("k", "30", ">="),)))
    left = read_events(spark, path).groupBy("source").agg(count_rows().alias("n"))
    return left.withColumn("deleted", F.lit(gone).cast("bigint"))


GONE_TWICE = "source = 'svc-2' OR level = 'Error'"


@query("folded_marks", f"""
SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS n, sum(CAST(id AS BIGINT)) AS ids, (SELECT count(*) FROM log_events WHERE {GONE_TWICE}) AS deleted,
  0 AS marked FROM log_events WHERE NOT ({GONE_TWICE}) GROUP BY 1""", "log_events")
def _(spark, sf):
    """Two deletes that overlap, with an append between them; then the marks are folded into the files."""
    path = scratch(spark, "fold")
    ev = log_events(spark, sf)
    late = F.col("id").cast("bigint") % 3 == 0
    write_events(ev.filter(~late), path)
    gone = m.delete_where(spark, path, LogQuery("svc-2"))
    write_events(ev.filter(late), path)
    gone += m.delete_where(spark, path, LogQuery(level="Error")) + m.delete_where(spark, path, LogQuery("svc-2"))
    m.fold_marks(spark, path, 0.0)
    left = spark.read.parquet(path).groupBy("dt").agg(count_rows().alias("n"), F.sum(F.col("id").cast("bigint")).alias("ids"))
    return left.select(F.date_format("dt", "yyyy-MM-dd").alias("day"), "n", "ids", F.lit(gone).cast("bigint").alias("deleted"),
                       F.lit(marked_shares(spark, path).count()).alias("marked"))


@query("retention_removed", f"SELECT source, count(*) AS removed FROM log_events e WHERE {TOO_OLD} GROUP BY source", POLICY_CTES)
def _(spark, sf):
    """What a retention pass reports per source; whole days go as folders, the rest as marks."""
    return m.apply_retention(spark, stored(spark, sf, "removed"), current_policies(policy_log(spark, sf)), AS_OF)


@query("appended_event", """
SELECT source, level, count(*) AS n FROM (SELECT source, level FROM log_events UNION ALL SELECT 'svc-1', 'Audit') GROUP BY source, level""", "log_events")
def _(spark, sf):
    """One event of the engine's own beside the stored ones."""
    path = stored(spark, sf, "append")
    write_events(append_event(spark, "Audit", "rows deleted", "svc-1", AS_OF), path)
    return read_events(spark, path).groupBy("source", "level").agg(count_rows().alias("n"))


@query("applied_retention", f"SELECT id, source FROM log_events e WHERE NOT {TOO_OLD}", POLICY_CTES)
def _(spark, sf):
    path = stored(spark, sf, "retention")
    m.apply_retention(spark, path, current_policies(policy_log(spark, sf)), AS_OF)
    return read_events(spark, path).select("id", "source")


@query("trimmed_counts", f"""
SELECT p.source, p.retention_days, (SELECT count(*) FROM log_events e WHERE e.source = p.source
  AND e.timestamp < {NOW} - INTERVAL 1 DAY * p.retention_days) AS expired FROM policies p""", POLICY_CTES)
def _(spark, sf):
    return m.trimmed_counts(log_events(spark, sf), current_policies(policy_log(spark, sf)), AS_OF)


@query("unmatched_policies", "SELECT DISTINCT source FROM policy_log WHERE source NOT IN (SELECT source FROM log_events)", ["log_events", "policy_log"])
def _(spark, sf):
    return m.unmatched_policies(log_events(spark, sf), policy_log(spark, sf)).select("source").distinct()


@query("renamed_source", "SELECT CASE WHEN source = 'svc-7' THEN 'svc-8' ELSE source END AS source, count(*) AS n FROM log_events GROUP BY 1", "log_events")
def _(spark, sf):
    path = stored(spark, sf, "rename")
    m.rename_source(spark, path, "svc-7", "svc-8")
    return read_events(spark, path).groupBy("source").agg(count_rows().alias("n"))


@query("compacted_days", "SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS n, true AS one_file FROM log_events GROUP BY 1", "log_events")
def _(spark, sf):
    """Three appends leave three files a day; compaction leaves one (small days) without changing rows."""
    path = scratch(spark, "compact")
    ev = log_events(spark, sf)
    for part in range(3):
        write_events(ev.filter(F.col("id").cast("bigint") % 3 == part), path)
    days = [r["dt"] for r in read_events(spark, path).select("dt").distinct().collect()]
    compact(spark, path, days)
    files = read_events(spark, path).groupBy("dt", F.col("_metadata.file_path")).agg(count_rows().alias("n"))
    return files.groupBy("dt").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("f")).select(
        F.date_format("dt", "yyyy-MM-dd").alias("day"), "n", (F.col("f") < 3).alias("one_file"))


@query("synced_policies", f"""
SELECT name AS source, max(retention_days) AS retention_days, strftime({NOW}, {TEXT_TIME}) AS updated_at FROM api_keys
WHERE enabled = 1 AND retention_days > 0 GROUP BY name""", "api_keys")
def _(spark, sf):
    """Written over the old policies, so sources without a key are gone."""
    path = scratch(spark, "policies")
    write_config(policy_log(spark, sf), path)
    write_config(m.sync_policies(api_keys(spark, sf), AS_OF), path)
    return spark.read.parquet(path).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query("upserted_keys", """
SELECT api_key, CASE WHEN CAST(substr(api_key, 5) AS BIGINT) % 4 = 1 THEN 'renamed' ELSE name END AS name,
  CASE WHEN CAST(substr(api_key, 5) AS BIGINT) % 4 = 1 THEN 90 ELSE retention_days END AS retention_days, created_at FROM api_keys
UNION ALL SELECT 'key-new', 'renamed', 90, 'x'""", "api_keys")
def _(spark, sf):
    keys = api_keys(spark, sf)
    changed = keys.filter(F.substring("api_key", 5, 10).cast("int") % 4 == 1)
    fresh = changed.agg(F.min("key_id").alias("key_id")).select(F.lit("key-new").alias("api_key"), "key_id", F.lit("").alias("name"), F.lit(1).alias("enabled"),
                                    F.lit("ingest").alias("scopes"), F.lit(0).cast("bigint").alias("retention_days"), F.lit("").alias("created_at"))
    changes = (changed.unionByName(fresh).withColumn("name", F.lit("renamed")).withColumn("retention_days", F.lit(90).cast("bigint"))
               .withColumn("created_at", F.lit("x")))
    return upsert_rows(keys, changes, "api_key", keep=("created_at",)).select("api_key", "name", "retention_days", "created_at")


@query("updated_alerts", f"""
SELECT id, CASE WHEN interval_seconds < 30 THEN 'slow' ELSE subject END AS subject,
  strftime(CASE WHEN interval_seconds < 30 THEN {NOW} ELSE last_triggered_at END, {TEXT_TIME}) AS last_triggered_at FROM alerts""", "alerts")
def _(spark, sf):
    from logloom.suite.base import as_of

    out = update_where(alerts(spark, sf), F.col("interval_seconds") < 30, {"subject": "slow", "last_triggered_at": as_of()})
    return out.select("id", "subject", F.date_format("last_triggered_at", "yyyy-MM-dd HH:mm:ss").alias("last_triggered_at"))


@query("deleted_config_rows", "SELECT id, name FROM alerts WHERE id != 'alert-7'", "alerts")
def _(spark, sf):
    path = scratch(spark, "alerts")
    write_config(alerts(spark, sf), path)
    write_config(delete_rows(read_config(spark, path), "id", "alert-7"), path)
    return read_config(spark, path).select("id", "name")


# --- snapshots ---------------------------------------------------------------------------------------

def _history(spark, sf: str) -> tuple[str, str]:
    """A full snapshot, then an append, a deletion and an incremental snapshot."""
    path, root = scratch(spark, "live"), scratch(spark, "snapshots")
    ev = log_events(spark, sf)
    late = F.col("timestamp") >= F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    write_events(ev.filter(~late), path)
    sn.take_snapshot(spark, path, root, datetime(2024, 1, 21, 3))
    write_events(ev.filter(late), path)
    m.delete_where(spark, path, LogQuery("svc-1", "Debug"))
    return path, root


@query("restored_increment", "SELECT id, source, level FROM log_events WHERE NOT (source = 'svc-1' AND level = 'Debug')", "log_events")
def _(spark, sf):
    """Base and increment restored to a new table: appended rows are there, deleted ones are not."""
    path, root = _history(spark, sf)
    name = sn.take_snapshot(spark, path, root, datetime(2024, 1, 22, 3))
    target = scratch(spark, "restored")
    sn.restore(spark, root, name, target)
    return read_events(spark, target).select("id", "source", "level")


@query("snapshot_touched_days", """
SELECT DISTINCT strftime(timestamp, '%Y-%m-%d') AS day FROM log_events
WHERE timestamp >= TIMESTAMP '2024-01-20 12:00:00' OR (source = 'svc-1' AND level = 'Debug')""", "log_events")
def _(spark, sf):
    """The days an increment has to read: those with another list of files or marks than the base."""
    path, root = _history(spark, sf)
    (base,) = [r["name"] for r in sn.read_manifest(spark, root).collect()]
    touched = sn.touched_days(file_list(spark, path), spark.read.parquet(f"{root}/{base}/files"))
    return touched.select(F.date_format("dt", "yyyy-MM-dd").alias("day"))


@query("snapshot_manifest", """
SELECT 'logs-full-2024-01-21-030000' AS name, 'full' AS type, 'none' AS base, (SELECT count(*) FROM log_events WHERE timestamp < TIMESTAMP '2024-01-20 12:00:00') AS rows
UNION ALL SELECT 'logs-incr-2024-01-22-030000', 'incremental', 'logs-full-2024-01-21-030000',
  (SELECT count(*) FROM log_events WHERE timestamp >= TIMESTAMP '2024-01-20 00:00:00') -
  (SELECT count(*) FROM log_events WHERE timestamp >= TIMESTAMP '2024-01-20 00:00:00' AND timestamp < TIMESTAMP '2024-01-20 12:00:00')""", "log_events")
def _(spark, sf):
    """Without a deletion the increment holds just the appended rows (half of one day and the later days)."""
    path, root = scratch(spark, "live"), scratch(spark, "snapshots")
    ev = log_events(spark, sf)
    late = F.col("timestamp") >= F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    write_events(ev.filter(~late), path)
    sn.take_snapshot(spark, path, root, datetime(2024, 1, 21, 3))
    write_events(ev.filter(late), path)
    sn.take_snapshot(spark, path, root, datetime(2024, 1, 22, 3))
    return sn.read_manifest(spark, root).select("name", "type", "base", "rows")


@query("listed_snapshots", f"""
SELECT name, strftime(timestamp, {TEXT_TIME}) AS timestamp, size_bytes,
  CASE WHEN starts_with(name, 'logs-full-') THEN 'full' WHEN starts_with(name, 'logs-incr-') THEN 'incremental' ELSE 'legacy' END AS type
FROM snapshots WHERE status = 'BACKUP_CREATED'""", "snapshots")
def _(spark, sf):
    return (sn.list_snapshots(snapshots(spark, sf)).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
            .drop("size_formatted"))


@query("prunable_snapshots", """
SELECT name FROM snapshots WHERE name NOT IN (SELECT name FROM snapshots ORDER BY right(name, 17) DESC, name LIMIT 200)
  AND name NOT IN (SELECT base FROM snapshots WHERE starts_with(name, 'logs-incr-'))""", "snapshots")
def _(spark, sf):
    return sn.prunable(snapshots(spark, sf), 200)


@query("restore_union", "SELECT source, count(*) AS n FROM log_events GROUP BY source", "log_events")
def _(spark, sf):
    ev = log_events(spark, sf)
    fatal = F.col("level") == "Fatal"
    return sn.restore_union(ev.filter(~fatal), ev.filter(fatal)).groupBy("source").agg(count_rows().alias("n"))


# --- user SQL ------------------------------------------------------------------------------------------

@query("user_select", """
SELECT source, level, count(*) AS n, rank() OVER (PARTITION BY source ORDER BY count(*) DESC, level) AS place FROM log_events GROUP BY source, level""", "log_events")
def _(spark, sf):
    """Free SQL with grouping and a window function under the row cap."""
    sqlapi.register(spark, {"user_events": log_events(spark, sf)})
    return sqlapi.run_select(spark, """SELECT source, level, count(*) AS n,
        rank() OVER (PARTITION BY source ORDER BY count(*) DESC, level) AS place FROM user_events GROUP BY source, level""")


@query("run_endpoint", "SELECT source, count(*) AS n FROM log_events WHERE level = 'Error' AND message LIKE 'User%' GROUP BY source", "log_events")
def _(spark, sf):
    """A stored query of the endpoint table with its two text parameters."""
    sqlapi.register(spark, {"events": log_events(spark, sf)})
    found = sqlapi.find_endpoint(endpoints(spark, sf), "ep-4").asDict()
    number = found["sql_query"].split("@like")[1].split()[0]
    return sqlapi.run_endpoint(spark, found, {"level": "Error", f"like{number}": "User%", "unused": "x", "bad name": "y"})


@query("run_widget", "SELECT source AS label, CAST(count(*) AS DOUBLE) AS value FROM log_events WHERE level = 'Warning' GROUP BY source", "log_events")
def _(spark, sf):
    sqlapi.register(spark, {"widget_events": log_events(spark, sf)})
    widget = {"id": "w", "type": "bar_chart", "title": "Warnings", "visualization": {"xField": "source", "yField": "n"},
              "dataSource": {"type": "inline", "sql": "SELECT source, count(*) AS n FROM widget_events WHERE level = @level GROUP BY source",
                             "params": {"level": "Warning"}}}
    return sqlapi.run_widget(spark, widget, endpoints(spark, sf))

"""Joins with keys, policies, destinations, endpoints and other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import joins as j
from logloom.operators.aggregates import count_rows, retention_policies
from logloom.operators.filters import last_interval, with_scope
from logloom.operators.rules import load_rules
from logloom.operators.shaping import widgets
from logloom.suite.aggregate_queries import DAY
from logloom.suite.base import (
    AS_OF, NOW, alerts, api_keys, dashboards, destinations, endpoints, log_events, policy_log, query, table, text,
)

POLICY_CTES = ["log_events", "policy_log", "policies"]
TOO_OLD = f"EXISTS (SELECT 1 FROM policies p WHERE p.source = e.source AND e.timestamp < {NOW} - INTERVAL 1 DAY * p.retention_days)"

# payloads carry an API key: known, disabled or unknown
PAYLOADS = "(SELECT event_id AS id, concat('key-', user_id % 120) AS api_key FROM events)"


def payloads(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.lit("?").alias("source"), F.concat(F.lit("key-"), text(F.col("user_id") % 120)).alias("api_key"))


@query("resolved_sources", f"SELECT p.id, k.name AS source FROM {PAYLOADS} p JOIN api_keys k USING (api_key) WHERE k.enabled = 1", "api_keys")
def _(spark, sf):
    return j.resolve_source(payloads(spark, sf), api_keys(spark, sf)).select("id", "source")


@query("rejected_payloads", f"""
SELECT p.id, p.api_key, CASE WHEN k.api_key IS NULL THEN 'Invalid API key' ELSE 'API key is disabled' END AS reason
FROM {PAYLOADS} p LEFT JOIN api_keys k USING (api_key) WHERE k.api_key IS NULL OR k.enabled = 0""", "api_keys")
def _(spark, sf):
    return j.rejected_payloads(payloads(spark, sf), api_keys(spark, sf)).select("id", "api_key", "reason")


@query("expired_events", f"SELECT id, source FROM log_events e WHERE {TOO_OLD}", POLICY_CTES)
def _(spark, sf):
    policies = j.current_policies(policy_log(spark, sf))
    return j.expired(log_events(spark, sf), policies, AS_OF).select("id", "source")


@query("retained_events", f"SELECT source, count(*) AS n FROM log_events e WHERE NOT {TOO_OLD} GROUP BY source", POLICY_CTES)
def _(spark, sf):
    policies = j.current_policies(policy_log(spark, sf))
    return j.retained(log_events(spark, sf), policies, AS_OF).groupBy("source").agg(count_rows().alias("n"))


@query("rule_targets", """
SELECT a.id AS rule, d.id AS destination_id, d.type AS channel, d.config FROM alerts a JOIN destinations d
  ON contains(a.destination_ids, '"' || d.id || '"') WHERE a.enabled = 1 AND d.enabled = 1
UNION ALL SELECT a.id, '', 'email', '{"email":"' || m.mail || '"}' FROM alerts a,
  LATERAL (SELECT unnest(string_split(trim(a.recipients, '[]"'), '","')) AS mail) m
  WHERE a.enabled = 1 AND NOT starts_with(a.destination_ids, '["') AND a.recipients != '[]'""", ["alerts", "destinations"])
def _(spark, sf):
    rows = j.targets(load_rules(alerts(spark, sf)), destinations(spark, sf))
    return rows.select(F.col("id").alias("rule"), "destination_id", "channel", "config")


@query("bound_widgets", """
SELECT c.dashboard, c.widget_id, CASE WHEN c.widget_id = 'b' THEN '' WHEN c.ep = '' THEN 'Endpoint name is required'
  WHEN e.name IS NULL THEN 'Endpoint not found' WHEN e.enabled = 0 THEN 'Endpoint is disabled' ELSE '' END AS error,
  CASE WHEN c.widget_id = 'b' THEN c.sql WHEN e.enabled = 1 THEN e.sql_query ELSE '' END AS sql
FROM (SELECT name AS dashboard, 'a' AS widget_id, json_extract_string(config, '$.widgets[0].dataSource.endpointName') AS ep, '' AS sql
      FROM dashboards WHERE config LIKE '%auto%'
      UNION ALL SELECT name, 'b', '', json_extract_string(config, '$.widgets[1].dataSource.sql') FROM dashboards WHERE config LIKE '%auto%') c
LEFT JOIN endpoints e ON e.name = c.ep""", ["dashboards", "endpoints"])
def _(spark, sf):
    return j.bind_endpoints(widgets(dashboards(spark, sf)), endpoints(spark, sf)).select("dashboard", "widget_id", "error", "sql")


@query("with_scalar", f"""
SELECT source, count(*) AS n, (SELECT count(*) FROM log_events WHERE {DAY}) AS last_day FROM log_events GROUP BY source""", "log_events")
def _(spark, sf):
    ev = log_events(spark, sf)
    recent = last_interval(ev, AS_OF - AS_OF.replace(day=30), AS_OF).agg(count_rows())
    return j.with_scalar(ev.groupBy("source").agg(count_rows().alias("n")), recent, "last_day")


@query("merged_registry", """
SELECT coalesce(k.api_key, r.api_key) AS api_key, coalesce(r.key_id, md5(k.api_key)) AS key_id,
  CASE WHEN k.api_key IS NULL THEN r.name WHEN starts_with(k.name, 'discovered-') THEN coalesce(r.name, k.name) ELSE k.name END AS name,
  CASE WHEN k.api_key IS NOT NULL THEN CASE WHEN k.enabled THEN 1 ELSE 0 END WHEN r.enabled = 0 THEN 0 ELSE 1 END AS enabled,
  CASE WHEN coalesce(r.scopes, '') = '' THEN 'ingest' ELSE r.scopes END AS scopes, coalesce(r.retention_days, 0) AS retention_days
FROM (SELECT concat('key-', c_custkey) AS api_key, CASE WHEN c_custkey % 2 = 0 THEN concat('discovered-', c_custkey) ELSE c_name END AS name,
             c_custkey % 5 != 0 AS enabled FROM customer WHERE c_custkey % 3 != 0) k
FULL OUTER JOIN api_keys r ON k.api_key = r.api_key""", "api_keys")
def _(spark, sf):
    k = F.col("c_custkey")
    known = table(spark, sf, "customer").filter(k % 3 != 0).select(
        F.concat(F.lit("key-"), text(k)).alias("key"),
        F.when(k % 2 == 0, F.concat(F.lit("discovered-"), text(k))).otherwise(F.col("c_name")).alias("name"), (k % 5 != 0).alias("enabled"))
    return j.merge_registry(known, api_keys(spark, sf)).drop("created_at")


@query("stale_policies", """
SELECT DISTINCT source FROM policy_log WHERE source NOT IN (
  SELECT name FROM api_keys WHERE enabled = 1 AND retention_days > 0 AND scopes = 'admin')""", ["policy_log", "api_keys"])
def _(spark, sf):
    current = retention_policies(with_scope(api_keys(spark, sf), "admin"))
    return j.stale(policy_log(spark, sf), current, "source").select("source").distinct()


@query("snapshot_delta", "SELECT id FROM log_events WHERE timestamp >= TIMESTAMP '2024-01-20 00:00:00' OR level = 'Fatal'", "log_events")
def _(spark, sf):
    ev = log_events(spark, sf).withColumn("dt", F.to_date("timestamp"))
    base = ev.filter((F.col("timestamp") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")) & (F.col("level") != "Fatal"))
    return j.delta(ev, base, ["dt", "id"]).select("id")

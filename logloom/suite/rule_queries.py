"""Alert rules over the derived rule table."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import rules as r
from logloom.operators.filters import LogQuery, PropertyFilter
from logloom.suite.base import (
    AS_OF, NOW, TEXT_TIME, alerts, as_of, destinations, log_events, query, table, text,
)

COOL = f"last_triggered_at > TIMESTAMP '1970-01-02' AND last_triggered_at > {NOW} - INTERVAL 1 SECOND * cooldown_seconds"
AGO = f"CAST(date_diff('minute', last_triggered_at, {NOW}) AS INTEGER)"
SHOWN = f"strftime(last_triggered_at, {TEXT_TIME})"


@query("loaded_rules", """
SELECT id, greatest(interval_seconds, 30) AS interval_seconds,
  CASE WHEN starts_with(destination_ids, '["') THEN 2 ELSE 0 END AS destinations, CASE WHEN recipients = '[]' THEN 0 ELSE 2 END AS recipients
FROM alerts WHERE enabled = 1""", "alerts")
def _(spark, sf):
    return r.load_rules(alerts(spark, sf)).select("id", "interval_seconds", F.size("destination_ids").alias("destinations"),
                                                  F.size("recipients").alias("recipients"))


@query("due_rules", """
SELECT id FROM (SELECT id, CAST(substr(id, 7) AS BIGINT) AS k, interval_seconds FROM alerts WHERE enabled = 1)
WHERE k % 4 = 0 OR k % 90 >= greatest(interval_seconds, 30)""", "alerts")
def _(spark, sf):
    rules = r.load_rules(alerts(spark, sf))
    k = F.substring("id", 7, 10).cast("int")
    state = rules.filter(k % 4 != 0).select(
        "id", (as_of() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), k % 90)).alias("last_run"))
    return r.due(rules, state, AS_OF).select("id")


SPECS = [
    r.RuleSpec("high-error-rate", LogQuery(), 5000, ("Error", "Fatal")),
    r.RuleSpec("service-fatal", LogQuery("svc-0", "Fatal"), 20000),
    r.RuleSpec("service-quiet", LogQuery("svc-99"), 10000),
    r.RuleSpec("large-k", LogQuery(search="purchase", properties=(PropertyFilter("k", "90", ">="),)), 40000),
]


@query("rule_counts", f"""
SELECT 'high-error-rate' AS id, count(*) FILTER (WHERE level IN ('Error', 'Fatal') AND timestamp > {NOW} - INTERVAL 5000 MINUTE) AS cnt FROM log_events
UNION ALL SELECT 'service-fatal', count(*) FILTER (WHERE source = 'svc-0' AND level = 'Fatal' AND timestamp > {NOW} - INTERVAL 20000 MINUTE) FROM log_events
UNION ALL SELECT 'service-quiet', 0 FROM (SELECT 1)
UNION ALL SELECT 'large-k', count(*) FILTER (WHERE message LIKE '%purchase%' AND CAST(properties->>'k' AS BIGINT) >= 90
  AND timestamp > {NOW} - INTERVAL 40000 MINUTE) FROM log_events""", "log_events")
def _(spark, sf):
    """Every rule in one scan; a rule that waits for silence gets its zero."""
    return r.rule_counts(log_events(spark, sf), SPECS, AS_OF)


@query("rule_evaluation", """
SELECT 'busy' AS id, n > 100 AS triggered, '' AS error FROM (SELECT count(*) AS n FROM log_events)
UNION ALL SELECT 'text', false, 'column who holds no number' UNION ALL SELECT 'empty', false, 'query returned no rows'
UNION ALL SELECT 'unknown', false, 'no column total in the result'""", "log_events")
def _(spark, sf):
    """Rule SQL over the whole table, judged by its condition; errors stay with their rule."""
    ev = log_events(spark, sf)
    ev.createOrReplaceTempView("rule_events")
    first = ev.agg(F.min("id").alias("x"))
    made = [("busy", "SELECT count(*) AS cnt FROM rule_events", "cnt > 100"), ("text", "SELECT max(source) AS who FROM rule_events", "who > 1"),
            ("empty", "SELECT id FROM rule_events WHERE source = 'none'", "id > 1"), ("unknown", "SELECT count(*) AS cnt FROM rule_events", "total > 1")]
    rows = F.array(*[F.struct(F.lit(a).alias("id"), F.lit(b).alias("query"), F.lit(c).alias("condition")) for a, b, c in made])
    out = r.evaluate_rules(spark, first.select(F.inline(rows)))
    return out.select("id", "triggered", F.coalesce("error", F.lit("")).alias("error"))


_LINE = "CAST(l_quantity AS DOUBLE) AS q, CAST(l_linenumber AS DOUBLE) AS n, l_orderkey % 6 AS c, l_orderkey || '-' || l_linenumber AS id"


@query("rule_conditions", f"""
SELECT id, CASE c WHEN 0 THEN q >= 25 WHEN 1 THEN (q > 40 OR n == 1) AND q < 45 WHEN 2 THEN q != 10 AND n <= 3 WHEN 3 THEN NULL WHEN 4 THEN NULL
  ELSE n == 2 OR n == 3 END AS ok,
  CASE c WHEN 3 THEN 'no column total in the result' WHEN 4 THEN 'no comparison in condition: q about 5' ELSE '' END AS error
FROM (SELECT {_LINE} FROM lineitem)""")
def _(spark, sf):
    """One condition per row; ``||`` splits inside ``&&``."""
    li = table(spark, sf, "lineitem")
    texts = ["q >= 25", "q > 40 || n == 1 && q < 45", "q != 10 && n <= 3", "q > 1 && total > 5", "q about 5", "n == 2 || n == 3.0"]
    condition = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("l_orderkey") % 6 + 1).cast("int"))
    values = F.create_map(F.lit("q"), F.col("l_quantity").cast("double"), F.lit("n"), F.col("l_linenumber").cast("double"))
    rows = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), condition.alias("condition"), values.alias("values"))
    return r.judge(rows, "condition", "values", name="o").select("id", F.col("o.ok").alias("ok"), F.coalesce("o.error", F.lit("")).alias("error"))


@query("firing_alerts", f"""
SELECT id, name, description, {SHOWN} AS last_triggered_at, {AGO} AS minutes_ago FROM alerts WHERE enabled = 1 AND {COOL}""", "alerts")
def _(spark, sf):
    return r.firing_alerts(alerts(spark, sf), AS_OF)


@query("alerts_with_status", f"""
SELECT id, name, description, enabled, {SHOWN} AS last_triggered_at, cooldown_seconds,
  CASE WHEN {COOL} THEN 'firing' WHEN last_triggered_at > TIMESTAMP '1970-01-02' AND last_triggered_at > {NOW} - INTERVAL 24 HOUR THEN 'recent' ELSE 'ok' END AS status,
  CASE WHEN last_triggered_at > TIMESTAMP '1970-01-02' THEN {AGO} END AS minutes_ago FROM alerts WHERE enabled = 1""", "alerts")
def _(spark, sf):
    return r.alerts_with_status(alerts(spark, sf), AS_OF)


@query("rules_out_of_cooldown", f"SELECT id FROM alerts WHERE date_sub('second', last_triggered_at, {NOW}) >= cooldown_seconds", "alerts")
def _(spark, sf):
    return r.out_of_cooldown(alerts(spark, sf), AS_OF).select("id")


@query("notification_rows", """
SELECT a.id AS alert_id, d.id AS destination_id, d.type AS channel,
  CASE WHEN d.type = 'email' THEN json_extract_string(d.config, '$.email') ELSE json_extract_string(d.config, '$.url') END AS address,
  CASE WHEN d.type = 'email' THEN '' ELSE 'POST' END AS method,
  CASE WHEN d.type = 'email' THEN 0 WHEN CAST(d.config->>'timeout_seconds' AS INT) > 0 THEN CAST(d.config->>'timeout_seconds' AS INT) ELSE 10 END AS timeout_seconds,
  a.name AS payload_name, '7.0' AS cnt FROM alerts a JOIN destinations d ON contains(a.destination_ids, '"' || d.id || '"')
WHERE a.enabled = 1 AND d.enabled = 1
UNION ALL SELECT a.id, '', 'email', m.mail, '', 0, a.name, '7.0' FROM alerts a,
  LATERAL (SELECT unnest(string_split(trim(a.recipients, '[]"'), '","')) AS mail) m
  WHERE a.enabled = 1 AND NOT starts_with(a.destination_ids, '["') AND a.recipients != '[]'""", ["alerts", "destinations"])
def _(spark, sf):
    fired = r.load_rules(alerts(spark, sf)).withColumn("values", F.create_map(F.lit("cnt"), F.lit(7.0)))
    rows = r.notification_rows(fired, destinations(spark, sf), AS_OF)
    return rows.select("alert_id", "destination_id", "channel", "address", "method", "timeout_seconds",
                       F.get_json_object("payload", "$.alert_name").alias("payload_name"),
                       F.get_json_object("payload", "$.query_result.cnt").alias("cnt"))


@query("forwarded_events", f"""
SELECT 'dest-1' AS destination_id, id, concat('Manual: ', source) AS name, message, strftime(timestamp, {TEXT_TIME}) AS at,
  concat('SELECT * FROM events WHERE id = ''', id, '''') AS query, properties->>'k' AS k FROM log_events WHERE level = 'Fatal'""", "log_events")
def _(spark, sf):
    out = r.forward_event(log_events(spark, sf).filter(F.col("level") == "Fatal"), "dest-1")

    def part(path: str):
        return F.get_json_object("payload", f"$.{path}")

    return out.select("destination_id", part("query_result.id").alias("id"), part("alert_name").alias("name"), part("description").alias("message"),
                      part("triggered_at").alias("at"), part("query").alias("query"), part("query_result.properties.k").alias("k"))


@query("validated_rules", """
SELECT id, array_to_string(list_filter([
  CASE query WHEN '' THEN 'query: must not be empty' WHEN 'DELETE FROM events' THEN 'query: has to begin with SELECT' END,
  CASE WHEN condition = '' THEN 'condition: must not be empty' END, CASE WHEN subject = '' THEN 'subject: must not be empty' END,
  CASE WHEN NOT starts_with(destination_ids, '["') AND recipients = '[]' THEN 'destination_ids: nobody to notify (no destination, no recipient)' END,
  CASE WHEN interval_seconds != 0 AND interval_seconds < 30 THEN 'interval_seconds: below the shortest interval of 30 s' END], lambda x: x IS NOT NULL), '; ') AS errors
FROM alerts""", "alerts")
def _(spark, sf):
    return r.validate_rules(alerts(spark, sf)).select("id", F.array_join("errors", "; ").alias("errors"))


@query("tested_rule", "SELECT source, count(*) AS n FROM log_events WHERE level = 'Error' GROUP BY source", "log_events")
def _(spark, sf):
    log_events(spark, sf).createOrReplaceTempView("rule_events")
    return r.test_rule(spark, "SELECT source, count(*) AS n FROM rule_events WHERE level = 'Error' GROUP BY source")

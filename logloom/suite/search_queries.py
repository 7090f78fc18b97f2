"""Search, filters, paging, lookups."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from logloom.functions.base import show_ts
from logloom.operators import filters as f
from logloom.operators import search as s
from logloom.operators.timerange import TimeRange, shift_range
from logloom.suite.base import AS_OF, NOW, TEXT_TIME, doc_events, api_keys, log_events, query, table

EVENT_SQL = (f"SELECT id, strftime(timestamp, {TEXT_TIME}) AS timestamp, level, message_template, message, exception,"
             " event_type, source, properties FROM log_events")
LIVE_SQL = (f"SELECT id, strftime(timestamp, {TEXT_TIME}) AS timestamp, level, message, source, exception, properties"
            " FROM log_events")
NEWEST = "ORDER BY e_ts DESC, id LIMIT"


def _top(select: str, where: str, n: int) -> str:
    inner = select.replace(" FROM log_events", f", timestamp AS e_ts FROM log_events WHERE {where}")
    return f"SELECT * EXCLUDE (e_ts) FROM ({inner} {NEWEST} {n})".replace(
        ", timestamp AS e_ts FROM log_events", ", log_events.timestamp AS e_ts FROM log_events")


LAST_DAY = f"log_events.timestamp > {NOW} - INTERVAL 24 HOUR"
NUMBER = "coalesce(CAST(properties->>'k' AS DOUBLE), 0)"


@query("search_logs", _top(EVENT_SQL, f"{LAST_DAY} AND source = 'svc-3' AND level = 'Error' AND message LIKE '%User%error%'", 100), "log_events")
def _(spark, sf):
    return s.search_logs(log_events(spark, sf), f.LogQuery("svc-3", "Error", "User%error"), AS_OF)


@query("search_time_range", _top(EVENT_SQL, "log_events.timestamp >= TIMESTAMP '2024-01-10 06:00:00'"
                                 " AND log_events.timestamp <= TIMESTAMP '2024-01-12 00:00:00'", 1000), "log_events")
def _(spark, sf):
    return s.search_logs(log_events(spark, sf), f.LogQuery(), AS_OF, datetime(2024, 1, 10, 6, 0, 0, 500),
                         datetime(2024, 1, 12), limit=5000)


@query("search_logs_live", _top(LIVE_SQL, f"log_events.timestamp > {NOW} - INTERVAL 7 DAY"
                                f" AND log_events.timestamp > {NOW} - INTERVAL 3 DAY AND source = 'svc-1'", 100), "log_events")
def _(spark, sf):
    return s.search_live(log_events(spark, sf), f.LogQuery("svc-1"), AS_OF, "week", since=AS_OF - timedelta(days=3))


@query("search_prop_numeric", _top(EVENT_SQL, f"{LAST_DAY} AND {NUMBER} >= 50 AND {NUMBER} != 77", 100), "log_events")
def _(spark, sf):
    q = f.LogQuery(properties=f.parse_property_params({"prop.k": ">=50", "other": "x"}) + (f.PropertyFilter("k", "77", "!="),))
    return s.search_logs(log_events(spark, sf), q, AS_OF)


@query("search_prop_missing", f"""
SELECT (SELECT count(*) FROM log_events WHERE coalesce(CAST(properties->>'absent' AS DOUBLE), 0) < 5) AS number_missing,
       (SELECT count(*) FROM log_events WHERE coalesce(properties->>'absent', '') != 'x') AS text_missing,
       (SELECT count(*) FROM log_events WHERE '' = 'x') AS text_equal,
       (SELECT count(*) FROM log_events WHERE {NUMBER} = 0) AS zero""", "log_events")
def _(spark, sf):
    """Absent keys count as 0 and as empty text."""
    wanted = {"number_missing": f.PropertyFilter("absent", "5", "<"), "text_missing": f.PropertyFilter("absent", "x", "!="),
              "text_equal": f.PropertyFilter("k", "x", ">"), "zero": f.PropertyFilter("k", "0")}
    return log_events(spark, sf).agg(*[F.count_if(f.prop_filter(p)).alias(n) for n, p in wanted.items()])


@query("search_prop_nested", """
SELECT source, count(*) AS n FROM doc_events
WHERE CAST(properties->'n'->>'chars' AS BIGINT) > 1000 AND properties->>'lang' = 'fr' GROUP BY source""", "doc_events")
def _(spark, sf):
    q = f.LogQuery(properties=(f.PropertyFilter("n.chars", "1000", ">"), f.PropertyFilter("lang", "fr")))
    return f.where(doc_events(spark, sf), q).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("search_text_documents", """
SELECT id, source, length(message) AS chars FROM doc_events WHERE message LIKE '%the%' AND message NOT ILIKE '%license%'""", "doc_events")
def _(spark, sf):
    d = doc_events(spark, sf).filter(f.message_like("the")).filter(~f.message_ilike("LICENSE"))
    return d.select("id", "source", F.length("message").cast("bigint").alias("chars"))


@query("message_contains_strict", "SELECT count(*) AS n FROM doc_events WHERE contains(message, '%')", "doc_events")
def _(spark, sf):
    return doc_events(spark, sf).filter(f.message_contains("%")).agg(F.count(F.lit(1)).alias("n"))


@query("filter_presets", f"""
SELECT '30m' AS preset, count(*) FILTER (WHERE timestamp >= {NOW} - INTERVAL 30 MINUTE) AS n FROM log_events
UNION ALL SELECT '6h', count(*) FILTER (WHERE timestamp >= {NOW} - INTERVAL 6 HOUR) FROM log_events
UNION ALL SELECT 'today', count(*) FILTER (WHERE timestamp >= {NOW}) FROM log_events
UNION ALL SELECT 'week', count(*) FILTER (WHERE timestamp >= TIMESTAMP '2024-01-29 00:00:00') FROM log_events
UNION ALL SELECT 'all', count(*) FILTER (WHERE timestamp > {NOW} - INTERVAL 24 HOUR) FROM log_events""", "log_events")
def _(spark, sf):
    ev = log_events(spark, sf)
    parts = [f.in_range(ev, TimeRange(p), AS_OF, compat=True).agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("preset"), "n")
             for p in ("30m", "6h", "today", "week", "all")]
    return s.union_formats(*parts)


@query("filter_live_presets", f"""
SELECT 'week' AS preset, count(*) FILTER (WHERE timestamp > {NOW} - INTERVAL 7 DAY) AS n FROM log_events
UNION ALL SELECT 'all', count(*) FILTER (WHERE timestamp > {NOW} - INTERVAL 365 DAY) FROM log_events
UNION ALL SELECT 'now', count(*) FILTER (WHERE timestamp > {NOW} - INTERVAL 5 MINUTE) FROM log_events""", "log_events")
def _(spark, sf):
    ev = log_events(spark, sf)
    parts = [f.live_range(ev, p, AS_OF).agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("preset"), "n")
             for p in ("week", "all", "now")]
    return s.union_formats(*parts)


@query("filter_shifted_range", """
SELECT source, count(*) AS n FROM log_events
WHERE timestamp >= TIMESTAMP '2024-01-30 16:00:00' AND timestamp <= TIMESTAMP '2024-01-30 20:00:00' GROUP BY source""", "log_events")
def _(spark, sf):
    """One step back from the last four hours; the step forward from there would pass ``now`` and is refused."""
    back = shift_range(TimeRange("4h"), "backward", AS_OF)
    assert shift_range(TimeRange("4h"), "forward", AS_OF) == TimeRange("4h")
    return f.in_range(log_events(spark, sf), back, AS_OF).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("filter_newer_than", "SELECT id, source FROM log_events WHERE timestamp > TIMESTAMP '2024-01-30 12:00:00'", "log_events")
def _(spark, sf):
    return f.newer_than(log_events(spark, sf), datetime(2024, 1, 30, 12)).select("id", "source")


@query("filter_plausible_time", """
SELECT count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS oldest FROM (
  SELECT CASE WHEN CAST(id AS BIGINT) % 100 = 0 THEN TIMESTAMP '1970-01-01 00:00:00' ELSE timestamp END AS ts FROM log_events)
WHERE ts > TIMESTAMP '2000-01-01' AND ts < TIMESTAMP '2100-01-01'""", "log_events")
def _(spark, sf):
    ev = log_events(spark, sf).withColumn("timestamp", F.when(
        F.col("id").cast("bigint") % 100 == 0, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).otherwise(F.col("timestamp")))
    return f.plausible_ts(ev).agg(F.count(F.lit(1)).alias("n"), show_ts(F.min("timestamp")).alias("oldest"))


@query("filter_has_properties", """
SELECT count(*) FILTER (WHERE properties != '' AND properties != '{}') AS with_props,
       count(*) FILTER (WHERE json_exists(properties, '$.k')) AS with_k,
       count(*) FILTER (WHERE json_exists(properties, '$.zz')) AS with_zz FROM log_events""", "log_events")
def _(spark, sf):
    return log_events(spark, sf).agg(F.count_if(f.has_props()).alias("with_props"), F.count_if(f.has_key("k")).alias("with_k"),
                                     F.count_if(f.has_key("zz")).alias("with_zz"))


@query("property_columns", """
SELECT id, properties->>'lang' AS lang, properties->'n'->>'chars' AS "n.chars", CAST(NULL AS VARCHAR) AS "n", CAST(NULL AS VARCHAR) AS missing
FROM doc_events""", "doc_events")
def _(spark, sf):
    out = f.with_property_columns(doc_events(spark, sf), ["lang", "n.chars", "n", "missing"])
    return out.select("id", "lang", F.col("`n.chars`"), "n", "missing")


@query("saved_query_search", _top(EVENT_SQL, f"{LAST_DAY} AND source = 'svc-5' AND {NUMBER} > 20 AND message LIKE '%did%'", 100), "log_events")
def _(spark, sf):
    """The stored criteria come from a row that Spark derives from the events themselves."""
    row = (log_events(spark, sf).filter(F.col("source") == "svc-5").agg(
        F.min("source").alias("source"), F.lit("").alias("level"), F.lit("did").alias("search"),
        F.lit('[{"key":"k","value":"20","operator":">"}]').alias("property_filters")).first().asDict())
    return s.search_logs(log_events(spark, sf), f.from_saved_query(row), AS_OF)


@query("keys_with_scope", """
SELECT api_key, name FROM api_keys
WHERE enabled = 1 AND (scopes LIKE '%read%' OR scopes LIKE '%write%' OR scopes LIKE '%admin%')""", "api_keys")
def _(spark, sf):
    return f.with_scope(api_keys(spark, sf), "read").select("api_key", "name")


@query("keys_with_ingest_scope", "SELECT api_key, name FROM api_keys WHERE enabled = 1", "api_keys")
def _(spark, sf):
    return f.with_scope(api_keys(spark, sf), "ingest").select("api_key", "name")


@query("newest_first", _top(EVENT_SQL, "true", 250), "log_events")
def _(spark, sf):
    return s.project_events(s.newest_first(log_events(spark, sf), 250))


@query("lookup_by_id", EVENT_SQL + " WHERE id = '777'", "log_events")
def _(spark, sf):
    return s.project_events(s.lookup_by(log_events(spark, sf), "id", "777"))


@query("unseen_events", f"""
SELECT id FROM log_events WHERE {LAST_DAY} AND id NOT IN (
  SELECT id FROM log_events WHERE timestamp > {NOW} - INTERVAL 24 HOUR AND timestamp <= {NOW} - INTERVAL 4 HOUR)""", "log_events")
def _(spark, sf):
    ev = log_events(spark, sf)
    shown = f.time_between(ev, AS_OF - timedelta(hours=24), AS_OF - timedelta(hours=4), AS_OF)
    return s.unseen(f.last_interval(ev, timedelta(hours=24), AS_OF), shown).select("id")


@query("tail_page", """
, page AS (SELECT id, timestamp FROM log_events WHERE timestamp > TIMESTAMP '2024-01-30 12:00:00' ORDER BY timestamp DESC, id LIMIT 100),
     shown AS (SELECT id, timestamp FROM log_events WHERE timestamp <= TIMESTAMP '2024-01-30 12:00:00' ORDER BY timestamp DESC, id LIMIT 450)
SELECT id FROM (SELECT * FROM page UNION ALL SELECT * FROM shown) ORDER BY timestamp DESC, id LIMIT 500""", "log_events")
def _(spark, sf):
    ev = log_events(spark, sf).select("id", "timestamp")
    shown = s.newest_first(f.time_between(ev, None, datetime(2024, 1, 30, 12), AS_OF), 450)
    return s.tail_page(shown, f.newer_than(ev, datetime(2024, 1, 30, 12)), s.LIVE_PAGE, s.LIVE_KEEP).select("id")


@query("prepend_event", """
SELECT id, message FROM log_events WHERE id = '5' OR id IN (SELECT id FROM log_events ORDER BY timestamp DESC, id LIMIT 100)""", "log_events")
def _(spark, sf):
    ev = log_events(spark, sf)
    return s.prepend_event(s.newest_first(ev), s.lookup_by(ev, "id", "5")).select("id", "message")


@query("capped_rows", "SELECT CAST(least(10000, count(*)) AS BIGINT) AS n FROM lineitem")
def _(spark, sf):
    """Counts what is left of a large result under the row cap."""
    return s.cap_rows(table(spark, sf, "lineitem"), s.ROW_CAP).agg(F.count(F.lit(1)).alias("n"))


@query("rows_by_status", """
SELECT id, CASE WHEN level IN ('Error', 'Fatal') THEN 'firing' WHEN level = 'Warning' THEN 'recent' ELSE 'ok' END AS status
FROM log_events""", "log_events")
def _(spark, sf):
    status = F.when(F.col("level").isin("Error", "Fatal"), "firing").when(F.col("level") == "Warning", "recent").otherwise("ok")
    rows = log_events(spark, sf).select("id", status.alias("status"), F.col("timestamp").alias("triggered_at"))
    return s.order_by_status(rows).select("id", "status")

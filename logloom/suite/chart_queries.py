"""Results shaped for charts, and dashboard checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import aggregates as a
from logloom.operators import shaping as g
from logloom.suite.base import NOW, TEXT_TIME, dashboards, log_events, query, table

HOURS = f"""SELECT strftime(date_trunc('hour', timestamp), {TEXT_TIME}) AS label, count(*) FILTER (WHERE level IN ('Error', 'Fatal')) AS errors,
  count(*) FILTER (WHERE level = 'Warning') AS warnings FROM log_events GROUP BY 1"""


def hours(spark, sf):
    return a.level_series(log_events(spark, sf), "hour", {"errors": ["Error", "Fatal"], "warnings": ["Warning"]})


@query("chart_stat", "SELECT CAST(count(*) AS DOUBLE) AS value, format('{:,}', count(*)) AS display FROM log_events WHERE level = 'Error'", "log_events")
def _(spark, sf):
    return g.stat(log_events(spark, sf).filter(F.col("level") == "Error").agg(a.count_rows().alias("value")))


@query("chart_line", f"SELECT label, CAST(errors AS DOUBLE) AS errors, CAST(warnings AS DOUBLE) AS warnings, 0.0::DOUBLE AS time FROM ({HOURS})", "log_events")
def _(spark, sf):
    """A series that holds no numbers is drawn as 0."""
    return g.line(hours(spark, sf), "time", ["errors", "warnings", "time"])


@query("chart_line_long", f"""
SELECT label, 'errors' AS series, CAST(errors AS DOUBLE) AS value FROM ({HOURS}) UNION ALL SELECT label, 'warnings', CAST(warnings AS DOUBLE) FROM ({HOURS})""", "log_events")
def _(spark, sf):
    return g.line_long(hours(spark, sf), "time", ["errors", "warnings"])


@query("chart_bar", "SELECT source AS label, CAST(count(*) AS DOUBLE) AS value FROM log_events GROUP BY source", "log_events")
def _(spark, sf):
    counts = log_events(spark, sf).groupBy("source").agg(a.count_rows().alias("n"), F.max("id").alias("other"))
    return g.bar(counts, "source", ["n", "other"])


@query("chart_pie", """
SELECT coalesce(label, 'Unknown') AS label, value FROM (SELECT CASE WHEN level = 'Debug' THEN NULL ELSE level END AS label,
  CAST(count(*) FILTER (WHERE level != 'Fatal') AS DOUBLE) AS value FROM log_events GROUP BY 1) WHERE value > 0""", "log_events")
def _(spark, sf):
    ev = log_events(spark, sf).withColumn("level", F.when(F.col("level") != "Debug", F.col("level")))
    counts = ev.groupBy("level").agg(F.count_if(~F.col("level").eqNullSafe("Fatal")).alias("n"))
    return g.pie(counts, "level", "n")


@query("chart_scatter", "SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem")
def _(spark, sf):
    return g.scatter(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("chart_table", "SELECT source, n, CAST(NULL AS VARCHAR) AS absent FROM (SELECT source, count(*) AS n FROM log_events GROUP BY source)", "log_events")
def _(spark, sf):
    counts = log_events(spark, sf).groupBy("source").agg(a.count_rows().alias("n"), F.max("level").alias("hidden"))
    return g.table(counts, ["source", "n", "absent"], "n")


@query("dashboard_widgets", """
SELECT name AS dashboard, 'a' AS widget_id, 'stat' AS type, 'endpoint' AS source_type FROM dashboards WHERE config LIKE '%auto%'
UNION ALL SELECT name, 'b', json_extract_string(config, '$.widgets[1].type'), 'inline' FROM dashboards WHERE config LIKE '%auto%'""", "dashboards")
def _(spark, sf):
    return g.widgets(dashboards(spark, sf)).select("dashboard", "widget_id", "type", "source_type")


@query("validated_dashboards", """
SELECT name, array_to_string(list_filter([
  CASE WHEN contains(name, ' ') THEN 'name may hold only letters, digits, - and _' END,
  CASE WHEN config = '' THEN 'config is empty' END,
  CASE WHEN config LIKE '%free%' THEN 'layout is neither auto nor grid' END,
  CASE WHEN config LIKE '%free%' THEN 'no widgets' END,
  CASE WHEN config LIKE '%"endpointName":""%' THEN 'Widget 0: endpoint source names no endpoint' END,
  CASE WHEN config LIKE '%pie_chart%' THEN 'Widget 1: unknown type "pie_chart"' END,
  CASE WHEN config LIKE '%drop table%' THEN 'Widget 1: inline SQL has to begin with SELECT' END], lambda x: x IS NOT NULL), '; ') AS errors
FROM dashboards""", "dashboards")
def _(spark, sf):
    return g.validate_dashboards(dashboards(spark, sf)).select("name", F.array_join("errors", "; ").alias("errors"))

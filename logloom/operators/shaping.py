"""Query results to chart-ready rows, and checks of dashboard definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import format_stat
from logloom.operators.search import table_sort
from logloom.schema import DASHBOARD_CONFIG

# --- fixed values -------------------------------------------------------------------------------
STORABLE_TYPES = ["stat", "line_chart", "bar_chart", "table"]
LAYOUTS = ["auto", "grid"]
NAME_PATTERN = "^[a-zA-Z0-9_-]+$"
# ------------------------------------------------------------------------------------------------


def number(column: str) -> Column:
    """Numeric value, 0 for anything that is none."""
    value = F.coalesce(F.col(f"`{column}`").try_cast("double"), F.lit(0.0).cast("double"))
    return F.when(F.isnan(value), F.lit(0.0).cast("double")).otherwise(value)


def label(column: str, default: str = "") -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(default))


def stat(df: DataFrame, value: str = "value", style: str = "number") -> DataFrame:
    """First row's value and its display text."""
    v = F.col(f"`{value}`").try_cast("double")
    return df.limit(1).select(v.alias("value"), format_stat(v, style).alias("display"))


def line(df: DataFrame, x: str, ys: list[str]) -> DataFrame:
    """One row per x and one numeric column per series."""
    return df.select(label(x).alias("label"), *[number(y).alias(y) for y in ys])


def line_long(df: DataFrame, x: str, ys: list[str]) -> DataFrame:
    """The same with one row per x and series."""
    return line(df, x, ys).unpivot("label", ys, "series", "value")


def bar(df: DataFrame, x: str, ys: str | list[str]) -> DataFrame:
    """Only the first series is drawn."""
    first = ys if isinstance(ys, str) else ys[0]
    return df.select(label(x).alias("label"), number(first).alias("value"))


def pie(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(label(x, "Unknown").alias("label"), number(y).alias("value")).filter(F.col("value") > 0)


doughnut = pie


def scatter(df: DataFrame, x: str, y: str | list[str]) -> DataFrame:
    if not isinstance(y, str):
        raise ValueError("a scatter chart takes a single y field")
    return df.select(number(x).alias("x"), number(y).alias("y"))


def table(df: DataFrame, columns: list[str] | None = None, sort_by: str | None = None, descending: bool = True) -> DataFrame:
    """Sorted rows; chosen columns that the result lacks are NULL."""
    ordered = table_sort(df, sort_by, descending)
    if not columns:
        return ordered
    return ordered.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def shape(df: DataFrame, kind: str, options: dict) -> DataFrame:
    """Shape a result for a widget type by its visualization options."""
    x, y = options.get("xField"), options.get("yField")
    if kind == "stat":
        return stat(df, options.get("valueField") or "value", options.get("format") or "number")
    if kind == "line_chart":
        return line(df, x or "x", [y] if isinstance(y, str) else list(y))
    if kind == "bar_chart":
        return bar(df, x or "x", y)
    if kind in ("pie_chart", "doughnut_chart"):
        return pie(df, x or "name", y)
    if kind == "scatter_chart":
        return scatter(df, x or "x", y)
    if kind == "table":
        return table(df, options.get("columns"), options.get("sortBy"))
    raise ValueError(f"Unknown widget type: {kind}")


def widgets(dashboards: DataFrame) -> DataFrame:
    """One row per widget of every dashboard."""
    config = F.from_json("config", DASHBOARD_CONFIG)
    return (dashboards.select("name", F.posexplode(config["widgets"]).alias("place", "w"))
            .select(F.col("name").alias("dashboard"), "place", F.col("w.id").alias("widget_id"), F.col("w.type").alias("type"),
                    F.col("w.title").alias("title"), F.coalesce("w.dataSource.type", F.lit("")).alias("source_type"),
                    F.coalesce("w.dataSource.endpointName", F.lit("")).alias("endpoint_name"),
                    F.coalesce("w.dataSource.sql", F.lit("")).alias("sql")))


def validate_dashboards(dashboards: DataFrame) -> DataFrame:
    """Every dashboard with the list of its faults."""
    def blank(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) == ""

    def faults(w: Column, i: Column) -> Column:
        head = F.concat(F.lit("Widget "), i.cast("string"), F.lit(": "))
        kind = w["dataSource"]["type"]
        sql = w["dataSource"]["sql"]
        found = F.array(
            F.when(blank(w["id"]) | blank(w["type"]) | blank(w["title"]), "id, type or title is empty"),
            F.when(~F.coalesce(w["type"], F.lit("")).isin(*STORABLE_TYPES),
                   F.concat(F.lit('unknown type "'), F.coalesce(w["type"], F.lit("none")), F.lit('"'))),
            F.when(blank(kind), "no data source")
             .when((kind == "endpoint") & blank(w["dataSource"]["endpointName"]), "endpoint source names no endpoint")
             .when((kind == "inline") & blank(sql), "inline source holds no SQL")
             .when((kind == "inline") & ~F.lower(F.trim(sql)).startswith("select"), "inline SQL has to begin with SELECT"))
        return F.transform(F.array_compact(found), lambda t: F.concat(head, t))

    config = F.from_json("config", DASHBOARD_CONFIG)
    parsed = dashboards.withColumn("_c", config)
    items = F.col("_c.widgets")
    top = F.array_compact(F.array(
        F.when(blank(F.col("name")), "name is empty")
         .when(~F.col("name").rlike(NAME_PATTERN), "name may hold only letters, digits, - and _"),
        F.when(blank(F.col("config")), "config is empty"),
        F.when(~blank(F.col("config")) & ~F.coalesce(F.col("_c.layout"), F.lit("")).isin(*LAYOUTS),
               "layout is neither auto nor grid"),
        F.when(~blank(F.col("config")) & (F.coalesce(F.size(items), F.lit(0)) <= 0), "no widgets")))
    inner = F.coalesce(F.flatten(F.transform(items, faults)), F.array().cast("array<string>"))
    return parsed.select(*dashboards.columns, F.concat(top, inner).alias("errors"))

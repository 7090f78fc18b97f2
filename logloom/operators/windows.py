"""Latest-per-key, scaling against the maximum, axis labels, newest-N.

Whole-table maxima are scalar subqueries over an aggregate, not windows without a partition: no task ever
sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: label patterns of the time axis --------------------------------------------------
TIME_LABEL, DATE_LABEL = "hh:mm a", "MMM d"
LABEL_PATTERN = {"time": TIME_LABEL, "date": DATE_LABEL, "datetime": f"{DATE_LABEL} {TIME_LABEL}"}
DATE_SPAN_HOURS = 48
SNAPSHOT_STAMP_CHARS = 17
# ------------------------------------------------------------------------------------------------


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` per key, combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def scale_to_max(df: DataFrame, column: str, name: str = "width_percent") -> DataFrame:
    """Share of the greatest value in percent, 0 when that is 0."""
    top = df.agg(F.max(column).cast("double")).scalar()
    return df.select("*", F.when(top > 0, F.col(column) * F.lit(100.0).cast("double") / top)
                     .otherwise(F.lit(0.0).cast("double")).alias(name))


def sparkline(df: DataFrame, column: str, name: str = "height_percent") -> DataFrame:
    """Heights between the least value (at most 0) and the greatest (at least 1)."""
    top = df.agg(F.greatest(F.max(column), F.lit(1)).cast("double")).scalar()
    low = df.agg(F.least(F.min(column), F.lit(0)).cast("double")).scalar()
    return df.select("*", ((F.col(column) - low) / (top - low) * F.lit(100.0).cast("double")).alias(name))


def axis_labels(df: DataFrame, x: str, style: str = "auto", name: str = "label") -> DataFrame:
    """Readable labels for a time axis; texts stay as they are when one of them is no time."""
    text = F.coalesce(F.col(x).cast("string"), F.lit(""))
    if style == "string":
        return df.select("*", text.alias(name))
    moment = F.try_to_timestamp(text)
    facts = df.agg(F.count_if(moment.isNull()).alias("bad"),
                   F.timestamp_diff("SECOND", F.min(moment), F.max(moment)).alias("span"))
    if style in LABEL_PATTERN:
        label = F.date_format(moment, LABEL_PATTERN[style])
    else:
        long_span = facts.select("span").scalar() >= DATE_SPAN_HOURS * 3600
        label = F.when(long_span, F.date_format(moment, DATE_LABEL)).otherwise(F.date_format(moment, TIME_LABEL))
    return df.select("*", F.when(facts.select("bad").scalar() > 0, text).otherwise(label).alias(name))


def snapshot_stamp(name: Column) -> Column:
    return F.right(name, F.lit(SNAPSHOT_STAMP_CHARS))


def newest(snapshots: DataFrame, n: int) -> DataFrame:
    """The ``n`` snapshots with the greatest time stamp in their name."""
    return snapshots.orderBy(snapshot_stamp(F.col("name")).desc(), "name").limit(n)

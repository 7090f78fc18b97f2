"""Display and name helpers: sizes, counts, durations, ages, slugs, escaping, event text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.base import apply_sql, let, let_sql, show_ts
from logloom.functions.json_text import display, object_members

# --- fixed values -------------------------------------------------------------------------------
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]
BINARY_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]
NAME_SEPARATORS = [" - ", " errors", " alert", " warning"]
HTML_ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
# ------------------------------------------------------------------------------------------------


def trim_zeros(text: Column) -> Column:
    """Drop the zeros (and then the point) at the end of a plain decimal."""
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def fixed(x: Column, digits: int) -> Column:
    """Fixed number of decimals, no grouping; rounds by the exact binary value (1.15 is below the tie, so 1.1).

    ``twice * x`` is compared with an odd integer after splitting ``x`` into two halves whose products are exact.
    """
    scale, twice = float(10 ** digits), float(2 * 10 ** digits)
    high = "(134217729D * abs(v) - (134217729D * abs(v) - abs(v)))"
    above = f"({high} * {twice}D - (2 * n + 1)) + (abs(v) - {high}) * {twice}D >= 0"
    body = let_sql(f"double(floor(abs(v) * {scale}D))", "n",
                   f"format_string('%.{digits}f', if(v < 0, -1, 1) * (n + if({above}, 1, 0)) / {scale}D)")
    return apply_sql(x.cast("double"), "v", body)


def format_bytes(size: Column) -> Column:
    def body(v: Column) -> Column:
        out = F.when(v == 0, F.lit("0 B"))
        for i, unit in enumerate(SIZE_UNITS):
            text = F.concat(trim_zeros(fixed(v / F.lit(float(1024 ** i)), 2)), F.lit(" " + unit))
            out = out.otherwise(text) if i == len(SIZE_UNITS) - 1 else out.when(v < float(1024 ** (i + 1)), text)
        return out
    return let(size.cast("double"), body)


def readable_size(size: Column) -> Column:
    """Two decimals and a binary unit: ``1.18 MiB``."""
    def body(v: Column) -> Column:
        out = F.when(v < 1024.0, F.concat(fixed(v, 2), F.lit(" B")))
        for i, unit in enumerate(BINARY_UNITS[1:], start=1):
            text = F.concat(fixed(v / F.lit(float(1024 ** i)), 2), F.lit(" " + unit))
            out = out.otherwise(text) if unit == BINARY_UNITS[-1] else out.when(v < float(1024 ** (i + 1)), text)
        return out
    return let(size.cast("double"), body)


def format_count(n: Column) -> Column:
    """1234 as ``1.2K``, 2500000 as ``2.5M``, smaller numbers grouped."""
    def body(v: Column) -> Column:
        return (F.when(v >= 1e6, F.concat(fixed(v / 1e6, 1), F.lit("M")))
                .when(v >= 1e3, F.concat(fixed(v / 1e3, 1), F.lit("K")))
                .otherwise(trim_zeros(F.format_number(v, 3))))
    return let(n.cast("double"), body)


def format_stat(x: Column, style: str = "number") -> Column:
    def body(v: Column) -> Column:
        if style == "percent":
            return F.concat(fixed(v, 1), F.lit("%"))
        if style == "duration":
            return (F.when(v < 1000, F.concat(fixed(v, 0), F.lit("ms")))
                    .when(v < 60000, F.concat(fixed(v / 1000.0, 1), F.lit("s")))
                    .otherwise(F.concat(fixed(v / 60000.0, 1), F.lit("m"))))
        return trim_zeros(F.format_number(v, 2))
    return let(x.cast("double"), body)


def relative_age(minutes: Column) -> Column:
    hours = F.floor(minutes / 60)
    return (F.when(minutes.isNull(), "Never triggered")
            .when(minutes < 1, "Just now")
            .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
            .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
            .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago"))))


def service_slug(alert_name: Column) -> Column:
    """The part of the lower-cased name before the first separator (in list order), ``[a-z0-9-]`` only."""
    def body(name: Column) -> Column:
        head = None
        for separator in NAME_SEPARATORS:
            hit = F.instr(name, separator) > 1
            cut = F.substring_index(name, separator, 1)
            head = F.when(hit, cut) if head is None else head.when(hit, cut)
        return F.regexp_replace(F.trim(head.otherwise(name)), "[^a-z0-9-]", "")
    return let(F.lower(alert_name), body)


def escape_html(text: Column) -> Column:
    for char, entity in HTML_ENTITIES:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def is_url(text: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(text, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))


def parameter_names(sql: Column) -> Column:
    """Distinct ``@name`` placeholders in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(sql, F.lit(r"@([a-zA-Z_][a-zA-Z0-9_]*)"), F.lit(1)))


def snapshot_kind(name: Column, legacy: str = "legacy") -> Column:
    return (F.when(name.startswith("logs-full-"), "full")
            .when(name.startswith("logs-incr-"), "incremental")
            .otherwise(legacy))


def event_as_text(timestamp: Column, level: Column, message: Column, properties: Column, exception: Column) -> Column:
    """Header, blank line, ``key: value`` lines in key order, then the exception block."""
    header = F.concat(F.lit("["), show_ts(timestamp), F.lit("] "), F.upper(level), F.lit(" - "), message)
    lines = F.transform(F.map_entries(object_members(properties)),
                        lambda e: F.concat(e["key"], F.lit(": "), display(e["value"])))
    tail = F.when(exception != "", F.array(F.lit(""), F.lit("Exception:"), exception)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(header, F.lit("")), F.coalesce(lines, F.array().cast("array<string>")), tail), "\n")

"""Raw messages to event rows and dead letters in one pass, without a shuffle.

Every message becomes an array of records in its own row, which also tells whether all of its lines failed;
one generator then turns the array into rows, and the fields are plain projections of these. The four formats
share that pass: the expressions of the other formats are not evaluated for a row.
"""

from __future__ import annotations

from datetime import datetime
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.base import nonempty, ts_lit
from logloom.functions.hashing import type_code, type_subject, with_murmur3
from logloom.functions.json_text import is_whole, members_of, missing_entries, strict_json, without_entries
from logloom.operators import clef, otlp, webhook
from logloom.schema import EVENT_COLUMNS, FORMATS, LOG_RECORD, SPAN
from logloom.sources.messages import event_id, unwrap

CLEF, WEBHOOK, OTLP_LOGS, OTLP_TRACES = FORMATS


def clamp_future(ts: Column, now: Column) -> Column:
    """Times after ``now``, and missing ones, become ``now``."""
    return F.least(F.coalesce(ts, now), now)


def _moment(as_of: datetime | str | None) -> Column:
    return F.current_timestamp() if as_of is None else ts_lit(as_of)


_PARTS = {
    "line": T.StringType(),
    "log": T.StructType([T.StructField("service", T.StringType()), T.StructField("item", LOG_RECORD)]),
    "span": T.StructType([T.StructField("service", T.StringType()), T.StructField("item", SPAN)]),
    "reason": T.StringType(),
    "raw": T.StringType(),
}
_CARRIED = ["message_id", "format", "source", "preset", "enrich"]


def _record(**values: Column) -> Column:
    """One record: the given parts filled, the others NULL."""
    return F.struct(*[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _PARTS.items()])


def _records(payloads: DataFrame) -> DataFrame:
    """Payload rows with the array of their records; a rejected payload has one record with the reason.

    The reason travels inside the record, so that a later filter on it cannot be pushed below the generator,
    where it would parse every payload a second time.
    """
    form, body, ok = F.col("format"), F.col("body"), F.col("reason").isNull()
    line_based = form.isin(CLEF, WEBHOOK)
    request = form.isin(OTLP_LOGS, OTLP_TRACES)
    staged = payloads.withColumns({"lines": F.when(ok & line_based, clef.split_lines(body)),
                                   "parsed": F.when(ok & request, strict_json(body))})
    no_json = request & ~is_whole(F.col("parsed"))
    reason = (F.when(~ok, F.col("reason"))
              .when(~form.isin(*FORMATS), F.concat(F.lit("unknown format: "), form))
              .when((form == CLEF) & (F.size("lines") > 0) & ~clef.any_valid(F.col("lines")), "all lines failed")
              .when(no_json, "bad request json"))
    records = (F.when(F.col("why").isNotNull(), F.array(_record(reason=F.col("why"), raw=F.col("raw"))))
               .when(line_based, F.transform("lines", lambda line: _record(line=line)))
               .when(form == OTLP_LOGS, F.transform(otlp.flatten_logs(F.col("parsed")), lambda r: _record(log=r)))
               .otherwise(F.transform(otlp.flatten_spans(F.col("parsed")), lambda r: _record(span=r))))
    return staged.withColumn("why", reason).select(*_CARRIED, records.alias("records"))


def _rows(payloads: DataFrame) -> DataFrame:
    """One row per record, with the parsed members of line-based formats."""
    # the outer form: the plain one makes the optimizer add a size filter that repeats the parsing
    rows = _records(payloads).select(*_CARRIED, F.posexplode_outer("records").alias("place", "record"))
    # one select: later columns refer to the aliases of earlier ones
    is_clef = F.col("format") == CLEF
    members = F.when(is_clef, F.col("m"))
    needed = F.when(F.coalesce(F.size("enrich"), F.lit(0)) > 0, missing_entries(F.col("props"), F.col("enrich")))
    valid = (F.when(F.col("reason").isNotNull(), True).when(is_clef, F.col("ts").isNotNull())
             .otherwise(F.col("m").isNotNull() | F.col("log").isNotNull() | F.col("span").isNotNull()))
    steps = {
        **{name: F.col(f"record.{name}") for name in _PARTS},
        "line_no": F.when(F.col("record.reason").isNull(), F.col("place") + 1).otherwise(0),
        "json": F.when(F.col("line").isNotNull(), strict_json(F.col("line"))),
        "m": members_of(F.col("json")),
        "ts": clef.clef_timestamp(members),
        "props": clef.clef_properties(members),
        **clef.clef_texts(members),
        "needed": needed,
        "own": F.when(is_clef, without_entries(F.col("props"), F.col("needed"))),
        "added": F.to_json("needed"),
        "valid": valid,
    }
    return rows.select(*_CARRIED, *[column.alias(name) for name, column in steps.items()])


@lru_cache(maxsize=8)
def _fields(_context: int, presets: tuple[tuple[str, webhook.Preset], ...]) -> dict[str, Column]:
    """Every event field as a choice by format. The expressions name columns only, so one set serves all plans
    of a Spark context."""
    source = F.col("source")
    by_format = {
        CLEF: clef.clef_fields(F.col("props"), F.col("own"), F.col("added"), F.col("ts"), source),
        WEBHOOK: webhook.webhook_fields(F.col("m"), source, F.col("preset"), dict(presets)),
        OTLP_LOGS: otlp.log_fields(F.col("log"), source),
        OTLP_TRACES: otlp.span_fields(F.col("span"), source),
    }
    good = F.col("reason").isNull() & F.col("valid")
    fields = {}
    for name in by_format[CLEF]:
        choice = F.when(good & (F.col("format") == CLEF), by_format[CLEF][name])
        for form in FORMATS[1:]:
            choice = choice.when(good & (F.col("format") == form), by_format[form][name])
        fields[name] = choice
    fields["source"] = F.when(good, fields["source"]).otherwise(source)
    return fields


def parse_payloads(payloads: DataFrame, as_of: datetime | str | None = None,
                   presets: dict[str, webhook.Preset] | None = None) -> DataFrame:
    """Decoded payloads to one row per event plus one row per rejected payload (``reason`` set)."""
    rows, good = _rows(payloads), F.col("reason").isNull() & F.col("valid")
    fields = dict(_fields(id(SparkContext._active_spark_context), tuple((presets or webhook.PRESETS).items())))
    fields["timestamp"] = F.when(good, clamp_future(fields["timestamp"], _moment(as_of)))
    chosen = rows.select(
        event_id(F.col("message_id"), F.col("line_no")).alias("id"),
        *[column.alias(name) for name, column in fields.items()], "message_id", "format", "reason", "raw", "valid")
    hashed = with_murmur3(chosen.withColumn("subject", type_subject(F.col("message_template"), F.col("message"))),
                          F.col("subject"), "code")
    # behind this one-element generator no filter of the caller, nor the one below, is pushed into the steps above
    sealed = hashed.select("*", F.inline(F.array(F.struct(F.col("code").alias("final"), F.col("valid").alias("keep")))))
    kind = F.coalesce(nonempty(F.col("given_type")), type_code(F.col("subject"), F.col("final")))
    return (sealed.filter("keep").withColumn("event_type", F.when(F.col("reason").isNull(), kind))
            .select(*EVENT_COLUMNS, "message_id", "format", "reason", "raw"))


def parse_messages(messages: DataFrame, as_of: datetime | str | None = None,
                   presets: dict[str, webhook.Preset] | None = None) -> DataFrame:
    return parse_payloads(unwrap(messages), as_of, presets)


def events_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).select(*EVENT_COLUMNS)


def dead_letters_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select("message_id", "format", "source", "reason", "raw")

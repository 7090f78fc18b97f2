"""Alert rules: loading, evaluation, conditions, status and notification rows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.base import let, nonempty, show_ts, ts_lit, type_of
from logloom.functions.json_text import parse_float
from logloom.functions.text import service_slug
from logloom.limits import fetch
from logloom.operators.filters import LogQuery, last_interval, matches
from logloom.operators.joins import targets
from logloom.operators.search import order_by_status

# --- fixed values -------------------------------------------------------------------------------
MIN_INTERVAL, DEFAULT_INTERVAL, DEFAULT_COOLDOWN = 30, 60, 300
NEVER = "1970-01-02 00:00:00"
COMPARISONS = [">=", "<=", "!=", "==", ">", "<"]
DEFAULT_METHOD, DEFAULT_TIMEOUT = "POST", 10
# ------------------------------------------------------------------------------------------------


def string_list(column: Column) -> Column:
    """JSON array of texts; unreadable text is an empty list."""
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))


def load_rules(alerts: DataFrame) -> DataFrame:
    """Enabled rules with parsed lists and the least interval enforced."""
    return (alerts.filter(F.col("enabled") == 1)
            .withColumns({"recipients": string_list(F.col("recipients")),
                          "destination_ids": string_list(F.col("destination_ids")),
                          "interval_seconds": F.greatest(F.col("interval_seconds"), F.lit(MIN_INTERVAL).cast("bigint"))}))


def due(rules: DataFrame, state: DataFrame, as_of: datetime) -> DataFrame:
    """Rules whose last run (``state``: id, last_run) is at least one interval ago."""
    joined = rules.join(state.select("id", "last_run"), "id", "left")
    age = F.timestamp_diff("SECOND", F.col("last_run"), ts_lit(as_of, type_of(state, "last_run")))
    return joined.filter(F.col("last_run").isNull() | (age >= F.col("interval_seconds"))).select(*rules.columns)


# --- conditions ------------------------------------------------------------------------------------

def _step(text: Column, last: Column) -> Column:
    """One comparison ``name op number``, ready to run; ``last`` closes its group."""
    op = None
    for symbol in COMPARISONS:
        hit = F.contains(text, F.lit(symbol))
        op = F.when(hit, symbol) if op is None else op.when(hit, symbol)

    def parts(o: Column) -> Column:
        at = F.instr(text, o)
        name = F.coalesce(F.trim(F.substring(text, F.lit(1), at - 1)), F.lit(""))
        number = F.coalesce(F.trim(F.substring(text, at + F.length(o), F.length(text))), F.lit(""))
        value = parse_float(number)
        return F.struct(
            name.alias("name"), o.alias("op"), value.alias("number"), last.alias("last"),
            F.when(o.isNull(), F.concat(F.lit("no comparison in condition: "), F.trim(text))).alias("unreadable"),
            F.when(value.isNull(), F.concat(F.lit("not a number to compare with: "), number)).alias("no_number"))
    return let(op, parts)


def condition_program(condition: Column, strict: bool = False) -> Column:
    """The comparisons of a condition in order, as an array of steps: all work on its text is done here."""
    outer, inner = ("\\|\\|", "&&") if strict else ("&&", "\\|\\|")

    def group(part: Column) -> Column:
        return let(F.split(part, inner), lambda items: F.transform(items, lambda c, i: _step(c, i == F.size(items) - 1)))
    return F.flatten(F.transform(F.split(condition, outer), group))


def run_program(program: Column, values: Column, strict: bool = False) -> Column:
    """Struct ``(ok, error)``: one fold over the steps. A group's truth is kept in ``inner``, the whole in ``total``."""
    def step(state: Column, s: Column) -> Column:
        left, right = F.try_element_at(values, s["name"]), s["number"]
        error = (F.when(s["unreadable"].isNotNull(), s["unreadable"])
                 .when(~F.map_contains_key(values, s["name"]), F.concat(F.lit("no column "), s["name"], F.lit(" in the result")))
                 .when(left.isNull(), F.concat(F.lit("column "), s["name"], F.lit(" holds no number")))
                 .otherwise(s["no_number"]))
        op = s["op"]
        truth = (F.when(op == ">=", left >= right).when(op == "<=", left <= right).when(op == "!=", left != right)
                 .when(op == "==", left == right).when(op == ">", left > right).otherwise(left < right))
        inner = state["inner"] & truth if strict else state["inner"] | truth
        total = state["total"] | inner if strict else state["total"] & inner
        return F.struct(F.coalesce(state["error"], error).alias("error"),
                        F.when(s["last"], F.lit(strict)).otherwise(inner).alias("inner"),
                        F.when(s["last"], total).otherwise(state["total"]).alias("total"))
    start = F.struct(F.lit(None).cast("string").alias("error"), F.lit(strict).alias("inner"), F.lit(not strict).alias("total"))
    return F.aggregate(program, start, step, lambda end: F.struct(
        F.when(end["error"].isNull(), end["total"]).alias("ok"), end["error"].alias("error")))


def evaluate_condition(condition: Column, values: Column, strict: bool = False) -> Column:
    """Struct ``(ok, error)`` of a condition over a map of numbers.

    ``&&`` splits first, so ``a || b && c`` reads ``(a || b) && c``; ``strict`` gives ``&&`` its usual
    higher rank. All comparisons are evaluated; the first error wins. A column of few different conditions
    over many rows is better served by ``judge``.
    """
    return run_program(condition_program(condition, strict), values, strict)


def judge(rows: DataFrame, condition: str, values: str, strict: bool = False, name: str = "outcome") -> DataFrame:
    """``rows`` with the outcome of each row's condition; every distinct condition is parsed once.

    The programs come back by a join on the text. They are as many as there are different conditions, and are broadcast
    only if their measured size allows it; otherwise the rows of a frequent condition are a skewed side that adaptive
    execution splits. A null condition has a null outcome.
    """
    programs = (rows.select(F.col(condition).alias("_condition")).distinct()
                .select("_condition", condition_program(F.col("_condition"), strict).alias("_program")))
    joined = rows.join(programs, rows[condition] == programs["_condition"], "left")
    return joined.select(*[rows[c] for c in rows.columns], run_program(programs["_program"], rows[values], strict).alias(name))


# --- evaluation ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class RuleSpec:
    """A rule of the usual shape: how many matching rows in the last minutes."""

    id: str
    query: LogQuery
    minutes: int
    levels: tuple[str, ...] = ()

    def predicate(self, as_of: datetime, kind: T.DataType) -> Column:
        hit = matches(self.query) & (F.col("timestamp") > ts_lit(as_of - timedelta(minutes=self.minutes), kind))
        return hit & F.col("level").isin(*self.levels) if self.levels else hit


def rule_counts(events: DataFrame, specs: list[RuleSpec], as_of: datetime) -> DataFrame:
    """All rules in one pass over the widest window: (id, cnt). Quiet rules get their 0."""
    kind = type_of(events, "timestamp")
    recent = last_interval(events, timedelta(minutes=max(s.minutes for s in specs)), as_of)
    counted = recent.agg(*[F.count_if(s.predicate(as_of, kind)).alias(f"r{i}") for i, s in enumerate(specs)])
    pairs = F.array(*[F.struct(F.lit(s.id).alias("id"), F.col(f"r{i}").alias("cnt")) for i, s in enumerate(specs)])
    return counted.select(F.inline(pairs))


def first_row_values(result: DataFrame) -> DataFrame:
    """First row as a map from column name to number; non-numeric columns map to NULL."""
    entries = []
    for f in result.schema.fields:
        number = F.col(f"`{f.name}`").cast("double") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")
        entries += [F.lit(f.name), number]
    return result.limit(1).select(F.create_map(*entries).alias("values"))


RULE_SECONDS = 30
OUTCOME = "id string, condition string, values map<string,double>, sql_error string"


def evaluate_rules(spark: SparkSession, rules: DataFrame, seconds: float = RULE_SECONDS) -> DataFrame:
    """Run every rule's SQL and judge its condition: (id, values, triggered, error).

    The rule table is configuration (a handful of rows) and is read on the driver. Every rule is a distributed query of its
    own, of which one row comes back: text the analyser refuses, an error at run time or a query over its time limit makes
    an error row and leaves the other rules alone. Rules of the usual shape share one scan, see ``rule_counts``.
    """
    outcomes = []
    for row in rules.select("id", "query", "condition").collect():
        values, error = None, None
        try:
            first = fetch(first_row_values(spark.sql(row["query"])), seconds)
            values = first[0]["values"] if first else None
            error = None if first else "query returned no rows"
        except Exception as problem:  # whatever user SQL does is this rule's own error
            error = next((line for line in str(problem).splitlines() if line.strip()), type(problem).__name__)
        outcomes.append((row["id"], row["condition"], values, error))
    judged = judge(spark.createDataFrame(outcomes, OUTCOME), "condition", "values", name="_o").withColumn(
        "o", F.when(F.col("sql_error").isNull(), F.col("_o")))
    return judged.select("id", "values", F.coalesce("o.ok", F.lit(False)).alias("triggered"),
                         F.coalesce("sql_error", "o.error").alias("error"))


def test_rule(spark: SparkSession, query: str) -> DataFrame:
    """Rows of a rule's query, with no change of state."""
    if not query.strip().lower().startswith("select"):
        raise ValueError("a query has to begin with SELECT")
    return spark.sql(query)


def out_of_cooldown(rules: DataFrame, as_of: datetime) -> DataFrame:
    """Triggered rules that may fire again."""
    age = F.timestamp_diff("SECOND", F.col("last_triggered_at"), ts_lit(as_of, type_of(rules, "last_triggered_at")))
    return rules.filter(age >= F.col("cooldown_seconds"))


# --- status ------------------------------------------------------------------------------------------

def _minutes_ago(df: DataFrame, as_of: datetime) -> Column:
    """Minute boundaries between the last firing and now."""
    kind = type_of(df, "last_triggered_at")
    now, then = (F.date_trunc("MINUTE", t) for t in (ts_lit(as_of, kind), F.col("last_triggered_at")))
    return F.timestamp_diff("MINUTE", then, now).cast("int")


def _within(df: DataFrame, as_of: datetime, seconds: Column) -> Column:
    kind = type_of(df, "last_triggered_at")
    since = ts_lit(as_of, kind) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return (F.col("last_triggered_at") > ts_lit(NEVER, kind)) & (F.col("last_triggered_at") > since.cast(kind))


def firing_alerts(alerts: DataFrame, as_of: datetime) -> DataFrame:
    return (alerts.filter((F.col("enabled") == 1) & _within(alerts, as_of, F.col("cooldown_seconds")))
            .orderBy(F.desc("last_triggered_at"), "id")
            .select("id", "name", "description", show_ts(F.col("last_triggered_at")).alias("last_triggered_at"),
                    _minutes_ago(alerts, as_of).alias("minutes_ago")))


def alerts_with_status(alerts: DataFrame, as_of: datetime) -> DataFrame:
    kind = type_of(alerts, "last_triggered_at")
    status = (F.when(_within(alerts, as_of, F.col("cooldown_seconds")), "firing")
              .when(_within(alerts, as_of, F.lit(86400)), "recent").otherwise("ok"))
    rows = alerts.filter(F.col("enabled") == 1).select(
        "id", "name", "description", "enabled", F.col("last_triggered_at").alias("triggered_at"), "cooldown_seconds",
        status.alias("status"),
        F.when(F.col("last_triggered_at") > ts_lit(NEVER, kind), _minutes_ago(alerts, as_of)).alias("minutes_ago"))
    return order_by_status(rows).select(
        "id", "name", "description", "enabled", show_ts(F.col("triggered_at")).alias("last_triggered_at"),
        "cooldown_seconds", "status", "minutes_ago")


# --- notifications -----------------------------------------------------------------------------------

def notification_rows(fired: DataFrame, destinations: DataFrame, triggered_at: datetime) -> DataFrame:
    """Outbox rows: one per destination of a fired rule, or per recipient. Nothing is sent.

    ``fired`` carries the rule columns and ``values`` (the first row of its query).
    """
    payload = F.to_json(F.struct(
        F.col("id").alias("alert_id"), F.col("name").alias("alert_name"), service_slug(F.col("name")).alias("service"),
        "description", "query", "condition",
        F.lit(triggered_at.strftime("%Y-%m-%dT%H:%M:%SZ")).alias("triggered_at"), F.col("values").alias("query_result")))
    config = F.from_json("config", "email string, `from` string, url string, method string, timeout_seconds int")
    rows = targets(fired, destinations).withColumn("_c", config)
    mail = F.col("channel") == "email"
    return rows.filter(F.col("channel").isin("email", "webhook")).select(
        F.col("id").alias("alert_id"), "destination_id", "channel",
        F.when(mail, F.col("_c.email")).otherwise(F.col("_c.url")).alias("address"),
        F.when(mail, F.lit("")).otherwise(F.coalesce(nonempty(F.col("_c.method")), F.lit(DEFAULT_METHOD))).alias("method"),
        F.when(mail, F.lit(0)).when(F.col("_c.timeout_seconds") > 0, F.col("_c.timeout_seconds"))
         .otherwise(DEFAULT_TIMEOUT).alias("timeout_seconds"),
        "subject", payload.alias("payload"))


def forward_event(event: DataFrame, destination_id: str) -> DataFrame:
    """Outbox payload of an event passed on by hand."""
    properties = F.coalesce(F.try_parse_json(nonempty(F.col("properties"))), F.parse_json(F.lit("{}")))
    who = F.coalesce(nonempty(F.col("source")), F.lit("Unknown"))
    return event.select(
        F.lit(destination_id).alias("destination_id"),
        F.to_json(F.struct(
            F.lit("manual").alias("alert_id"), F.concat(F.lit("Manual: "), who).alias("alert_name"),
            F.col("message").alias("description"),
            F.concat(F.lit("SELECT * FROM events WHERE id = '"), F.col("id"), F.lit("'")).alias("query"),
            F.lit("manual").alias("condition"), show_ts(F.col("timestamp")).alias("triggered_at"),
            F.struct("id", "level", "message", "source", F.coalesce("exception", F.lit("")).alias("exception"),
                     properties.alias("properties")).alias("query_result"))).alias("payload"))


def validate_rules(rules: DataFrame) -> DataFrame:
    """The rule table with a list of what is wrong with each row (empty when it may be stored)."""
    def missing(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    interval = F.coalesce(F.nullif(F.col("interval_seconds"), F.lit(0)), F.lit(DEFAULT_INTERVAL))
    no_target = (F.size(string_list(F.col("destination_ids"))) <= 0) & (F.size(string_list(F.col("recipients"))) <= 0)
    checks = [
        F.when(missing("name"), "name: must not be empty"),
        F.when(missing("query"), "query: must not be empty")
         .when(~F.lower(F.trim("query")).startswith("select"), "query: has to begin with SELECT"),
        F.when(missing("condition"), "condition: must not be empty"),
        F.when(missing("subject"), "subject: must not be empty"),
        F.when(no_target, "destination_ids: nobody to notify (no destination, no recipient)"),
        F.when(interval < MIN_INTERVAL, "interval_seconds: below the shortest interval of 30 s"),
    ]
    return rules.select("*", F.array_compact(F.array(*checks)).alias("errors"))

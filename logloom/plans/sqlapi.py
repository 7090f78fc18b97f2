"""User SQL: guarded SELECTs, saved parameterised endpoints, dashboard widgets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from logloom import limits
from logloom.operators.search import cap_rows
from logloom.operators.shaping import shape

# --- fixed values -------------------------------------------------------------------------------
TIMEOUT_SECONDS = 30
PARAMETER_NAME = r"[a-zA-Z_][a-zA-Z0-9_]*"
# a member named by further keys (two to eight one by one, or any number as an array), each a member of the one before
_KEYS = ", ".join(f"k{i}" for i in range(2, 9))
_MORE = ", ".join(f"k{i} STRING DEFAULT NULL" for i in range(2, 9))
_OUTER = "try_element_at(from_json(j, 'map<string,variant>'), {first})"
_INNER = "aggregate({rest}, {outer}, (v, key) -> try_element_at(try_cast(v AS MAP<STRING, VARIANT>), key))"
_MEMBER = _INNER.format(rest=f"array_compact(array({_KEYS}))", outer=_OUTER.format(first="k"))
_AT_PATH = _INNER.format(rest="slice(p, 2, greatest(size(p) - 1, 0))", outer=_OUTER.format(first="get(p, 0)"))
_TEXT = "if(schema_of_variant({m}) = 'STRING', {m}::string, '')"
_NUMBER = "if(left(schema_of_variant({m}), 3) IN ('BIG', 'DEC', 'DOU', 'FLO'), try_cast({m} AS DOUBLE), 0D)"
# Scalar helpers under the names that stored queries use; aggregates such as count_if are Spark's own.
HELPERS = {
    "toStartOfMinute(t TIMESTAMP) RETURNS TIMESTAMP": "date_trunc('MINUTE', t)",
    "toStartOfHour(t TIMESTAMP) RETURNS TIMESTAMP": "date_trunc('HOUR', t)",
    "toStartOfDay(t TIMESTAMP) RETURNS TIMESTAMP": "date_trunc('DAY', t)",
    "toYYYYMMDD(t TIMESTAMP) RETURNS INT": "cast(date_format(t, 'yyyyMMdd') AS INT)",
    "toString(x STRING) RETURNS STRING": "x",
    "toDateTime(x STRING) RETURNS TIMESTAMP": "try_to_timestamp(x)",
    "toDateTime64(x STRING, p INT) RETURNS TIMESTAMP": "timestamp_micros(unix_micros(try_to_timestamp(x)) DIV bigint(pow(10, 6 - p)) * bigint(pow(10, 6 - p)))",
    "toIntervalSecond(n INT) RETURNS INTERVAL DAY TO SECOND": "make_dt_interval(0, 0, 0, n)",
    "formatDateTime(t TIMESTAMP, f STRING) RETURNS STRING":
        "date_format(t, replace(replace(replace(replace(replace(replace(f, '%Y', 'yyyy'), '%m', 'MM'), '%d', 'dd'),"
        " '%H', 'HH'), '%i', 'mm'), '%S', 'ss'))",
    # like the property functions: only text is a string, only numbers are numbers
    f"JSONExtractString(j STRING, k STRING, {_MORE}) RETURNS STRING": _TEXT.format(m=_MEMBER),
    f"JSONExtractFloat(j STRING, k STRING, {_MORE}) RETURNS DOUBLE": _NUMBER.format(m=_MEMBER),
    f"JSONHas(j STRING, k STRING, {_MORE}) RETURNS BOOLEAN": f"{_MEMBER} IS NOT NULL",
    "JSONPathString(j STRING, p ARRAY<STRING>) RETURNS STRING": _TEXT.format(m=_AT_PATH),
    "JSONPathFloat(j STRING, p ARRAY<STRING>) RETURNS DOUBLE": _NUMBER.format(m=_AT_PATH),
    "JSONPathHas(j STRING, p ARRAY<STRING>) RETURNS BOOLEAN": f"{_AT_PATH} IS NOT NULL",
}
# ------------------------------------------------------------------------------------------------


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Temporary views for user SQL, and the scalar helpers."""
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
    for signature, body in HELPERS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def require_select(sql: str) -> None:
    if not sql.strip().lower().startswith("select"):
        raise ValueError("a query has to begin with SELECT")


def run_select(spark: SparkSession, sql: str, args: dict[str, str] | None = None, cap: int | None = None) -> DataFrame:
    """The query; with ``cap`` its result is cut there (a LIMIT inside the text never lifts it), see ``fetch_page``."""
    require_select(sql)
    frame = spark.sql(sql, args=args) if args else spark.sql(sql)
    return frame if cap is None else cap_rows(frame, cap)


def fetch(df: DataFrame, seconds: float = TIMEOUT_SECONDS) -> list[Row]:
    """All rows of a query within the time limit. Bound the result first (``run_select`` with ``cap``, ``fetch_page``)."""
    return limits.fetch(df, seconds)


def fetch_page(df: DataFrame, rows: int, seconds: float = TIMEOUT_SECONDS) -> tuple[list[Row], bool]:
    """At most ``rows`` rows, and whether there are more."""
    got = limits.fetch(cap_rows(df, rows + 1), seconds)
    return got[:rows], len(got) > rows


def bind(sql: str, params: dict[str, str]) -> tuple[str, dict[str, str]]:
    """``@name`` placeholders to named SQL parameters; all values are text, unknown names stay."""
    used = {}
    for name, value in params.items():
        if re.fullmatch(PARAMETER_NAME, name):
            sql, hits = re.subn(rf"@{name}\b", f":{name}", sql)
            if hits:
                used[name] = str(value)
    return sql, used


def run_endpoint(spark: SparkSession, endpoint: Row | dict | None, params: dict[str, str] | None = None) -> DataFrame:
    """A saved query with its parameters; missing and disabled endpoints are refused."""
    if endpoint is None:
        raise LookupError("Endpoint not found")
    row = endpoint.asDict() if isinstance(endpoint, Row) else endpoint
    if not row["enabled"]:
        raise LookupError(f"Endpoint is disabled: {row['name']}")
    sql, args = bind(row["sql_query"], params or {})
    return run_select(spark, sql, args)


def find_endpoint(endpoints: DataFrame, name: str) -> Row | None:
    return endpoints.filter(F.col("name") == name).limit(1).first()


def run_widget(spark: SparkSession, widget: dict, endpoints: DataFrame) -> DataFrame:
    """Rows of a widget's data source, shaped for its type when it has visualization options."""
    source = widget["dataSource"]
    if source.get("type") == "endpoint":
        if not source.get("endpointName"):
            raise ValueError("endpoint source names no endpoint")
        rows = run_endpoint(spark, find_endpoint(endpoints, source["endpointName"]), source.get("params"))
    elif source.get("type") == "inline":
        if not source.get("sql"):
            raise ValueError("inline source holds no SQL")
        sql, args = bind(source["sql"], source.get("params") or {})
        rows = run_select(spark, sql, args)
    else:
        raise ValueError(f"Unknown data source type: {source.get('type')}")
    options = widget.get("visualization")
    return shape(rows, widget["type"], options) if options else rows

"""Conditions and rule evaluation."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.operators.rules import evaluate_condition, evaluate_rules
from logloom.operators.rules import judge as judge_rows
from logloom.plans import sqlapi

VALUES = {"errors": 12.0, "total": 80.0, "name": None}


def judge(spark, conditions, strict=False):
    """Outcomes by the column function, after checking that the frame function, which parses each text once, agrees."""
    df = spark.createDataFrame([(c, VALUES) for c in conditions], "c string, v map<string,double>")
    out = [(r.o.ok, r.o.error) for r in df.select(evaluate_condition(F.col("c"), F.col("v"), strict).alias("o")).collect()]
    once = {r.c: (r.outcome.ok, r.outcome.error) for r in judge_rows(df, "c", "v", strict).collect()}
    assert once == dict(zip(conditions, out))
    return out


def test_conditions(spark):
    cases = {
        "errors >= 10 && total > 100": (False, None), "errors >= 10": (True, None), "total == 80.0": (True, None), "total != 80": (False, None),
        "errors > 50 || total < 100": (True, None), "missing > 1": (None, "no column missing in the result"),
        "errors": (None, "no comparison in condition: errors"), "errors > ten": (None, "not a number to compare with: ten"),
        "name > 1": (None, "column name holds no number"), "errors > 100 && missing > 1": (None, "no column missing in the result"),
        "errors > 1 &&": (None, "no comparison in condition: ")}
    assert judge(spark, cases) == list(cases.values())


def test_or_binds_tighter_unless_strict(spark):
    text = ["errors == 12 || total == 0 && total == 1"]
    assert judge(spark, text) == [(False, None)] and judge(spark, text, strict=True) == [(True, None)]


def test_rows_keep_their_number_and_columns(spark):
    rows = spark.createDataFrame([(1, "a > 1", {"a": 2.0}, "x"), (1, "a > 1", {"a": 2.0}, "x"), (2, None, {"a": 2.0}, "y"), (3, "a > 1", None, "z"),
                                  (4, "", {}, "w")], "id int, c string, v map<string,double>, _program string")
    out = {}
    for r in judge_rows(rows, "c", "v").collect():
        out.setdefault(r.id, []).append((r._program, r.outcome and r.outcome.ok))
    assert out == {1: [("x", True)] * 2, 2: [("y", None)], 3: [("z", None)], 4: [("w", None)]}
    assert judge_rows(rows.limit(0), "c", "v").isEmpty()


comparison = st.tuples(st.sampled_from(["errors", "total"]), st.sampled_from([">", "<", ">=", "<=", "==", "!="]), st.integers(0, 100))


@given(st.lists(st.lists(comparison, min_size=1, max_size=3), min_size=1, max_size=3))
@settings(max_examples=15, deadline=None)
def test_conditions_match_python(spark, groups):
    text = " && ".join(" || ".join(f"{n} {o} {v}" for n, o, v in g) for g in groups)
    truth = all(any(eval(f"{VALUES[n]} {o} {v}") for n, o, v in g) for g in groups)
    assert judge(spark, [text]) == [(truth, None)]


def test_sql_guards(spark):
    spark.range(20000).createOrReplaceTempView("numbers")
    with pytest.raises(ValueError):
        sqlapi.run_select(spark, "WITH x AS (SELECT 1) SELECT * FROM x")
    whole = sqlapi.run_select(spark, "  select * from (select * from numbers limit 15000)")
    assert whole.count() == 15000 and sqlapi.run_select(spark, "select * from numbers", cap=10000).count() == 10000
    rows, more = sqlapi.fetch_page(whole, 100)
    assert len(rows) == 100 and more and sqlapi.fetch_page(spark.range(3), 3) == (spark.range(3).collect(), False)
    assert sqlapi.bind("select @a, @ab, @c", {"a": "1", "b-d": "2"}) == ("select :a, @ab, @c", {"a": "1"})
    injected = sqlapi.run_endpoint(spark, {"name": "e", "enabled": 1, "sql_query": "SELECT @x AS x"}, {"x": "' OR 1=1 --"})
    assert injected.first().x == "' OR 1=1 --"
    with pytest.raises(LookupError):
        sqlapi.run_endpoint(spark, {"name": "e", "enabled": 0, "sql_query": "SELECT 1"})
    with pytest.raises(LookupError):
        sqlapi.run_endpoint(spark, None)


def test_timeout(spark):
    endless = spark.range(10**14).agg(F.sum(F.sqrt("id")))
    start = time.monotonic()
    with pytest.raises(TimeoutError):
        sqlapi.fetch(endless, seconds=1)
    assert time.monotonic() - start < 30
    assert sqlapi.fetch(spark.range(3)) == spark.range(3).collect()


def test_a_failing_rule_leaves_the_others_alone(spark):
    spark.range(5).createOrReplaceTempView("five")
    rules = spark.createDataFrame([("bad", "SELECT 1 / (id - id) AS v FROM five", "v > 1"), ("good", "SELECT count(*) AS v FROM five", "v > 1"),
                                   ("worse", "SELEC", "v > 1"), ("none", "SELECT id AS v FROM five WHERE id > 9", "v > 1"),
                                   ("slow", "SELECT sum(sqrt(id)) AS v FROM range(100000000000000)", "v > 1")], "id string, query string, condition string")
    out = {r["id"]: (r["triggered"], r["error"]) for r in evaluate_rules(spark, rules, seconds=5).collect()}
    assert out["good"] == (True, None) and out["none"] == (False, "query returned no rows")
    assert not out["bad"][0] and "DIVIDE_BY_ZERO" in out["bad"][1] and out["worse"][1] and "timeout" in out["slow"][1]


def test_helpers_agree_with_property_functions(spark):
    sqlapi.register(spark, {})
    row = spark.sql("""SELECT JSONExtractString(j, 'k') AS a, JSONExtractString(j, 's') AS b, JSONExtractString(j, 'o', 't') AS c, JSONExtractFloat(j, 'k') AS d,
                       JSONExtractFloat(j, 's') AS e, JSONExtractFloat(j, 'o', 'n') AS f, JSONHas(j, 'a.b') AS g, JSONHas(j, 'zz') AS h
                       FROM VALUES ('{"k":5,"s":"7","o":{"t":"x","n":2.5},"a.b":1}') AS t(j)""").first()
    assert tuple(row) == ("", "7", "x", 5.0, 0.0, 2.5, True, False)


def test_helpers_take_paths_of_any_length(spark):
    sqlapi.register(spark, {})
    keys = [f"m{i}" for i in range(12)]
    deep = '"x"'
    for k in reversed(keys):
        deep = f'{{"{k}":{deep}}}'
    path = "array(" + ", ".join(f"'{k}'" for k in keys) + ")"
    row = spark.sql(f"""SELECT JSONExtractString(j, 'a', 'b', 'c', 'd') AS a, JSONExtractFloat(j, 'a', 'b', 'c', 'n') AS b, JSONHas(j, 'a', 'b', 'c') AS c,
                        JSONHas(j, 'a', 'b', 'zz', 'd') AS d, JSONExtractString(j, 'a', 'b') AS e, JSONPathString(deep, {path}) AS f,
                        JSONPathHas(deep, slice({path}, 1, 5)) AS g, JSONPathFloat(j, array('a', 'b', 'c', 'n')) AS h, JSONPathString(deep, array()) AS i,
                        JSONPathString(NULL, array('a')) AS k
                        FROM VALUES ('{{"a":{{"b":{{"c":{{"d":"x","n":2.5}}}}}}}}', '{deep}') AS t(j, deep)""").first()
    assert tuple(row)[:9] == ("x", 2.5, True, False, "", "x", True, 2.5, "")

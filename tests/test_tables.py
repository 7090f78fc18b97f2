"""Stored tables, plans and time ranges."""

from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from logloom.operators import aggregates as a
from logloom.operators.filters import LogQuery, from_saved_query, time_between
from logloom.operators.search import newest_first, table_sort
from logloom.operators.timerange import TimeRange, resolve_preset, shift_range
from logloom.plans.maintenance import apply_retention, delete_where, fold_marks
from logloom.plans.snapshots import latest_full, prune_snapshots, read_manifest, restore, restored_rows, snapshot_type, take_snapshot, touched_days
from logloom.session import scratch, shared_dir
from logloom.sources.event_table import append_event, compact, file_list, mark_deleted, marked_shares, read_events, write_events
from logloom.sources.storage import children, remove
from logloom.streaming.jobs import ingest_stream, landed_events
from logloom.suite.base import AS_OF, log_events
from logloom.suite.ingest_queries import clef_messages

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    path = scratch(spark, "stored")
    write_events(log_events(spark, SF), path)
    return path


def test_time_filter_reaches_the_scan(spark):
    plan = plan_of(a.service_stats(log_events(spark, SF), AS_OF))
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan


def test_day_partitions_are_pruned(spark, stored):
    plan = plan_of(a.service_stats(read_events(spark, stored), AS_OF))
    assert "PartitionFilters: [isnotnull(dt" in plan and "PushedFilters: [IsNotNull(timestamp), GreaterThan(timestamp" in plan


def test_search_keeps_a_top_n_per_task(spark):
    assert "TakeOrderedAndProject" in plan_of(newest_first(log_events(spark, SF)))


def test_rules_and_totals_scan_once(spark):
    from logloom.operators.rules import rule_counts
    from logloom.suite.rule_queries import SPECS

    assert plan_of(rule_counts(log_events(spark, SF), SPECS, AS_OF)).count("FileScan") == 1
    assert plan_of(a.current_metrics(log_events(spark, SF), AS_OF)).count("FileScan") == 1


def test_overview_reads_the_events_once(spark):
    ev = log_events(spark, SF)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(source):
        seen.add(1)
        return source
    parts = a.overview(ev.filter(counted("source").isNotNull()), AS_OF)
    for name, one in (("metrics", a.current_metrics(ev, AS_OF)), ("services", a.service_stats(ev, AS_OF)),
                      ("errors", a.error_summary(ev, AS_OF, hours=24, limit=10))):
        assert parts[name].collect() == one.collect() and parts[name].columns == one.columns
        assert all("/overview-" in f for f in parts[name].inputFiles())
    assert 0 < seen.value <= ev.count()


def test_overview_of_nothing(spark):
    parts = a.overview(log_events(spark, SF).filter("false"), AS_OF)
    assert parts["metrics"].first()["total_logs_24h"] == 0 and parts["services"].isEmpty() and parts["errors"].isEmpty()


def test_table_text_sorts_by_collation(spark):
    rows = spark.createDataFrame([(t,) for t in ["b", "Z", "\u00e4", "a", None, "B", "z", "A", "\u00c4b"]], "t string")
    assert [r.t for r in table_sort(rows, "t", descending=False).collect()] == ["a", "A", "\u00e4", "\u00c4b", "b", "B", "z", "Z", None]
    assert [r.t for r in table_sort(rows, "t").collect()] == ["Z", "z", "B", "b", "\u00c4b", "\u00e4", "A", "a", None]
    assert [r.t for r in table_sort(rows, "t", False, "UTF8_BINARY").collect()][:3] == ["A", "B", "Z"]
    assert table_sort(rows, "t").schema == rows.schema


def test_append_event(spark):
    row = append_event(spark, "Error", "boom", "svc", datetime(2026, 1, 2, 3, 4, 5, 678901), properties={"a": 1}).first()
    assert (row.message_template, row.event_type, row.properties, len(row.id)) == ("boom", "", '{"a": 1}', 36)
    assert str(row.timestamp) == "2026-01-02 03:04:05.678000" and str(row.dt) == "2026-01-02"


def test_delete_needs_a_filter_and_removes_empty_days(spark):
    path = scratch(spark, "days")
    write_events(log_events(spark, SF).filter(F.col("source").isin("svc-1", "svc-2")), path)
    with pytest.raises(ValueError):
        delete_where(spark, path, LogQuery())
    assert delete_where(spark, path, LogQuery("nobody")) == 0
    before = read_events(spark, path)
    lone = {r.dt for r in before.groupBy("dt").agg(F.max("source").alias("m")).filter("m = 'svc-1'").collect()}
    count = before.filter("source = 'svc-1'").count()
    assert delete_where(spark, path, LogQuery("svc-1")) == count
    after = read_events(spark, path)
    assert after.filter("source = 'svc-1'").count() == 0 and not lone & {r.dt for r in after.select("dt").distinct().collect()}


def test_retention_reports_counts(spark):
    path = scratch(spark, "trim")
    write_events(log_events(spark, SF), path)
    policies = spark.createDataFrame([("svc-1", 10), ("svc-2", 1)], "source string, retention_days bigint")
    old = {s: read_events(spark, path).filter((F.col("source") == s) & (F.col("timestamp") < F.lit(AS_OF - timedelta(days=d)))).count()
           for s, d in (("svc-1", 10), ("svc-2", 1))}
    assert {r["source"]: r["removed"] for r in apply_retention(spark, path, policies, AS_OF).collect()} == old
    assert apply_retention(spark, path, policies, AS_OF).isEmpty()


def test_retention_drops_whole_days_and_marks_the_rest(spark):
    path = scratch(spark, "wholedays")
    ev = log_events(spark, SF).filter(F.col("source").isin("svc-1", "svc-2"))
    write_events(ev, path)
    before = {r.dt for r in file_list(spark, path).collect()}
    policies = spark.createDataFrame([("svc-1", 10), ("svc-2", 10)], "source string, retention_days bigint")
    apply_retention(spark, path, policies, AS_OF)
    cutoff = (AS_OF - timedelta(days=10)).date()
    assert {r.dt for r in file_list(spark, path).collect()} == {d for d in before if d >= cutoff}
    assert read_events(spark, path).count() == ev.filter(F.col("timestamp") >= F.lit(AS_OF - timedelta(days=10))).count()


def test_a_delete_marks_rows_and_writes_none(spark):
    path = scratch(spark, "marks")
    ev = log_events(spark, SF)
    write_events(ev, path)
    files = {(r.dt, r.file, r.modified) for r in file_list(spark, path).collect()}
    reader = read_events(spark, path)  # read before the delete: sees all, now and later
    gone = ev.filter("source = 'svc-2' and level = 'Error'").count()
    assert delete_where(spark, path, LogQuery("svc-2", "Error")) == gone and gone > 0
    assert delete_where(spark, path, LogQuery("svc-2", "Error")) == 0
    assert {(r.dt, r.file, r.modified) for r in file_list(spark, path).collect()} == files
    assert reader.count() == ev.count() and read_events(spark, path).count() == ev.count() - gone
    write_events(ev.filter("source = 'svc-2' and level = 'Error'"), path)  # equal rows that come later stay
    assert read_events(spark, path).count() == ev.count()
    assert file_list(spark, path).agg(F.sum("marked")).first()[0] == gone


def test_an_uncommitted_delete_does_not_count(spark):
    path = scratch(spark, "uncommitted")
    write_events(log_events(spark, SF), path)
    count = read_events(spark, path).count()
    delete_where(spark, path, LogQuery("svc-1"))
    left = read_events(spark, path).count()
    (folder,) = children(spark, f"{path}/_deleted")
    remove(spark, f"{folder}/_COMMITTED")
    assert left < count == read_events(spark, path).count()


def test_compaction_folds_marks_in(spark):
    path = scratch(spark, "fold")
    write_events(log_events(spark, SF), path)
    delete_where(spark, path, LogQuery("svc-1"))
    left = sorted(r.id for r in read_events(spark, path).select("id").collect())
    shares = {r.dt: r.marked / r.rows for r in marked_shares(spark, path).collect()}
    limit = sorted(shares.values())[len(shares) // 2]
    assert fold_marks(spark, path, limit) == sorted(d for d, share in shares.items() if share >= limit)
    assert {r.dt for r in marked_shares(spark, path).collect()} == {d for d, share in shares.items() if share < limit}
    assert sorted(r.id for r in read_events(spark, path).select("id").collect()) == left
    fold_marks(spark, path, 0.0)
    assert marked_shares(spark, path).isEmpty() and children(spark, f"{path}/_deleted") == []
    assert spark.read.parquet(path).count() == len(left)


def test_filters_pass_below_the_marks(spark):
    path = scratch(spark, "pushed")
    write_events(log_events(spark, SF), path)
    delete_where(spark, path, LogQuery("svc-1"))
    plan = plan_of(a.service_stats(read_events(spark, path), AS_OF))
    assert "PartitionFilters: [isnotnull(dt" in plan and "PushedFilters: [IsNotNull(timestamp), GreaterThan(timestamp" in plan
    assert "LeftAnti" in plan


def test_snapshots_read_only_days_with_other_files(spark):
    path, root = scratch(spark, "touched"), scratch(spark, "snaps")
    ev = log_events(spark, SF)
    write_events(ev, path)
    full = take_snapshot(spark, path, root, datetime(2026, 2, 1, 3))
    base = spark.read.parquet(f"{root}/{full}/files")
    assert touched_days(file_list(spark, path), base).isEmpty()
    first, second, third = (r.dt for r in base.select("dt").distinct().orderBy("dt").limit(3).collect())
    write_events(ev.filter(F.to_date("timestamp") == F.lit(first)), path)
    mark_deleted(spark, path, F.col("dt") == F.lit(second))
    compact(spark, path, [third])  # other files, the same rows
    assert {r.dt for r in touched_days(file_list(spark, path), base).collect()} == {first, second, third}
    # a fingerprint of the base that is wrong on purpose stays as it is where no file changed: the day was not read
    wrong = spark.read.parquet(f"{root}/{full}/fingerprints").withColumn("rows", F.lit(-1).cast("bigint"))
    wrong.write.parquet(f"{root}/wrong")
    remove(spark, f"{root}/{full}/fingerprints")
    spark.read.parquet(f"{root}/wrong").write.parquet(f"{root}/{full}/fingerprints")
    name = take_snapshot(spark, path, root, datetime(2026, 2, 2, 3))
    anew = {r.dt for r in spark.read.parquet(f"{root}/{name}/fingerprints").filter("rows >= 0").collect()}
    assert anew == {first, third}  # nothing is left of the second day
    restored = sorted(r.id for r in restored_rows(spark, root, name).select("id").collect())
    assert restored == sorted(r.id for r in read_events(spark, path).select("id").collect())


def test_snapshot_rules(spark):
    sunday = datetime(2026, 2, 1, 3)
    assert snapshot_type([], sunday, 0) == "full"
    assert snapshot_type(["logs-full-2026-01-25-030000"], sunday, 0) == "full"
    assert snapshot_type(["logs-full-2026-02-01-010000"], sunday, 0) == "incremental"
    assert snapshot_type(["logs-full-2026-01-25-030000"], sunday + timedelta(days=1), 0) == "incremental"
    assert latest_full(["logs-2025-01-01-000000", "logs-incr-2026-01-01-000000"]) == "logs-2025-01-01-000000"


def test_pruning_protects_bases(spark, stored):
    root = scratch(spark, "snaps")
    names = [take_snapshot(spark, stored, root, datetime(2026, 2, d, 3), full_weekday=w) for d, w in ((1, 0), (2, 0), (3, 2), (4, 0))]
    assert [n[5:9] for n in names] == ["full", "incr", "full", "incr"]
    assert prune_snapshots(spark, root, 2) == [names[1]]  # its base stays: it was still referenced when the pass began
    assert prune_snapshots(spark, root, 2) == [names[0]]
    target = scratch(spark, "back")
    assert restore(spark, root, names[3], target) == read_events(spark, stored).count()
    assert read_manifest(spark, root).count() == 2


def test_stream_resumes_and_adds_new_files(spark):
    inbox, root, checkpoint = (scratch(spark, x) for x in ("inbox", "landing", "checkpoint"))
    messages = clef_messages(spark, SF).select(F.col("message_id").alias("id"), F.col("raw").alias("body"))
    half = F.col("id").cast("int") % 2 == 0
    for part in (half, ~half):
        messages.filter(part).write.mode("append").json(inbox)
        ingest_stream(spark, inbox, root, checkpoint, AS_OF.isoformat(" ")).awaitTermination()
    events = landed_events(spark, root)
    assert events.count() == events.select("id").distinct().count() == log_events(spark, SF).count()


def test_shared_folder():
    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(session("yarn", "hdfs:/x/")) == shared_dir(session("local[2]", "hdfs:/x")) == "hdfs:/x"
    assert shared_dir(session("local[2]", "")) == shared_dir(session("local", None))
    with pytest.raises(RuntimeError):
        shared_dir(session("yarn", ""))


def test_ranges():
    now = datetime(2024, 1, 31, 15, 30)
    assert resolve_preset("week", now) == (datetime(2024, 1, 29), None) and resolve_preset("all", now) == (None, None)
    assert resolve_preset("odd", now) == (now - timedelta(days=1), None)
    back = shift_range(TimeRange("4h"), "backward", now)
    assert back == TimeRange(start=now - timedelta(hours=8), end=now - timedelta(hours=4))
    assert shift_range(back, "forward", now).end == now and shift_range(TimeRange("1h"), "forward", now) == TimeRange("1h")


def test_default_window_and_saved_queries(spark):
    ev = log_events(spark, SF)
    assert time_between(ev, None, None, AS_OF).count() == ev.filter(F.col("timestamp") > F.lit("2024-01-30").cast("timestamp_ntz")).count()
    q = from_saved_query({"source": "s", "property_filters": '[{"key":"k","value":"5","operator":">"},{"key":"z","value":"x"}]'})
    assert [f.operator for f in q.properties] == [">", "="] and from_saved_query({"property_filters": "bad"}).empty
    assert from_saved_query({"property_filters": '{"k":"5"}'}).properties[0].operator == "="

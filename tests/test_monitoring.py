import datetime as dt

import pytest
from pyspark.sql import functions as F

from opinionmill.functions.times import moment, seconds_between
from opinionmill.operators import monitoring as mon
from opinionmill.plans import dashboard
from opinionmill.plans.batch import daily_snapshot

AS_OF = "2024-01-31 12:00:00"


def frame(spark, schema, *rows):
    names = [f.split()[0] for f in schema.split(", ")]
    text = spark.createDataFrame(list(rows), ", ".join(f"{n} string" for n in names))
    return text.select([F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in schema.split(", ")])


def test_seconds_are_marks_passed(spark):
    df = frame(spark, "a timestamp_ntz, b timestamp_ntz", ("2024-01-01 00:00:00.9", "2024-01-01 00:00:02.1"))
    assert df.select(seconds_between(F.col("a"), F.col("b"))).first()[0] == 2


def test_stages(spark):
    logs = frame(
        spark, "log_timestamp timestamp_ntz, message string",
        ("2024-01-01 00:00:00", "MIGRATION of seed"), ("2024-01-01 00:01:00", "migration done"),
        ("2024-01-01 00:02:00", "TB_REVIEWS_SRC loaded"), ("2024-01-01 00:03:00", "Sentiment scored"),
        ("2024-01-01 00:04:00", "nothing"), ("2024-01-01 00:05:00", None))
    assert [(r.stage, r.duration_sec) for r in mon.stage_durations(logs).collect()] == [
        ("Migrations", 60), ("Seed Load", 1), ("AI Enrichment", 1)]
    own = [("Second", ["%done%", "%loaded%"]), ("First", ["%of%"])]
    assert {r.stage: r["count"] for r in mon.classify(logs, own).groupBy("stage").count().collect()} == {"First": 1, "Second": 2}


def test_windows_are_closed(spark):
    m = frame(
        spark, "start_time timestamp_ntz, credits_used double, service_type string",
        ("2024-01-01 11:59:59", 100, "a"), ("2024-01-01 12:00:00", 1, "a"), ("2024-01-31 12:00:00", 2, "a"),
        ("2024-01-31 12:00:01", 100, "a"), ("2024-01-15 00:00:00", 4, "b"), ("2024-01-15 00:00:00", None, "b"))
    assert mon.metering_30d(m, AS_OF).first()[0] == 7.0
    assert mon.metering_30d(m, AS_OF, "service_type", "a").first()[0] == 3.0
    assert mon.metering_30d(m, AS_OF, "service_type", "none").first()[0] == 0.0
    assert mon.metering_30d(m, dt.datetime(2024, 1, 31, 12)).first()[0] == 7.0
    assert mon.metering_30d(m).first()[0] == 0.0


def test_now_is_the_default(spark):
    row = spark.range(1).select(moment(None)).first()
    assert abs((row[0] - dt.datetime.now(dt.UTC).replace(tzinfo=None)).total_seconds()) < 60


def sources(spark):
    metering = frame(
        spark, "start_time timestamp_ntz, credits_used double, warehouse_name string, service_type string",
        ("2024-01-30 00:00:00", 1.23456, "WH", "AI_SERVICES"), ("2024-01-30 00:00:00", 2, "WH", "x"),
        ("2024-01-30 00:00:00", 4, "other", "AI_SERVICES"))
    storage = frame(
        spark, "usage_date date, average_database_bytes double, database_name string",
        ("2024-01-01", 2 ** 30, "DB_PRO"), ("2024-01-31", 2 ** 31, "db_pro_x"), ("2023-12-31", 2 ** 33, "DB_PRO"),
        ("2024-01-30", 2 ** 33, "DB_DES"))
    return metering, metering, storage


def test_snapshot(spark):
    snapshot = mon.cost_snapshot(*sources(spark), AS_OF, warehouse_name="WH", database_like="pro")
    assert tuple(snapshot.first())[:4] == (dt.date(2024, 1, 31), 3.2346, 5.2346, 3.0)
    empty = [s.limit(0) for s in sources(spark)]
    assert tuple(mon.cost_snapshot(*empty, AS_OF, warehouse_name="WH").first())[1:4] == (0.0, 0.0, 0.0)


def test_snapshot_goes_in_once_a_day(spark, tmp_path):
    snapshot = mon.cost_snapshot(*sources(spark), AS_OF, warehouse_name="WH")
    assert mon.append_snapshot(snapshot, snapshot.limit(0)).count() == 1
    assert mon.append_snapshot(snapshot, snapshot).count() == 0
    for _ in range(2):
        daily_snapshot(spark, snapshot, str(tmp_path / "snapshots"))
    assert spark.read.parquet(str(tmp_path / "snapshots")).count() == 1


def test_latest_snapshot_and_live_sums(spark):
    schema = "snapshot_date date, wh_credits double, ai_credits double, storage_gb double"
    snapshots = frame(spark, schema, ("2024-01-01", 1, 1, 1), ("2024-01-02", 2, None, 2))
    assert tuple(mon.latest_snapshot(snapshots).first()) == (dt.date(2024, 1, 2), 2.0, 0.0, 2.0)
    unusable = frame(spark, schema, ("2024-01-03", None, 1, 1))

    def costs(snap):
        warehouse, ai, _ = sources(spark)
        live = {
            "wh_credits": lambda: mon.metering_30d(warehouse, AS_OF, "warehouse_name", "WH"),
            "ai_credits": lambda: mon.metering_30d(ai, AS_OF, "service_type", mon.AI_SERVICE),
            "storage_gb": lambda: spark.table("no_such_table"),
        }
        return tuple(dashboard.current_costs(spark, lambda: snap, live).first())[1:]

    # A figure whose source is absent is null, the others are there.
    assert costs(snapshots) == (2.0, 0.0, 2.0) and costs(unusable) == costs(snapshots.limit(0)) == (3.23, 5.23, None)


def test_second_choices(spark):
    def absent():
        return spark.table("no_such_table")

    logs = frame(spark, "log_timestamp timestamp_ntz, level string, message string", ("2024-01-01 00:00:00", "INFO", "seed"))
    records = frame(spark, "timestamp timestamp_ntz, record string, value int", ("2024-01-01 00:00:00", "{}", 7))
    assert dashboard.event_logs(spark, lambda: logs, absent).first().message == "seed"
    assert dashboard.event_logs(spark, absent, lambda: records).first().message == "7"
    assert dashboard.event_logs(spark, absent, absent).columns == ["timestamp", "severity", "message"]
    assert dashboard.stage_durations(spark, lambda: logs).first().stage == "Seed Load"
    assert dashboard.stage_durations(spark, absent).count() == 0
    usage = frame(spark, "start_time timestamp_ntz, function_name string, credits_used double", ("2024-01-30 00:00:00", "COMPLETE", 2))
    queries = frame(spark, "start_time timestamp_ntz, query_text string, error_code string",
                    ("2024-01-30 00:00:00", mon.CALL_MARK + ".COMPLETE", None))
    assert dashboard.cost_breakdown(spark, lambda: usage, absent, AS_OF).first().credits == 2.0
    for nothing in (absent, lambda: usage.limit(0)):
        assert tuple(dashboard.cost_breakdown(spark, nothing, lambda: queries, AS_OF).first()) == ("COMPLETE", 1, None)
    ai = dashboard.ai_usage(spark, absent, lambda: usage)
    assert mon.metering_30d(ai, AS_OF, "service_type", mon.AI_SERVICE).first()[0] == 2.0
    assert dashboard.task_status(spark, absent, absent).columns == ["name", "enabled", "schedule", "last_run", "last_result"]


def test_usage(spark):
    usage = frame(
        spark, "start_time timestamp_ntz, function_name string, credits_used double",
        ("2024-01-30 00:00:00", "COMPLETE", 0.1), ("2024-01-30 00:00:00", "COMPLETE", 0.2), ("2024-01-30 00:00:00", "SENTIMENT", 1),
        ("2023-01-30 00:00:00", "SENTIMENT", 50))
    assert [tuple(r) for r in mon.usage_by_function(usage, AS_OF).collect()] == [("SENTIMENT", 1, 1.0), ("COMPLETE", 2, 0.3)]


def test_call_counts(spark):
    q = frame(
        spark, "start_time timestamp_ntz, query_text string, error_code string",
        *[("2024-01-30 00:00:00", text, code) for text, code in [
            ("select m.complete(1)", None), ("SELECT M.COMPLETE(2)", None), ("select m.other()", None),
            ("select m.complete(3)", "604"), ("select 1", None), (None, None)]])
    got = mon.call_counts_by_function(q, AS_OF, [("COMPLETE", ["%m.complete%"])], "m.")
    assert [tuple(r) for r in got.collect()] == [("COMPLETE", 2, None), ("OTHER", 1, None)]
    assert dict(got.dtypes)["credits"] == "double"


def test_latest_run_and_task_status(spark):
    history = frame(
        spark, "event_id int, task_name string, state string, completed_time timestamp_ntz",
        (1, "a", "FAILED", "2024-01-30 10:00:00"), (2, "a", "SUCCEEDED", "2024-01-30 11:07:30"), (3, "a", "RUNNING", None),
        (4, "b", "SUCCEEDED", "2024-01-01 00:00:00"), (5, "c", "RUNNING", None), (6, "d", "X", "2024-01-30 10:00:00"))
    assert {r.event_id for r in mon.latest_per_key(history, "task_name", "completed_time").collect()} == {2, 4, 5, 6}
    tasks = frame(spark, "name string, state string, schedule string",
                  ("a", "started", "hourly"), ("b", "suspended", None), ("c", "started", "daily"))
    got = {r.name: tuple(r)[1:] for r in mon.task_status(tasks, history, AS_OF).collect()}
    assert got == {
        "a": ("STARTED", "hourly", "2024-01-30 11:07 UTC", "SUCCEEDED"), "b": ("SUSPENDED", None, "—", "—"),
        "c": ("STARTED", "daily", "—", "RUNNING")}
    assert [r.name for r in mon.task_status(tasks, history, AS_OF, names=["c", "d"]).collect()] == ["c"]


def test_log_tails(spark):
    logs = frame(spark, "log_timestamp timestamp_ntz, level string, message string",
                 *[(f"2024-01-01 00:00:0{i}", "INFO", f"m{i}") for i in range(5)])
    assert [tuple(r)[1:] for r in mon.event_log_tail(logs, 2).collect()] == [("INFO", "m4"), ("INFO", "m3")]
    same = frame(spark, "log_timestamp timestamp_ntz, level string, message string",
                 *[("2024-01-01 00:00:00", "INFO", f"m{i}") for i in range(9)])
    assert [r.message for r in mon.event_log_tail(same.repartition(4), 2).collect()] == ["m8", "m7"]
    records = frame(spark, "timestamp timestamp_ntz, record string, value int",
                    ("2024-01-01 00:00:00", '{"severity_text": "WARN"}', 7), ("2024-01-02 00:00:00", "{}", 8))
    assert [tuple(r)[1:] for r in mon.event_record_tail(records).collect()] == [(None, "8"), ("WARN", "7")]


@pytest.mark.parametrize("fn", [mon.usage_by_function])
def test_empty_usage(spark, fn):
    assert fn(spark.createDataFrame([], "start_time timestamp_ntz, function_name string, credits_used double"), AS_OF).count() == 0

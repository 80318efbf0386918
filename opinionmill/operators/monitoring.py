"""Run logs, task runs and usage figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opinionmill.functions.rounding import round_half_up
from opinionmill.functions.text import contains_ignoring_case, first_label, json_field
from opinionmill.functions.times import AsOf, last_days, moment, seconds_between
from opinionmill.plans.joins import first_per_key

# Fixed values.
STAGE_PATTERNS = [
    ("Migrations", ["%migration%"]),
    ("Seed Load", ["%seed%", "%tb_reviews_src%"]),
    ("Schemachange", ["%schemachange%"]),
    ("AI Enrichment", ["%enrichment%", "%cortex%", "%sentiment%", "%keyword%"]),
    ("App Deploy", ["%deploy%", "%streamlit%"]),
]
CALL_MARK = "SNOWFLAKE.CORTEX"
CALL_PATTERNS = [("COMPLETE", ["%CORTEX.COMPLETE%"]), ("SENTIMENT", ["%CORTEX.SENTIMENT%"])]
OTHER_CALL = "OTHER"
AI_SERVICE = "AI_SERVICES"
NO_RUN = "—"


# Logs


def event_log_tail(logs: DataFrame, n: int = 50, tie: str | None = None) -> DataFrame:
    """The last ``n`` run-log rows; rows of the same time by ``tie``, then by message and level."""
    order = [F.desc("log_timestamp"), *([F.desc(tie)] if tie else []), F.desc("message"), F.desc("level")]
    return logs.orderBy(*order).limit(n).select(
        F.col("log_timestamp").alias("timestamp"), F.col("level").alias("severity"), "message"
    )


def event_record_tail(events: DataFrame, n: int = 50) -> DataFrame:
    """The same from a semi-structured event table (timestamp, JSON record, value)."""
    return events.orderBy(F.desc("timestamp"), F.desc("value"), F.desc("record")).limit(n).select(
        "timestamp", json_field(F.col("record"), "severity_text").alias("severity"),
        F.col("value").cast("string").alias("message"),
    )


def classify(logs: DataFrame, patterns: list[tuple[str, list[str]]] = STAGE_PATTERNS) -> DataFrame:
    """Label every message by the first pattern that fits; rows that fit none are dropped."""
    labelled = logs.withColumn("stage", first_label(F.col("message"), patterns))
    return labelled.where(F.col("stage").isNotNull())


def stage_durations(logs: DataFrame, patterns: list[tuple[str, list[str]]] = STAGE_PATTERNS) -> DataFrame:
    spans = classify(logs, patterns).groupBy("stage").agg(
        F.min("log_timestamp").alias("first_event"), F.max("log_timestamp").alias("last_event")
    )
    seconds = seconds_between(F.col("first_event"), F.col("last_event"))
    return spans.withColumn("duration_sec", F.greatest(seconds, F.lit(1).cast("bigint"))).orderBy("first_event", "stage")


# Tasks


def latest_per_key(df: DataFrame, key: str, time: str, tie: str | None = None) -> DataFrame:
    """The most recent row of each key; rows without a time come last.

    Of rows of one time the one with the largest ``tie`` counts, or without one the largest, column by column.
    """
    ties = [tie] if tie else [c for c in df.columns if c not in (key, time)]
    return first_per_key(df, [key], [F.desc_nulls_last(time), *[F.desc_nulls_last(c) for c in ties]])


def task_status(
    tasks: DataFrame, history: DataFrame, as_of: AsOf = None, days: int = 7, tie: str | None = None,
    names: list[str] | None = None,
) -> DataFrame:
    """Every task, or those in ``names``, with its state, schedule and last run of the past ``days``."""
    if names is not None:
        tasks, history = tasks.where(F.col("name").isin(*names)), history.where(F.col("task_name").isin(*names))
    recent = history.where(last_days("completed_time", as_of, days) | F.col("completed_time").isNull())
    runs = latest_per_key(recent, "task_name", "completed_time", tie).select(
        F.col("task_name").alias("name"),
        F.date_format("completed_time", "yyyy-MM-dd HH:mm 'UTC'").alias("last_run"),
        F.col("state").alias("last_result"),
    )
    return (
        tasks.select("name", F.upper("state").alias("enabled"), "schedule")
        .join(runs, "name", "left").fillna(NO_RUN, ["last_run", "last_result"])
    )


# Usage


def metering_30d(
    metering: DataFrame, as_of: AsOf = None, column: str | None = None, value: str | None = None,
    digits: int = 2, days: int = 30,
) -> DataFrame:
    """Credits of the past 30 days, of one warehouse or service where ``column`` is given."""
    return _credits(metering, as_of, column, value, days).agg(_total(digits).alias("credits"))


def storage_30d(
    usage: DataFrame, as_of: AsOf = None, name_like: str = "", digits: int = 2, days: int = 30,
) -> DataFrame:
    """Sum of the daily average sizes of the past 30 days, in GB."""
    return _gigabytes(usage, as_of, name_like, days).agg(_total(digits).alias("storage_gb"))


def _credits(metering: DataFrame, as_of: AsOf, column: str | None, value: str | None, days: int = 30) -> DataFrame:
    kept = metering.where(last_days("start_time", as_of, days))
    if column:
        kept = kept.where(F.col(column) == value)
    return kept.select(F.col("credits_used").cast("double").alias("amount"))


def _gigabytes(usage: DataFrame, as_of: AsOf, name_like: str, days: int = 30) -> DataFrame:
    today = moment(as_of).cast("date")
    kept = usage.where(F.col("usage_date").between(F.date_sub(today, days), today))
    if name_like:
        kept = kept.where(contains_ignoring_case(F.col("database_name"), name_like))
    return kept.select((F.col("average_database_bytes") / F.lit(1024.0 ** 3)).alias("amount"))


def _total(digits: int, condition: Column | None = None) -> Column:
    amount = F.col("amount") if condition is None else F.when(condition, F.col("amount"))
    return round_half_up(F.coalesce(F.sum(amount), F.lit(0.0)), digits)


def cost_snapshot(
    warehouse: DataFrame, ai: DataFrame, storage: DataFrame, as_of: AsOf = None, *,
    warehouse_name: str, database_like: str = "", service: str = AI_SERVICE, digits: int = 4,
) -> DataFrame:
    """One row: the day and the three 30-day totals, each 0 where there is nothing.

    The sources are stacked under a label and summed in one pass, so nothing is joined.
    """
    def labelled(df: DataFrame, label: str) -> DataFrame:
        return df.withColumn("metric", F.lit(label))

    stacked = (
        labelled(_credits(warehouse, as_of, "warehouse_name", warehouse_name), "wh")
        .unionByName(labelled(_credits(ai, as_of, "service_type", service), "ai"))
        .unionByName(labelled(_gigabytes(storage, as_of, database_like), "gb"))
    )
    metric = F.col("metric")
    return stacked.agg(
        _total(digits, metric == "wh").alias("wh_credits"),
        _total(digits, metric == "ai").alias("ai_credits"),
        _total(digits, metric == "gb").alias("storage_gb"),
    ).select(moment(as_of).cast("date").alias("snapshot_date"), "*", moment(as_of).alias("created_at"))


def append_snapshot(snapshot: DataFrame, existing: DataFrame) -> DataFrame:
    """The snapshot row, or no row where its date is already there."""
    return snapshot.join(existing.select("snapshot_date"), "snapshot_date", "left_anti").select(snapshot.columns)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    order = [F.desc("snapshot_date")] + ([F.desc("created_at")] if "created_at" in snapshots.columns else [])
    return snapshots.orderBy(*order).limit(1).select(
        "snapshot_date", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("wh_credits", "ai_credits", "storage_gb")]
    )


def usable_snapshot(snapshots: DataFrame) -> bool:
    """Whether the most recent snapshot holds a warehouse figure; if not, the live sums are read."""
    last = snapshots.orderBy(F.desc("snapshot_date")).limit(1)
    return not last.where(F.col("wh_credits").isNotNull()).isEmpty()


def usage_by_function(usage: DataFrame, as_of: AsOf = None, days: int = 30) -> DataFrame:
    return (
        usage.where(last_days("start_time", as_of, days)).groupBy("function_name")
        .agg(
            F.count("*").alias("call_count"),
            round_half_up(F.sum(F.col("credits_used").cast("double")), 6).alias("credits"),
        )
        .orderBy(F.desc_nulls_first("credits"), "function_name")
    )


def call_counts_by_function(
    queries: DataFrame, as_of: AsOf = None, patterns: list[tuple[str, list[str]]] = CALL_PATTERNS,
    mark: str = CALL_MARK, days: int = 30,
) -> DataFrame:
    """Calls counted from the query history, for hosts without a usage table; credits unknown."""
    kept = queries.where(
        last_days("start_time", as_of, days)
        & contains_ignoring_case(F.col("query_text"), mark)
        & F.col("error_code").isNull()
    )
    return (
        kept.groupBy(first_label(F.col("query_text"), patterns, OTHER_CALL).alias("function_name"))
        .agg(F.count("*").alias("call_count"))
        .select("*", F.lit(None).cast("double").alias("credits"))
        .orderBy(F.desc("call_count"), "function_name")
    )

"""Reads with a second choice: the first source that is there answers.

Sources are given as functions that load them, so that an absent one costs nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from opinionmill.functions.times import AsOf
from opinionmill.operators import monitoring as mon
from opinionmill.operators.quality import Rule, run_checks
from opinionmill.schemas import AI_USAGE, COST_SNAPSHOT, EVENT_LOG_TAIL, FIGURE, FUNCTION_USAGE, STAGE_DURATIONS, TASK_STATUS
from opinionmill.sources.tables import Loader, first_available, has_rows


def event_logs(spark: SparkSession, run_logs: Loader, event_table: Loader, n: int = 50) -> DataFrame:
    """The last ``n`` entries of the run log, else of the host's event table."""
    loaders = [lambda: mon.event_log_tail(run_logs(), n), lambda: mon.event_record_tail(event_table(), n)]
    return first_available(spark, loaders, EVENT_LOG_TAIL)


def stage_durations(spark: SparkSession, run_logs: Loader) -> DataFrame:
    return first_available(spark, [lambda: mon.stage_durations(run_logs())], STAGE_DURATIONS)


def current_costs(spark: SparkSession, snapshots: Loader, live: dict[str, Loader]) -> DataFrame:
    """The latest snapshot, or live totals while there is none with a warehouse figure.

    ``live`` has a loader for each of the three figures, giving one value in one row. A figure whose
    source is absent stays null; the others are shown.
    """
    columns = COST_SNAPSHOT.names[:4]

    def stored() -> DataFrame:
        df = snapshots()
        return mon.latest_snapshot(df) if mon.usable_snapshot(df) else df.limit(0)

    def figure(name: str) -> DataFrame:
        def load() -> DataFrame:
            df = live[name]()
            return df.select(F.lit(name).alias("name"), F.col(df.columns[0]).cast("double").alias("value"))

        return first_available(spark, [load] if name in live else [], FIGURE)

    def totals() -> DataFrame:
        found = reduce(DataFrame.unionByName, [figure(name) for name in columns[1:]])
        values = [F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in columns[1:]]
        return found.agg(*values).select(F.current_date().alias("snapshot_date"), *columns[1:])

    return first_available(spark, [lambda: stored().select(columns), totals], COST_SNAPSHOT, has_rows)


def ai_usage(spark: SparkSession, metering: Loader, function_usage: Loader, service: str = mon.AI_SERVICE) -> DataFrame:
    """Rows to sum for the AI credits: the metering table, else all calls of the usage table."""
    columns = ["start_time", "credits_used", "service_type"]
    loaders = [
        lambda: metering().select(columns),
        lambda: function_usage().withColumn("service_type", F.lit(service)).select(columns),
    ]
    return first_available(spark, loaders, AI_USAGE)


def cost_breakdown(spark: SparkSession, usage: Loader, query_history: Loader, as_of: AsOf = None) -> DataFrame:
    """Calls and credits per function, else calls counted from the query history."""
    loaders = [lambda: mon.usage_by_function(usage(), as_of), lambda: mon.call_counts_by_function(query_history(), as_of)]
    return first_available(spark, loaders, FUNCTION_USAGE, has_rows)


def task_status(spark: SparkSession, tasks: Loader, history: Loader, as_of: AsOf = None) -> DataFrame:
    return first_available(spark, [lambda: mon.task_status(tasks(), history(), as_of)], TASK_STATUS)


def source_checks(spark: SparkSession, source: Loader, rules: list[Rule]) -> DataFrame:
    """The quality rules on a source; one that is absent counts as having no columns and no rows."""
    return run_checks(first_available(spark, [source], T.StructType([])), rules)

"""Data-quality rules and the stratified sample."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from opinionmill.functions.text import is_empty
from opinionmill.plans.joins import first_n, first_per_key, fits_broadcast

# Fixed values.
REVIEW_COLUMNS = ("ID", "ASIN", "STARS", "BODY", "VERIFIED_PURCHASE", "FOUND_HELPFUL")
PRODUCT_COLUMNS = ("ASIN",)
STAR_VALUES = (1, 2, 3, 4, 5)
SAMPLE_ROWS, SAMPLE_TOLERANCE = 5000, 10
FILLED_BODIES = 0.8

# Spark cuts ranks below this before the shuffle; beyond, ranges of about so many keys are counted.
LARGEST_RANK = 1000
ROWS_PER_RANGE = 1000


@dataclass(frozen=True)
class Rule:
    """A figure taken from the table, and the closed range it has to be in.

    ``figure`` turns a DataFrame into an aggregate, or into a number known from its columns alone.
    A rule with ``key`` counts the rows beyond the first of each key instead.
    """

    name: str
    low: float | None = None
    high: float | None = None
    figure: Callable[[DataFrame], Column] | None = None
    columns: tuple[str, ...] = ()
    key: str | None = None

    @property
    def threshold(self) -> str:
        if self.low == self.high:
            return f"= {self.low:g}"
        if self.high is None:
            return f">= {self.low:g}"
        if self.low is None:
            return f"<= {self.high:g}"
        return f"{self.low:g}..{self.high:g}"


def required_columns(columns: tuple[str, ...]) -> Rule:
    def missing(df: DataFrame) -> Column:
        return F.lit(len({c.upper() for c in columns} - {c.upper() for c in df.columns}))

    return Rule("required_columns", 0, 0, missing)


def unique_names() -> Rule:
    return Rule("unique_names", 0, 0, lambda df: F.lit(len(df.columns) - len({c.upper() for c in df.columns})))


def has_rows() -> Rule:
    return Rule("has_rows", 1, None, lambda df: F.count("*"))


def row_count(low: int, high: int) -> Rule:
    return Rule("row_count", low, high, lambda df: F.count("*"))


def not_null(column: str) -> Rule:
    return Rule(f"{column}_not_null", 0, 0, lambda df: F.count_if(F.col(column).isNull()), (column,))


def within(column: str, values: tuple) -> Rule:
    return Rule(f"{column}_in_range", 0, 0, lambda df: F.count_if(~F.col(column).isin(*values)), (column,))


def all_present(column: str, values: tuple) -> Rule:
    def found(df: DataFrame) -> Column:
        # One flag per value: no distinct, so no second shuffle.
        return sum((F.max(F.when(F.col(column) == v, 1).otherwise(0)) for v in values), F.lit(0))

    return Rule(f"{column}_all_values", len(values), len(values), found, (column,))


def unique(column: str) -> Rule:
    return Rule(f"{column}_unique", 0, 0, columns=(column,), key=column)


def filled(column: str, least: float) -> Rule:
    return Rule(
        f"{column}_filled", least, None,
        lambda df: F.avg(F.when(~is_empty(F.col(column)), 1.0).otherwise(0.0)), (column,),
    )


def no_empty_rows() -> Rule:
    def empty(df: DataFrame) -> Column:
        values = [F.col(f"`{c}`").cast("string") for c in df.columns]
        return F.count_if(F.coalesce(F.lit(None).cast("string"), *values).isNull())

    return Rule("no_empty_rows", 0, 0, empty)


def review_rules(rows: int = SAMPLE_ROWS, tolerance: int = SAMPLE_TOLERANCE) -> list[Rule]:
    return [
        required_columns(REVIEW_COLUMNS), unique_names(), has_rows(), row_count(rows - tolerance, rows),
        not_null("id"), not_null("asin"), within("stars", STAR_VALUES), all_present("stars", STAR_VALUES),
        unique("id"), filled("body", FILLED_BODIES),
    ]


def product_rules() -> list[Rule]:
    return [
        required_columns(PRODUCT_COLUMNS), unique_names(), has_rows(), not_null("asin"), unique("asin"),
        no_empty_rows(),
    ]


def run_checks(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule: rule, observed, threshold, passed.

    All row rules share one pass without a shuffle of rows. A uniqueness rule reads its own column
    only and counts per key, pre-aggregated by each task. A rule on an absent column fails.
    """
    names = {c.upper() for c in df.columns}

    def row(rule: Rule, observed: Column) -> Column:
        passed = F.lit(True)
        if rule.low is not None:
            passed = passed & (observed >= rule.low)
        if rule.high is not None:
            passed = passed & (observed <= rule.high)
        return F.struct(
            F.lit(rule.name).alias("rule"), observed.alias("observed"),
            F.lit(rule.threshold).alias("threshold"), F.coalesce(passed, F.lit(False)).alias("passed"),
        )

    def listed(figures: DataFrame, chosen: list[Rule]) -> DataFrame:
        rows = [row(rule, F.col(f"f{i}")) for i, rule in enumerate(chosen)]
        return figures.select(F.inline(F.array(*rows)))

    def known(rule: Rule) -> bool:
        return all(c.upper() in names for c in rule.columns)

    by_row = [r for r in rules if r.key is None or not known(r)]
    figures = [
        (r.figure(df) if known(r) else F.lit(None)).cast("double").alias(f"f{i}") for i, r in enumerate(by_row)
    ]
    # The first aggregate keeps the result a single row where every other figure is a constant.
    result = listed(df.agg(F.count("*").alias("rows"), *figures), by_row)
    for rule in rules:
        if rule.key is not None and known(rule):
            copies = df.where(F.col(rule.key).isNotNull()).groupBy(rule.key).agg(F.count("*").alias("n"))
            extra = copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("double").alias("f0"))
            result = result.unionByName(listed(extra, [rule]))
    return result


def stratified_sample(df: DataFrame, k: int, key: str = "id", stratum: str = "stars") -> DataFrame:
    """The first ``k`` rows of each stratum by the MD5 of the key, after de-duplication on the key.

    Of rows that share a key the smallest counts, by stratum and then column by column. Only keys
    and strata are ranked, and each task sends the first ``k`` of a stratum; the rows of the chosen
    keys are fetched by broadcast. For a ``k`` too large for that, hash ranges that grow in number
    with the table are counted first, so that no task sorts a whole stratum.
    """
    there = df.dropna(subset=[key, stratum])
    keys = there.groupBy(key).agg(F.min(stratum).alias(stratum)).withColumn("_hash", F.md5(F.col(key).cast("string")))
    order = [F.col("_hash").asc(), F.col(key).asc()]
    if k < LARGEST_RANK:
        chosen = first_n(keys, k, [stratum], order)
    else:
        digits = max(3, math.ceil(math.log(max(keys.count(), 1) / ROWS_PER_RANGE, 16)))
        ranged = keys.withColumn("_range", F.left("_hash", F.lit(digits)))
        before = Window.partitionBy(stratum).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        counts = ranged.groupBy(stratum, "_range").agg(F.count("*").alias("_n"))
        starts = counts.select(stratum, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        place = F.row_number().over(Window.partitionBy(stratum, "_range").orderBy(*order))
        near = ranged.join(starts.where(F.col("_start") < k), [stratum, "_range"])
        chosen = near.withColumn("_place", F.col("_start") + place).where(F.col("_place") <= k)
    chosen = chosen.select(key, stratum)
    few = fits_broadcast(chosen)
    rows = there.join(F.broadcast(chosen) if few else chosen, [key, stratum], "left_semi")
    others = [F.asc_nulls_first(c) for c in df.columns if c not in (key, stratum)]
    return first_per_key(rows, [key], others or [F.col(key).asc()]).select(df.columns)

"""The questions of :mod:`opinionmill.operators.reviews` over partial sums instead of rows.

A partial has one row for each product, stars, status and hour of a set of reviews, with counts and sums. Partials of
different sets add up, and a set of reviews whose state has changed is taken off and added again; so rows of a partial
may be negative, their sums over all sets never are.

The neutral band of :func:`stars_sentiment_breakdown` is part of a partial: ``BAND``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opinionmill.functions.rounding import round_half_up
from opinionmill.operators import reviews

BAND = 0.1

KEYS = ["asin", "stars", "enrichment_status", "hour"]
_FULL = "FULLY_ENRICHED"
# Sums of sentiment are exact, so adding and taking off leave nothing behind.
_SUM = "decimal(38,18)"

COUNTS = ("n", "scored", "negative", "above", "within", "below", "no_body", "no_keywords", "rated")
MEASURES = (*COUNTS, "sentiment_sum", "stars_sum")


def partial(t: DataFrame, sign: int = 1) -> DataFrame:
    """The partial of the rows of the enriched table ``t``; ``sign`` -1 takes them off."""
    score, stars = F.col("sentiment"), F.col("stars")
    kind = t.schema["created_at"].dataType
    flags = {
        "n": F.lit(True), "scored": score.isNotNull(), "negative": score < 0, "above": score > BAND,
        "within": score.between(-BAND, BAND), "below": score < -BAND,
        "no_body": F.col("body").isNull() | (F.trim("body") == ""), "no_keywords": F.col("keywords").isNull(),
        "rated": score.isNotNull() & stars.isNotNull(),
    }
    grouped = t.withColumn("hour", F.date_trunc("hour", "created_at").cast(kind)).groupBy(*KEYS).agg(
        *[(F.count_if(flag) * sign).alias(name) for name, flag in flags.items()],
        (F.coalesce(F.sum(score.cast(_SUM)), F.lit(0)) * sign).cast(_SUM).alias("sentiment_sum"),
        (F.coalesce(F.sum(F.when(score.isNotNull(), stars)), F.lit(0)) * sign).cast("long").alias("stars_sum"),
    )
    return grouped.withColumn("stars", F.col("stars").cast("long"))


def added(partials: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Partials of several sets as one; what has been taken off whole is gone."""
    sums = [F.sum(c).cast(_SUM if c == "sentiment_sum" else "long").alias(c) for c in MEASURES]
    return partials.groupBy(*by).agg(*sums).where(F.col("n") != 0)


def _share(part: Column, whole: Column, digits: int = 1) -> Column:
    return round_half_up(F.try_divide(part * 100, whole), digits)


def _mean(total: str, count: str, digits: int) -> Column:
    return round_half_up(F.try_divide(F.sum(total).cast("double"), F.sum(count)), digits)


def kpis(p: DataFrame) -> DataFrame:
    """Reviews that have a sentiment, its mean, and the shares that are fully enriched and negative."""
    full = F.when(F.col("enrichment_status") == _FULL, F.col("scored")).otherwise(0)
    return p.agg(
        F.coalesce(F.sum("scored"), F.lit(0)).alias("total"), _mean("sentiment_sum", "scored", 3).alias("avg_sentiment"),
        _share(F.sum(full), F.sum("scored")).alias("pct_fully_enriched"),
        _share(F.sum("negative"), F.sum("scored")).alias("pct_negative"),
    )


def stars_distribution(p: DataFrame) -> DataFrame:
    rows = p.where(F.col("stars").isNotNull()).groupBy("stars").agg(F.sum("n").alias("count"))
    return rows.where(F.col("count") > 0).orderBy("stars")


def sentiment_by_stars(p: DataFrame) -> DataFrame:
    rows = p.where(F.col("stars").isNotNull()).groupBy("stars").agg(
        _mean("sentiment_sum", "scored", 3).alias("avg_sentiment"), F.sum("scored").alias("scored"))
    return rows.where(F.col("scored") > 0).drop("scored").orderBy("stars")


def nps_summary(p: DataFrame) -> DataFrame:
    def rated(*stars: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("stars").isin(*stars), F.col("n"))), F.lit(0))

    return p.where(F.col("stars").isNotNull()).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), rated(1, 2).alias("detractors"), rated(3, 4).alias("passives"),
        rated(5).alias("promoters"),
    )


def nps_score(p: DataFrame) -> DataFrame:
    return reviews.nps_score_of(nps_summary(p))


def status_breakdown(p: DataFrame) -> DataFrame:
    by = ["stars", "enrichment_status"]
    rows = p.groupBy(*by).agg(F.sum("n").alias("count")).where(F.col("count") > 0)
    return rows.orderBy(*[F.asc_nulls_last(c) for c in by])


def enrichment_coverage(p: DataFrame) -> DataFrame:
    def of(status: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("enrichment_status") == status, F.col("n"))), F.lit(0))

    sums = {c: F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("n", "total"), ("no_body", "no_body"), ("no_keywords", "no_keywords"))}
    return p.agg(sums["n"], of("FAST_ONLY").alias("fast_only"), of(_FULL).alias("fully_enriched"), sums["no_body"], sums["no_keywords"])


def null_stats(p: DataFrame) -> DataFrame:
    return p.agg(
        F.coalesce(F.sum(F.col("n") - F.col("scored")), F.lit(0)).alias("no_sentiment"),
        F.coalesce(F.sum("no_keywords"), F.lit(0)).alias("no_keywords"), F.coalesce(F.sum("no_body"), F.lit(0)).alias("no_body"),
    )


def ingestion_timeline(p: DataFrame) -> DataFrame:
    rows = p.where(F.col("hour").isNotNull()).groupBy("hour").agg(F.sum("n").alias("count"))
    return rows.where(F.col("count") > 0).orderBy("hour")


def product_ranking(p: DataFrame, n: int = 5, best: bool = True, min_reviews: int = 3) -> DataFrame:
    """The best or worst products by mean sentiment, with their place in the list."""
    mean = F.col("avg_sentiment")
    order = [mean.desc() if best else mean.asc(), F.col("asin").asc()]
    top = (
        p.where(F.col("asin").isNotNull()).groupBy("asin").agg(
            _mean("stars_sum", "rated", 1).alias("avg_stars"), _mean("sentiment_sum", "scored", 3).alias("avg_sentiment"),
            F.sum("scored").alias("review_count"),
        )
        .where((F.col("review_count") >= min_reviews) & (F.col("review_count") > 0)).orderBy(*order).limit(n)
    )
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def stars_sentiment_breakdown(p: DataFrame) -> DataFrame:
    """Percent positive, neutral and negative per stars; the neutral band is that of the partials."""
    rows = p.where(F.col("stars").isNotNull()).groupBy("stars").agg(
        *[_share(F.sum(c), F.sum("scored")).alias(a) for c, a in (("above", "pct_positive"), ("within", "pct_neutral"), ("below", "pct_negative"))],
        F.sum("scored").alias("scored"),
    )
    return rows.where(F.col("scored") > 0).drop("scored").orderBy(F.desc("stars"))

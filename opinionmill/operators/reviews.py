"""Questions over the enriched reviews table.

``t`` needs only the columns a function names; Spark prunes the rest from the scan. Groups are few
(stars, status, hour) or pre-aggregated by each task (product), so a hot group costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opinionmill.functions.rounding import percent, round_half_up, round_to_tenth
from opinionmill.functions.text import contains_ignoring_case, strip

# Fixed values.
ALL_STARS = (1, 2, 3, 4, 5)
FILTERABLE_STATUS = ("FAST_ONLY", "FULLY_ENRICHED")
NPS_BANDS = ((50, "Excellent"), (30, "Good"), (0, "Needs improvement"))
NPS_LOWEST_BAND = "Critical"


def _blank(text) -> Column:
    return text.isNull() | (F.trim(text) == "")


def kpis(t: DataFrame) -> DataFrame:
    return t.where(F.col("sentiment").isNotNull()).agg(
        F.count("*").alias("total"),
        round_half_up(F.avg("sentiment"), 3).alias("avg_sentiment"),
        percent(F.col("enrichment_status") == "FULLY_ENRICHED").alias("pct_fully_enriched"),
        percent(F.col("sentiment") < 0).alias("pct_negative"),
    )


def stars_distribution(t: DataFrame) -> DataFrame:
    return t.where(F.col("stars").isNotNull()).groupBy("stars").agg(F.count("*").alias("count")).orderBy("stars")


def sentiment_by_stars(t: DataFrame) -> DataFrame:
    return (
        t.dropna(subset=["stars", "sentiment"]).groupBy("stars")
        .agg(round_half_up(F.avg("sentiment"), 3).alias("avg_sentiment"))
        .orderBy("stars")
    )


def _most_polarised(t: DataFrame, n: int) -> DataFrame:
    return t.orderBy(F.abs("sentiment").desc(), "id").limit(n)


def top_reviews(t: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` reviews with the strongest sentiment of either sign."""
    return _most_polarised(t.dropna(subset=["sentiment", "body"]), n).select(
        "asin", "stars", F.round("sentiment", 3).alias("sentiment"), "enrichment_status",
        F.left("body", F.lit(250)).alias("body_preview"),
    )


def reviews_filtered(
    t: DataFrame, stars: list[int] | None = None, lo: float = -1.0, hi: float = 1.0,
    asin: str = "", status: str = "All", n: int = 500,
) -> DataFrame:
    """The filter panel. No stars means all five, a blank product or an unknown status no filter."""
    kept = F.col("stars").isin(*(stars or ALL_STARS)) & F.col("sentiment").between(lo, hi)
    if asin.strip():
        kept = kept & contains_ignoring_case(F.col("asin"), asin)
    if status in FILTERABLE_STATUS:
        kept = kept & (F.col("enrichment_status") == status)
    return _most_polarised(t.where(kept), n).select(
        "asin", "stars", F.round("sentiment", 3).alias("sentiment"), "keywords", "enrichment_status",
        F.left("body", F.lit(300)).alias("body_preview"),
    )


def keywords_raw(t: DataFrame) -> DataFrame:
    return t.where(
        F.col("keywords").isNotNull() & (F.col("enrichment_status") == "FULLY_ENRICHED")
    ).select("keywords")


def keyword_frequency(t: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent keywords; equal counts go by keyword."""
    words = keywords_raw(t).select(
        F.explode(F.transform("keywords", lambda word: F.lower(strip(word)))).alias("keyword")
    )
    return (
        words.where(F.col("keyword") != "").groupBy("keyword").agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "keyword").limit(n)
    )


def sentiment_scatter(t: DataFrame) -> DataFrame:
    return t.dropna(subset=["sentiment", "stars"]).select(
        "stars", F.round("sentiment", 3).alias("sentiment"), "enrichment_status"
    )


def enrichment_coverage(t: DataFrame) -> DataFrame:
    return t.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("enrichment_status") == "FAST_ONLY").alias("fast_only"),
        F.count_if(F.col("enrichment_status") == "FULLY_ENRICHED").alias("fully_enriched"),
        F.count_if(_blank(F.col("body"))).alias("no_body"),
        F.count_if(F.col("keywords").isNull()).alias("no_keywords"),
    )


def null_stats(t: DataFrame) -> DataFrame:
    return t.agg(
        F.count_if(F.col("sentiment").isNull()).alias("no_sentiment"),
        F.count_if(F.col("keywords").isNull()).alias("no_keywords"),
        F.count_if(_blank(F.col("body"))).alias("no_body"),
    )


def nps_summary(t: DataFrame) -> DataFrame:
    stars = F.col("stars")
    return t.where(stars.isNotNull()).agg(
        F.count("*").alias("total"),
        F.count_if(stars.isin(1, 2)).alias("detractors"),
        F.count_if(stars.isin(3, 4)).alias("passives"),
        F.count_if(stars == 5).alias("promoters"),
    )


def nps_score(t: DataFrame) -> DataFrame:
    """Net promoter score and its band; 0 where there are no reviews."""
    return nps_score_of(nps_summary(t))


def nps_score_of(summary: DataFrame) -> DataFrame:
    """The score of the counts of :func:`nps_summary`.

    Shares and score are rounded as floats are, by their exact binary value with ties to even.
    """
    def share(column: str) -> Column:
        return F.coalesce(F.try_divide(F.col(column), F.col("total")) * 100, F.lit(0.0))

    score = F.bround(F.col("pct_promoters") - F.col("pct_detractors"), 0).cast("bigint")
    band = F.lit(NPS_LOWEST_BAND)
    for floor, label in reversed(NPS_BANDS):
        band = F.when(F.col("nps") >= floor, label).otherwise(band)
    return (
        summary
        .withColumns({f"pct_{c}": round_to_tenth(share(c)) for c in ("promoters", "detractors")})
        .withColumn("nps", score).withColumn("band", band)
    )


def status_breakdown(t: DataFrame) -> DataFrame:
    """Reviews per stars and status; null groups are kept."""
    by = ["stars", "enrichment_status"]
    return t.groupBy(*by).agg(F.count("*").alias("count")).orderBy(*[F.asc_nulls_last(c) for c in by])


def ingestion_timeline(t: DataFrame) -> DataFrame:
    kind = t.schema["created_at"].dataType
    return (
        t.where(F.col("created_at").isNotNull())
        .groupBy(F.date_trunc("hour", "created_at").cast(kind).alias("hour"))
        .agg(F.count("*").alias("count")).orderBy("hour")
    )


def product_ranking(t: DataFrame, n: int = 5, best: bool = True, min_reviews: int = 3) -> DataFrame:
    """The best or worst products by mean sentiment, with their place in the list."""
    mean = F.col("avg_sentiment")
    order = [mean.desc() if best else mean.asc(), F.col("asin").asc()]
    top = (
        t.dropna(subset=["sentiment", "asin"]).groupBy("asin")
        .agg(
            round_half_up(F.avg("stars"), 1).alias("avg_stars"),
            round_half_up(F.avg("sentiment"), 3).alias("avg_sentiment"),
            F.count("*").alias("review_count"),
        )
        .where(F.col("review_count") >= min_reviews)
        .orderBy(*order).limit(n)
    )
    # The window sees no more than the n rows kept.
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def stars_sentiment_breakdown(t: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Percent positive, neutral and negative per stars; the neutral band is closed."""
    band = round(float(threshold), 4)
    score = F.col("sentiment")
    return (
        t.dropna(subset=["stars", "sentiment"]).groupBy("stars")
        .agg(
            percent(score > band).alias("pct_positive"),
            percent(score.between(-band, band)).alias("pct_neutral"),
            percent(score < -band).alias("pct_negative"),
        )
        .orderBy(F.desc("stars"))
    )

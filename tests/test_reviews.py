import pytest
from pyspark.sql import functions as F

from opinionmill.functions.rounding import round_half_up, round_to_tenth
from opinionmill.operators import reviews as rev

SCHEMA = (
    "id string, asin string, body string, stars int, sentiment double, keywords array<string>, "
    "enrichment_status string, created_at timestamp"
)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def blank(spark):
    return spark.createDataFrame([(None,) * 8] * 3, SCHEMA)


def facts(spark, rows):
    names = SCHEMA.replace(" timestamp", " string").split(", ")
    keys = [n.split()[0] for n in names]
    return spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], ", ".join(names))


def test_headline_of_nothing(empty, blank):
    for t in (empty, blank):
        assert rev.kpis(t).first().asDict() == {
            "total": 0, "avg_sentiment": None, "pct_fully_enriched": None, "pct_negative": None}
        assert rev.nps_score(t).first().asDict() == {
            "total": 0, "detractors": 0, "passives": 0, "promoters": 0, "pct_promoters": 0.0, "pct_detractors": 0.0,
            "nps": 0, "band": "Needs improvement"}
    assert rev.enrichment_coverage(empty).first() == (0, 0, 0, 0, 0)
    assert rev.enrichment_coverage(blank).first() == (3, 0, 0, 3, 3)
    assert rev.null_stats(blank).first() == (3, 3, 3)


@pytest.mark.parametrize("question", [
    rev.stars_distribution, rev.sentiment_by_stars, rev.top_reviews, rev.reviews_filtered, rev.keywords_raw,
    rev.keyword_frequency, rev.sentiment_scatter, rev.ingestion_timeline, rev.product_ranking, rev.stars_sentiment_breakdown,
])
def test_no_rows_from_nothing(empty, blank, question):
    assert question(empty).count() == 0 and question(blank).count() == 0


def test_null_groups_are_kept(blank):
    assert [tuple(r) for r in rev.status_breakdown(blank).collect()] == [(None, None, 3)]


def test_ranking_needs_three_reviews_and_breaks_ties(spark):
    t = facts(spark, [{"asin": a, "stars": 4, "sentiment": s} for a, n, s in
                      [("B", 3, 0.5), ("A", 3, 0.5), ("C", 2, 0.9), ("D", 4, -0.5)] for _ in range(n)])
    best = rev.product_ranking(t, 2).orderBy("place").collect()
    assert [(r.place, r.asin, r.avg_stars, r.review_count) for r in best] == [(1, "A", 4.0, 3), (2, "B", 4.0, 3)]
    assert rev.product_ranking(t, 1, best=False).first().asin == "D"


def test_filters(spark):
    t = facts(spark, [
        {"id": "1", "asin": "B00x", "stars": 5, "sentiment": 0.5, "enrichment_status": "FAILED"},
        {"id": "2", "asin": "b00Y", "stars": 1, "sentiment": -1.0, "enrichment_status": "FAST_ONLY"},
        {"id": "3", "asin": "C1", "stars": None, "sentiment": 0.1, "enrichment_status": "FAST_ONLY"},
        {"id": "4", "asin": "C1", "stars": 2, "sentiment": None, "enrichment_status": "FULLY_ENRICHED"},
    ])

    def asins(**filters):
        return sorted(r.asin for r in rev.reviews_filtered(t, **filters).collect())

    assert asins() == ["B00x", "b00Y"]
    assert asins(stars=[]) == asins(asin="   ") == asins(status="FAILED") == asins(status="x' OR 1=1") == asins()
    assert asins(status="FAST_ONLY") == ["b00Y"]
    assert asins(asin="b00") == asins(asin="B0_") == asins()
    assert asins(stars=[1], hi=-1.0) == ["b00Y"] and asins(lo=0.5) == ["B00x"]
    assert asins(n=1) == ["b00Y"]


def test_previews_are_cut(spark):
    t = facts(spark, [{"id": "1", "body": "x" * 1000, "stars": 5, "sentiment": 0.5}])
    assert len(rev.top_reviews(t).first().body_preview) == 250
    assert len(rev.reviews_filtered(t).first().body_preview) == 300


def test_keyword_frequency(spark):
    t = facts(spark, [
        {"keywords": ["Price ", "size", ""], "enrichment_status": "FULLY_ENRICHED"},
        {"keywords": ["price", "zip"], "enrichment_status": "FULLY_ENRICHED"},
        {"keywords": ["hidden"], "enrichment_status": "FAILED"},
        {"keywords": [], "enrichment_status": "FULLY_ENRICHED"},
    ])
    assert [tuple(r) for r in rev.keyword_frequency(t, 2).collect()] == [("price", 2), ("size", 1)]


def test_neutral_band_is_closed(spark):
    t = facts(spark, [{"stars": 3, "sentiment": s} for s in (0.1, -0.1, 0.2, -0.2)])
    assert rev.stars_sentiment_breakdown(t).first().asDict() == {
        "stars": 3, "pct_positive": 25.0, "pct_neutral": 50.0, "pct_negative": 25.0}
    assert rev.stars_sentiment_breakdown(t, 0.0).first().pct_neutral == 0.0


def test_rounding_ignores_float_noise(spark):
    df = spark.createDataFrame([(0.0025, 0.003), (0.0024999999999999996, 0.003), (-1.0055, -1.006), (0.0024, 0.002)],
                               "x double, y double")
    assert all(r[0] == r[1] for r in df.select(round_half_up(F.col("x"), 3), "y").collect())
    nan = spark.createDataFrame([(float("nan"),)], "x double")
    assert nan.select(round_half_up(F.col("x"), 3)).first()[0] is None


def test_shares_round_as_floats_do(spark):
    totals = [1, 3, 7, 8, 40, 200, 800, 2000, 4994, 10000]
    pairs = [(n, total, round(n / total * 100, 1)) for total in totals for n in range(0, total + 1, max(1, total // 400))]
    df = spark.createDataFrame(pairs, "n int, total int, expected double")
    share = F.col("n") / F.col("total") * 100
    assert df.where(round_to_tenth(share) != F.col("expected")).count() == 0


@pytest.mark.parametrize("stars, nps, band", [
    ([5, 5, 5, 1], 50, "Excellent"), ([5, 5, 3, 3, 3], 40, "Good"), ([5, 1], 0, "Needs improvement"), ([1, 2, 5], -33, "Critical"),
    ([5, 3, 3, 3, 3, 3, 3, 3], 12, "Needs improvement"),
])
def test_nps(spark, stars, nps, band):
    row = rev.nps_score(facts(spark, [{"stars": s} for s in stars])).first()
    assert (row.nps, row.band) == (nps, band)

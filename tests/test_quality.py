import hashlib

import pytest
from pyspark.sql import functions as F

from opinionmill.operators import quality
from opinionmill.plans.dashboard import source_checks

REVIEW = "ID string, ASIN string, STARS int, BODY string, VERIFIED_PURCHASE string, FOUND_HELPFUL int"


def results(df, rules):
    return {r.rule: (r.observed, r.passed) for r in quality.run_checks(df, rules).collect()}


def good_reviews(spark, n=100):
    return spark.range(n).select(
        F.col("id").cast("string").alias("ID"), F.lit("A").alias("ASIN"), (F.col("id") % 5 + 1).cast("int").alias("STARS"),
        F.lit("text").alias("BODY"), F.lit("TRUE").alias("VERIFIED_PURCHASE"), F.lit(1).alias("FOUND_HELPFUL"))


def test_good_reviews_pass(spark):
    assert all(ok for _, ok in results(good_reviews(spark), quality.review_rules(100, 10)).values())


def test_bad_reviews_fail(spark):
    bad = spark.createDataFrame([
        ("1", "A", 1, "x", None, None), ("1", "A", 7, " \t", None, None), ("1", None, 2, None, None, None),
        (None, "A", None, "y", None, None), (None, "A", 0, "z", None, None),
    ], REVIEW)
    got = results(bad, quality.review_rules())
    assert got == {
        "required_columns": (0, True), "unique_names": (0, True), "has_rows": (5, True), "row_count": (5, False),
        "id_not_null": (2, False), "asin_not_null": (1, False), "stars_in_range": (2, False),
        "stars_all_values": (2, False), "id_unique": (2, False), "body_filled": (pytest.approx(0.6), False),
    }


def test_missing_columns_fail_their_rules(spark):
    got = results(spark.createDataFrame([("1", "A")], "ID string, ASIN string"), quality.review_rules(1, 0))
    assert got["required_columns"] == (4, False) and got["stars_in_range"] == (None, False)
    assert got["body_filled"] == (None, False) and got["id_unique"] == (0, True)
    assert results(spark.createDataFrame([("1",)], "STARS string"), quality.review_rules())["id_unique"] == (None, False)


def test_no_rows(spark):
    got = results(spark.createDataFrame([], REVIEW), quality.review_rules())
    assert got["has_rows"] == (0, False) and got["id_unique"] == (0, True) and got["stars_all_values"][1] is False


def test_absent_source(spark, tmp_path):
    def load():
        return spark.read.parquet(str(tmp_path / "none"))

    for rules in (quality.review_rules(), quality.product_rules()):
        got = {r.rule: r.passed for r in source_checks(spark, load, rules).collect()}
        assert not got["has_rows"] and not got["required_columns"]
    assert all(r.passed for r in source_checks(spark, lambda: good_reviews(spark), quality.review_rules(100, 10)).collect())


def test_repeated_names(spark):
    df = spark.createDataFrame([(1, 2)], "asin int, other int").toDF("asin", "ASIN")
    assert results(df, [quality.unique_names()]) == {"unique_names": (1, False)}


def test_products(spark):
    products = spark.createDataFrame([("A", 1.0), ("A", 2.0), (None, None)], "ASIN string, PRICE double")
    assert results(products, quality.product_rules()) == {
        "required_columns": (0, True), "unique_names": (0, True), "has_rows": (3, True), "asin_not_null": (1, False),
        "asin_unique": (1, False), "no_empty_rows": (1, False)}


def test_thresholds(spark):
    got = {r.rule: r.threshold for r in quality.run_checks(good_reviews(spark), quality.review_rules()).collect()}
    assert got["row_count"] == "4990..5000" and got["id_unique"] == "= 0" and got["body_filled"] == ">= 0.8"


@pytest.mark.parametrize("k", [1, 7, 100, 5000])
def test_sample_is_the_first_k_by_hash(spark, k):
    # Half of the rows have five stars, each review comes twice, some lack stars.
    df = spark.range(3000).select(
        (F.col("id") / 2).cast("int").cast("string").alias("id"),
        F.when(F.col("id") % 4 < 2, 5).when(F.col("id") % 100 == 98, None).otherwise((F.col("id") / 2).cast("int") % 4 + 1).alias("stars"))
    got = [tuple(r) for r in quality.stratified_sample(df, k).collect()]
    first = {}
    for r in df.collect():
        if r.stars is not None:
            first[r.id] = min(first.get(r.id, 9), r.stars)
    expected = set()
    for stars in range(1, 6):
        ids = sorted((i for i, s in first.items() if s == stars), key=lambda i: hashlib.md5(i.encode()).hexdigest())
        expected |= {(i, stars) for i in ids[:k]}
    assert len(got) == len(set(got)) and set(got) == expected

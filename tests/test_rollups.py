"""Partial sums beside the questions over all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from opinionmill.operators import reviews, rollups
from opinionmill.plans.rollups import Rollup
from opinionmill.plans.store import ReviewStore
from opinionmill.schemas import OUTCOMES, REVIEWS_FAST

QUESTIONS = (
    "kpis", "stars_distribution", "sentiment_by_stars", "nps_summary", "nps_score", "status_breakdown", "enrichment_coverage",
    "null_stats", "ingestion_timeline", "product_ranking", "stars_sentiment_breakdown",
)


@pytest.fixture
def store(spark, tmp_path):
    return ReviewStore(spark, str(tmp_path / "store"))


def facts(spark, rng, ids):
    rows = [(
        str(i), rng.choice([None, "A", "B", "C", "HOT", "HOT"]), rng.choice(["good", " ", None]), rng.choice([None, 1, 2, 3, 4, 5]), None,
        rng.choice([None, 0.1, -0.1, 0.25, -1.0, 1 / 3]), "FAST_ONLY", dt.datetime(2024, 1, 1, rng.randrange(4), 30),
    ) for i in ids]
    return spark.createDataFrame(rows, REVIEWS_FAST)


def outcomes(spark, rng, ids):
    rows = [(str(i), rng.choice([["a"], [], None]), rng.randint(1, 3), "late", dt.datetime(2024, 2, rng.randint(1, 9))) for i in ids]
    return spark.createDataFrame(rows, OUTCOMES)


def check(store):
    table, rows = Rollup(store).table(), store.enriched().withColumn("stars", F.col("stars").cast("long"))
    for name in QUESTIONS:
        got, wanted = getattr(rollups, name)(table), getattr(reviews, name)(rows)
        assert got.columns == wanted.columns, name
        assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect())), name


def test_partials_follow_loads_outcomes_and_compactions(spark, store):
    rng = random.Random(5)
    store.write_facts(facts(spark, rng, range(80)), "a")
    check(store)
    store.write_outcomes(outcomes(spark, rng, range(0, 40)), "one")
    store.write_facts(facts(spark, rng, range(80, 120)), "b")
    check(store)
    # Later outcomes of reviews that have some, and of reviews that the store doesn't have.
    store.write_outcomes(outcomes(spark, rng, range(30, 90, 2)).union(outcomes(spark, rng, [900])), "two")
    check(store)
    store.compact()
    check(store)
    store.write_facts(facts(spark, rng, range(120, 130)), "c")
    store.write_outcomes(outcomes(spark, rng, range(60, 130, 3)), "three")
    check(store)
    assert store.compact() == 2 and store.clean() > 0
    check(store)


def test_a_question_reads_partials_only(spark, store, plan):
    rng = random.Random(6)
    store.write_facts(facts(spark, rng, range(50)), "a")
    store.write_outcomes(outcomes(spark, rng, range(9)), "a")
    first = sorted(Rollup(store).refresh())
    table = Rollup(store).table()
    assert all("/rollup/" in f for f in table.inputFiles()) and "/facts/" not in plan(rollups.kpis(table))
    # A load adds its own partial; what is there is not computed again.
    store.write_facts(facts(spark, rng, range(50, 60)), "b")
    second = Rollup(store).refresh()
    assert [p for p in first if "facts-a" in p][0] in second and len([p for p in second if "/facts-" in p]) == 2


def test_an_empty_store(store):
    rows = {r["total"] for r in rollups.kpis(Rollup(store).table()).collect()}
    assert rows == {0}


def test_cleaning_up_keeps_the_rows(spark, store):
    rng = random.Random(7)
    assert store.clean() == 0
    for load in "ab":
        store.write_facts(facts(spark, rng, range(20 if load == "a" else 0, 40 if load == "a" else 20)), load)
        store.write_outcomes(outcomes(spark, rng, range(10, 30)), load)
        store.compact()
    before = sorted(map(str, store.enriched().collect()))
    assert store.clean() == 5 and sorted(map(str, store.enriched().collect())) == before
    assert store.state().facts == [] and store.compact() == 3 and sorted(map(str, store.enriched().collect())) == before

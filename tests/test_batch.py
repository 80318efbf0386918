import pytest

from opinionmill.operators.enrich import complete_with_retry, sentiment_score
from opinionmill.operators.monitoring import stage_durations
from opinionmill.operators.quality import product_rules, review_rules, run_checks
from opinionmill.operators.reviews import kpis
from opinionmill.plans import batch
from opinionmill.plans.store import ReviewStore
from opinionmill.schemas import COST_SNAPSHOT
from opinionmill.sources.tables import read_path

REVIEWS = """id,asin,body,stars,verified_purchase,found_helpful
R1,A,"good lamp, good light",5,True,3
R2,A,bad lamp,1,False,
R3,B,fine chair,3,False,0
R4,B,nan,4,True,9
R1,A,good copy,5,True,3
R5,C,"good, bad",NA,true,12
"""
PRODUCTS = "asin,title,rating\nA,Lamp,4.5\nB,Chair,\nC,null,3\n"


def test_files_to_enriched_table(spark, tmp_path):
    root, log = str(tmp_path / "lake"), str(tmp_path / "logs")
    for name, text in (("products", PRODUCTS), ("reviews", REVIEWS)):
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    files = str(tmp_path / "products.csv"), str(tmp_path / "reviews.csv")
    assert batch.stage_files(spark, *files, root) == (3, 5)
    assert batch.stage_files(spark, *files, root) == (0, 0)
    assert batch.stage_to_raw(spark, root) == {"products": 3, "reviews": 5}
    assert batch.stage_to_raw(spark, root) == {"products": 0, "reviews": 0}

    staged = read_path(spark, f"{root}/source/products")
    assert {(r.ASIN, r.TITLE, r.RATING) for r in staged.collect()} == {("A", "Lamp", 5), ("B", "Chair", None), ("C", None, 3)}
    assert run_checks(staged, product_rules()).where("not passed").count() == 0
    failed = run_checks(read_path(spark, f"{root}/source/reviews"), review_rules(5, 0)).where("not passed")
    assert {r.rule for r in failed.collect()} == {"stars_all_values"}

    words = spark.createDataFrame([("good", 1.0), ("bad", -1.0)], "word string, weight double")
    store, raw = ReviewStore(spark, str(tmp_path / "store")), read_path(spark, f"{root}/raw/reviews")
    for _ in range(2):
        batch.fast_tier(store, raw, lambda df: sentiment_score(df, words), "initial")
        assert {(r.id, r.sentiment) for r in store.facts().collect()} == {
            ("R1", 1.0), ("R2", -1.0), ("R3", 0.0), ("R5", 0.0)}
    summary = batch.keyword_tier(store, raw, "run1", n=2, log_path=log)
    assert summary.first().asDict() == {"processed": 2, "failed": 0, "retried": 0, "total": 2}
    again = batch.keyword_tier(store, raw, "run2", n=10, log_path=log)
    assert again.first().total == 1
    done = {r.id: r.enrichment_status for r in store.enriched().collect()}
    assert done == {"R1": "FULLY_ENRICHED", "R2": "FULLY_ENRICHED", "R3": "FAST_ONLY", "R5": "FULLY_ENRICHED"}
    assert kpis(store.enriched()).first().asDict() == {
        "total": 4, "avg_sentiment": 0.0, "pct_fully_enriched": 75.0, "pct_negative": 25.0}
    assert spark.read.parquet(log).count() == 4
    assert stage_durations(spark.read.parquet(log)).first().stage == "AI Enrichment"


def test_failures_are_logged(spark, tmp_path):
    def extract(chosen):
        return chosen.selectExpr("id", "cast(null as array<string>) keywords", "3 attempts", "'down' error", "localtimestamp() finished_at")

    words = spark.createDataFrame([("good", 1.0)], "word string, weight double")
    raw = spark.createDataFrame([("1", "A", "good", "5", "TRUE", "9")],
                                "id string, asin string, body string, stars string, verified_purchase string, found_helpful string")
    store = ReviewStore(spark, str(tmp_path / "store"))
    batch.fast_tier(store, raw, lambda df: sentiment_score(df, words), "a")
    batch.keyword_tier(store, raw, "k", extract=extract, log_path=str(tmp_path / "logs"))
    levels = sorted(r.level for r in spark.read.parquet(str(tmp_path / "logs")).collect())
    assert levels == ["INFO", "INFO", "WARN"]
    row = store.enriched().first()
    assert (row.enrichment_status, row.retry_count, row.error_message) == ("FAILED", 3, "down") and row.failed_at is not None


def one_review(spark):
    return spark.createDataFrame([("1", "A", "good", "5", "TRUE", "9")],
                                 "id string, asin string, body string, stars string, verified_purchase string, found_helpful string")


def test_paid_calls_are_made_once(spark, tmp_path):
    """A log that cannot be written fails no run, and a run that is repeated asks no more."""
    calls = spark.sparkContext.accumulator(0)

    def client():
        def complete(prompt):
            calls.add(1)
            raise RuntimeError("down")
        return complete

    def extract(chosen):
        return complete_with_retry(chosen, client, sleep=lambda s: None)

    words = spark.createDataFrame([("good", 1.0)], "word string, weight double")
    log, store = tmp_path / "log", ReviewStore(spark, str(tmp_path / "store"))
    log.write_text("not a folder")
    batch.fast_tier(store, one_review(spark), lambda df: sentiment_score(df, words), "a", log_path=str(log))
    for _ in range(2):
        summary = batch.keyword_tier(store, one_review(spark), "k", extract=extract, log_path=str(log))
        assert summary.first().asDict() == {"processed": 0, "failed": 1, "retried": 0, "total": 1}
        assert calls.value == 3


def test_stages_are_logged_with_their_errors(spark, tmp_path):
    log = str(tmp_path / "logs")
    (tmp_path / "products.csv").write_text(PRODUCTS, encoding="utf-8")
    (tmp_path / "reviews.csv").write_text(REVIEWS + "R6,A,too,1,True,0,many\nR7,B\n", encoding="utf-8")
    files = str(tmp_path / "products.csv"), str(tmp_path / "reviews.csv")
    with pytest.raises(Exception, match="too many values"):
        batch.stage_files(spark, *files, str(tmp_path / "strict"), log_path=log)
    lines = {r.message.split(":")[0]: r.level for r in spark.read.parquet(log).collect()}
    assert lines["seed load of reviews failed"] == "ERROR" and lines["seed load of products completed added=3"] == "INFO"
    # Six good lines, one of them a copy, one short line; the long one is set aside and counted.
    root = str(tmp_path / "lake")
    assert batch.stage_files(spark, *files, root, "quarantine", log) == (3, 6)
    aside = spark.read.parquet(f"{root}/quarantine/reviews")
    assert [r.line for r in aside.collect()] == ["R6,A,too,1,True,0,many"]
    messages = {r.message for r in spark.read.parquet(log).collect()}
    assert "seed load of reviews completed quarantined=1 added=6" in messages
    assert {r.stage for r in stage_durations(spark.read.parquet(log)).collect()} == {"Seed Load"}


def test_daily_snapshot_leaves_no_empty_file(spark, tmp_path):
    path = tmp_path / "snapshots"
    row = spark.sql("select date'2024-01-01' snapshot_date, 1d wh_credits, 1d ai_credits, 1d storage_gb, timestamp_ntz'2024-01-01 00:00:00' created_at")
    batch.daily_snapshot(spark, row, str(path))
    files = sorted(path.glob("*.parquet"))
    for _ in range(2):
        batch.daily_snapshot(spark, row, str(path))
    assert sorted(path.glob("*.parquet")) == files and spark.read.parquet(str(path)).schema == COST_SNAPSHOT

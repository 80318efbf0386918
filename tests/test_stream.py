import pytest
from pyspark.sql import functions as F

from opinionmill.operators.enrich import enrich_fast, sentiment_score
from opinionmill.operators.ingest import ingest_raw
from opinionmill.plans.batch import keyword_tier
from opinionmill.plans.store import ReviewStore
from opinionmill.schemas import OUTCOMES, REVIEWS_STAGING, all_strings
from opinionmill.sources.tables import read_path
from opinionmill.streaming.incremental import enrich_stream, enrich_stream_keyed, keyword_step, raw_stream

AS_OF = "2024-01-31 00:00:00"


@pytest.fixture
def job(spark, tmp_path):
    return Job(spark, tmp_path)


class Job:
    def __init__(self, spark, tmp_path):
        self.spark = spark
        self.raw, self.checkpoint = str(tmp_path / "raw"), str(tmp_path / "checkpoint")
        self.store = ReviewStore(spark, str(tmp_path / "store"))
        self.words = spark.createDataFrame([("good", 1.0), ("bad", -1.0)], "word string, weight double")

    def score(self, df):
        return sentiment_score(df, self.words)

    def arrive(self, *reviews):
        rows = [(i, "A", body, 5, "TRUE", 9) for i, body in reviews]
        df = self.spark.createDataFrame(rows, "ID string, ASIN string, BODY string, STARS int, VERIFIED_PURCHASE string, FOUND_HELPFUL int")
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in REVIEWS_STAGING if f.name not in df.columns]
        return ingest_raw(self.spark, df.select("*", *missing).select(REVIEWS_STAGING.names), self.raw)

    def run(self, then=None, **options):
        stream = raw_stream(self.spark, self.raw, **options)
        query = enrich_stream(stream, self.store, self.checkpoint, self.score, AS_OF, then)
        query.awaitTermination()
        return len([p for p in query.recentProgress if p["numInputRows"] > 0])

    def rows(self):
        return sorted((r.id, r.sentiment) for r in self.store.facts().collect())


def test_only_new_reviews_are_scored(job):
    job.arrive(("1", "good"), ("2", "bad"), ("3", " "))
    assert job.run() == 1 and job.rows() == [("1", 1.0), ("2", -1.0)]
    # Nothing new: no batch runs.
    assert job.run() == 0
    # A second version of a review is a new raw row, but the review is known.
    assert job.arrive(("1", "bad"), ("4", "good bad")) == 2
    assert job.run() == 1 and job.rows() == [("1", 1.0), ("2", -1.0), ("4", 0.0)]


def test_backlog_is_worked_off_in_batches(job):
    for i in range(3):
        job.arrive((str(i), "good"))
    assert job.run(files_per_batch=1) == 3
    assert [i for i, _ in job.rows()] == ["0", "1", "2"]


def test_batch_that_runs_again_gives_the_same_rows(job):
    job.arrive(("1", "good"))
    calls = []

    def fail_once(store, batch, load_id):
        calls.append(load_id)
        if len(calls) == 1:
            raise RuntimeError("lost after the write")

    with pytest.raises(Exception, match="lost after the write"):
        job.run(fail_once)
    assert job.rows() == [("1", 1.0)]
    job.arrive(("2", "bad"))
    job.run(fail_once)
    assert job.rows() == [("1", 1.0), ("2", -1.0)] and calls[0] == calls[1]


def test_new_checkpoint_keeps_what_is_there(job, tmp_path):
    job.arrive(("1", "good"))
    job.run()
    job.checkpoint = str(tmp_path / "checkpoint2")
    job.arrive(("2", "bad"))
    job.run()
    assert job.rows() == [("1", 1.0), ("2", -1.0)]


def test_keywords_follow_scores(job):
    job.arrive(("1", "good lamp"), ("2", "bad chair"))

    def keywords(store, batch, load_id):
        keyword_tier(store, read_path(job.spark, job.raw, all_strings(REVIEWS_STAGING)), load_id, n=1)

    job.run(keywords)
    # Equal votes and stars: the smaller id is chosen.
    states = {r.id: (r.enrichment_status, r.keywords) for r in job.store.enriched().collect()}
    assert states == {"1": ("FULLY_ENRICHED", ["good", "lamp"]), "2": ("FAST_ONLY", None)}
    job.arrive(("3", "good"))
    job.run(keywords)
    states = {r.id: r.enrichment_status for r in job.store.enriched().collect()}
    assert states == {"1": "FULLY_ENRICHED", "2": "FULLY_ENRICHED", "3": "FAST_ONLY"}


def test_stream_equals_batch(job):
    job.arrive(*[(str(i), f"good {'bad ' * (i % 4)}") for i in range(40)])
    job.arrive(*[(str(i), "bad") for i in range(30, 60)])
    job.run(files_per_batch=1)
    assert len(job.rows()) == 60 == job.store.facts().select("id").distinct().count()


def test_store_starts_empty(job):
    assert job.store.facts().count() == 0 and job.store.outcomes().schema == OUTCOMES
    assert job.store.enriched().count() == 0


def test_store_repeats_a_load_without_doubling(job, spark):
    reviews = spark.createDataFrame([("1", "A", "good", 5, "h")], "id string, asin string, body string, stars int, row_hash string")
    for _ in range(2):
        job.store.write_facts(enrich_fast(reviews, job.store.facts(without="first"), job.score, AS_OF), "first")
    assert job.rows() == [("1", 1.0)]


def test_compacted_base_answers_without_a_join(job, plan):
    job.arrive(("1", "good lamp"), ("2", "bad"))
    job.run(keyword_step(lambda: read_path(job.spark, job.raw, all_strings(REVIEWS_STAGING)), n=1))
    before = sorted(map(str, job.store.enriched().collect()))
    assert job.store.compact(partitions=2) == 1
    assert sorted(map(str, job.store.enriched().collect())) == before and job.rows() == [("1", 1.0), ("2", -1.0)]
    text = plan(job.store.enriched().where("asin = 'A' and stars = 5").select("id"))
    assert "Join" not in text and "EqualTo(asin,A)" in text and "body" not in text.split("ReadSchema")[1]
    # Younger loads and outcomes meet the base, and the next version holds them too.
    job.arrive(("3", "bad chair"))
    job.run(keyword_step(lambda: read_path(job.spark, job.raw, all_strings(REVIEWS_STAGING)), n=5))
    after = sorted(map(str, job.store.enriched().collect()))
    assert {r.id: r.enrichment_status for r in job.store.enriched().collect()} == {i: "FULLY_ENRICHED" for i in "123"}
    assert job.store.compact() == 2 and sorted(map(str, job.store.enriched().collect())) == after
    assert "Join" not in plan(job.store.enriched()) and job.store.outcomes().count() == 3


def test_child_step_draws_from_earlier_batches_too(job):
    job.arrive(("1", "good lamp"), ("2", "bad chair"))
    step = keyword_step(lambda: read_path(job.spark, job.raw, all_strings(REVIEWS_STAGING)), n=1)
    job.run(step)
    job.arrive(("3", " "))
    job.run(step)
    assert {r.id: r.enrichment_status for r in job.store.enriched().collect()} == {"1": "FULLY_ENRICHED", "2": "FULLY_ENRICHED"}


class KeyedJob(Job):
    def run(self, then=None, **options):
        query = enrich_stream_keyed(raw_stream(self.spark, self.raw, **options), self.store, self.checkpoint, self.score, AS_OF, then)
        query.awaitTermination()
        return len([p for p in query.recentProgress if p["numInputRows"] > 0])


@pytest.fixture
def keyed(spark, tmp_path):
    return KeyedJob(spark, tmp_path)


def test_state_tells_known_reviews(keyed, spark):
    known = spark.createDataFrame([("1", "A", "good", 5, "h")], "id string, asin string, body string, stars int, row_hash string")
    keyed.store.write_facts(enrich_fast(known, keyed.store.facts(), keyed.score, AS_OF), "seed")
    keyed.arrive(("1", "bad"), ("2", "bad"), ("3", " "))
    keyed.run()
    assert keyed.rows() == [("1", 1.0), ("2", -1.0)]
    # Another version of known reviews, a blank one that now has a text, and a new one.
    keyed.arrive(("1", "bad bad"), ("2", "good"), ("3", "good"), ("4", "bad good"))
    keyed.run()
    assert keyed.rows() == [("1", 1.0), ("2", -1.0), ("3", 1.0), ("4", 0.0)]
    keyed.run()
    assert len(keyed.rows()) == 4


def test_later_batches_do_not_look_into_the_store(keyed, monkeypatch):
    for i in range(4):
        keyed.arrive((str(i), "good"), ("same", "bad"))
    asked = []
    facts = ReviewStore.facts
    monkeypatch.setattr(ReviewStore, "facts", lambda self, without=None: asked.append(without) or facts(self, without))
    assert keyed.run(files_per_batch=1) >= 4
    # The snapshot before the first batch, and that batch.
    assert len(asked) == 2
    keyed.arrive(("9", "bad"), ("0", "bad"))
    keyed.run()
    assert len(asked) == 2
    monkeypatch.undo()
    assert keyed.rows() == [*[(str(i), 1.0) for i in range(4)], ("9", -1.0), ("same", -1.0)]


def test_a_keyed_batch_that_runs_again_gives_the_same_rows(keyed):
    keyed.arrive(("1", "good"), ("2", "bad"))
    calls = []

    def fail_once(store, batch, load_id):
        calls.append(load_id)
        if len(calls) in (1, 3):
            raise RuntimeError("lost after the write")

    for more in ((), (("2", "good"), ("3", "bad"))):
        if more:
            keyed.arrive(*more)
        with pytest.raises(Exception, match="lost after the write"):
            keyed.run(fail_once)
        keyed.run(fail_once)
    assert keyed.rows() == [("1", 1.0), ("2", -1.0), ("3", -1.0)] and calls[0] == calls[1]

import math
import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from opinionmill.functions.text import KEYWORD_INSTRUCTION, keyword_prompt
from opinionmill.operators import enrich
from opinionmill.plans import joins

LEXICON = [("good", 1.0), ("great", 2.0), ("bad", -1.0)]
TEXTS = [
    ("1", "Good, good; BAD!"), ("2", "great bad"), ("3", "nothing here"), ("4", "goodness badly"), ("5", ""), ("6", None),
    ("7", "bad-bad bad"),
]
SCORES = {"1": 1 / 3, "2": 1 / 3, "3": 0.0, "4": 0.0, "5": 0.0, "6": 0.0, "7": -1.0}


@pytest.fixture
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "word string, weight double")


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(TEXTS, "id string, body string")


@pytest.mark.parametrize("max_rows", [10, 0])
def test_sentiment(texts, lexicon, max_rows):
    got = enrich.sentiment_score(texts, lexicon, max_rows=max_rows)
    assert got.columns == ["id", "body", "sentiment"]
    assert {r.id: r.sentiment for r in got.collect()} == pytest.approx(SCORES)


@pytest.mark.parametrize("max_rows", [10, 0])
def test_sentiment_needs_no_ids(spark, max_rows):
    texts = spark.createDataFrame([("1", "good good"), ("1", "bad"), (None, "good"), (None, "good bad"), ("2", None)], "id string, body string")
    words = spark.createDataFrame([("good", 0.3), ("bad", -0.1), ("good", 0.4)], "word string, weight double")
    got = sorted((r.id or "", r.body or "", r.sentiment) for r in enrich.sentiment_score(texts, words, max_rows=max_rows).collect())
    assert got == [("", "good", 1.0), ("", "good bad", 0.75), ("1", "bad", -1.0), ("1", "good good", 1.0), ("2", "", 0.0)]


def test_five_thousand_weights(spark):
    words = spark.range(5000).selectExpr("concat('w', translate(cast(id as string), '0123456789', 'abcdefghij')) word", "(id - 2500) / 7 weight")
    texts = spark.createDataFrame([("1", "wa wb wjj, wejjj"), ("2", "wejjj")], "id string, body string")
    small, large = (enrich.sentiment_score(texts, words, max_rows=n) for n in (100_000, 0))
    assert small.orderBy("id").collect() == large.orderBy("id").collect() and small.where("id = '2'").first().sentiment == 1.0


def test_a_long_word_list_stays_out_of_the_plan(spark, plan, texts):
    words = spark.range(300_000).selectExpr("concat('w', translate(cast(id as string), '0123456789', 'abcdefghij')) word", "id / 7 weight")
    words = words.union(spark.createDataFrame(LEXICON, "word string, weight double"))
    scored = enrich.sentiment_score(texts, words)
    assert {r.id: r.sentiment for r in scored.collect()} == pytest.approx(SCORES)
    assert len(plan(scored)) < 100_000


def test_wide_words_are_no_constant(spark, plan):
    words = spark.range(2000).select(F.repeat(F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(1000)).alias("word"), F.lit(1.0).alias("weight"))
    texts = spark.createDataFrame([("1", "b" * 1000), ("2", "b"), ("3", None)], "id string, body string")
    scored = enrich.sentiment_score(texts, words)
    assert {r.id: r.sentiment for r in scored.collect()} == {"1": 1.0, "2": 0.0, "3": 0.0}
    assert len(plan(scored)) < 100_000


def test_sentiment_without_words(spark, texts):
    empty = spark.createDataFrame([], "word string, weight double")
    assert {r.sentiment for r in enrich.sentiment_score(texts, empty).collect()} == {0.0}


def test_plugged_in_scorer(texts):
    def length(text: pd.Series) -> pd.Series:
        return text.str.len() / 100.0

    got = enrich.scored_with(length)(texts.where("id = '2'")).first()
    assert got.sentiment == pytest.approx(0.09)


def review(id, body="text", asin="A", stars=3, verified=False, helpful=0, row_hash=None):
    return (id, asin, body, stars, verified, helpful, row_hash or f"h{id}")


REVIEW = "id string, asin string, body string, stars int, verified_purchase boolean, found_helpful bigint, row_hash string"


def test_fast_tier(spark, lexicon):
    reviews = spark.createDataFrame([
        review("1", "good"), review("1", "good"), review("2", "bad"), review("3", "  "), review("4", None),
        review(None, "good"), review("5", "great"),
    ], REVIEW)
    known = spark.createDataFrame([("5",), ("9",)], "id string")
    out = enrich.enrich_fast(reviews, known, lambda df: enrich.sentiment_score(df, lexicon), "2024-01-31 00:00:00")
    assert {(r.id, r.sentiment, r.enrichment_status, r.row_hash) for r in out.collect()} == {
        ("1", 1.0, "FAST_ONLY", "h1"), ("2", -1.0, "FAST_ONLY", "h2")}
    assert out.columns == ["id", "asin", "body", "stars", "row_hash", "sentiment", "enrichment_status", "created_at"]


ENRICHED = "id string, asin string, body string, stars int, keywords array<string>, enrichment_status string"


def fact(id, stars=3, body="text", keywords=None, status="FAST_ONLY"):
    return (id, "A", body, stars, keywords, status)


def test_strategic_batch(spark):
    facts = spark.createDataFrame([
        fact("verified"), fact("helpful"), fact("one", 1), fact("five", 5), fact("dull"), fact("done", 5, keywords=["x"]),
        fact("failed", 5, status="FAILED"), fact("full", 5, status="FULLY_ENRICHED"), fact("no status", 5, status=None),
        fact("blank", 5, body="  "), fact("none", 5, body=None), fact("unknown", 5), fact("ten", 3),
    ], ENRICHED)
    votes = {"verified": (True, None), "helpful": (False, 6), "one": (None, None), "five": (False, 5),
             "dull": (False, 5), "ten": (None, 10)}
    names = [r.id for r in facts.collect() if r.id != "unknown"]
    reviews = spark.createDataFrame(
        [review(n, verified=votes.get(n, (True, 9))[0], helpful=votes.get(n, (True, 9))[1]) for n in names]
        # A second copy: the best of both counts.
        + [review("ten", verified=False, helpful=9)], REVIEW)
    assert {r.id for r in enrich.strategic_pool(facts, reviews).collect()} == {"verified", "helpful", "one", "five", "ten"}
    # Ten votes, then six, then five; without votes one star comes first.
    best = enrich.strategic_batch(facts, reviews, 4)
    assert {r.id for r in best.collect()} == {"ten", "helpful", "five", "one"}
    assert best.columns == ["id", "stars", "found_helpful", "body"]


@pytest.mark.parametrize("n", [1, 60, 150, 199, 200, 500])
def test_a_large_batch_passes_no_single_task(spark, monkeypatch, n):
    """The same rows as by a sort and a limit, with null votes, null stars and ties."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(enrich, "BROADCAST_ROWS", 0)
    facts = spark.range(200).selectExpr(
        "cast(id as string) id", "'A' asin", "'text' body", "cast(if(id % 7 = 0, null, 1) as int) stars", "cast(null as array<string>) keywords",
        "'FAST_ONLY' enrichment_status").repartition(4)
    reviews = facts.selectExpr("id", "true verified_purchase", "if(id % 11 = 0, null, cast(id % 5 - 2 as bigint)) found_helpful")
    pool = enrich.strategic_pool(facts, reviews).collect()
    order = lambda r: (r.found_helpful is None, -(r.found_helpful or 0), r.stars is None, r.stars or 0, r.id)
    batch = enrich.strategic_batch(facts, reviews, n)
    assert sorted(r.id for r in batch.collect()) == sorted(r.id for r in sorted(pool, key=order)[:n])
    limits = re.findall(r"TakeOrderedAndProject\(limit=(\d+)", batch._jdf.queryExecution().executedPlan().toString())
    assert all(int(x) < 150 for x in limits)


def test_prompt(spark):
    assert spark.range(1).select(keyword_prompt(F.lit("Nice"))).first()[0] == KEYWORD_INSTRUCTION + "Nice"


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([
        ("1", "apple apple pear the"), ("2", "plum pear the"), ("3", "the the the"), ("4", "12 345"), ("5", ""),
    ], "id string, body string")
    got = {r.id: r.keywords for r in enrich.keywords_tfidf(df, k=2).collect()}
    assert got == {"1": ["apple", "pear"], "2": ["plum", "pear"], "3": ["the"], "4": [], "5": []}


@pytest.mark.parametrize("hot_words", [0, 1, 5])
def test_tfidf_whatever_is_broadcast(spark, monkeypatch, hot_words):
    df = spark.range(60).select(
        F.col("id").cast("string").alias("id"),
        F.concat_ws(" ", F.lit("all"), *[
            F.when(F.col("id") % n == 0, F.lit("w" * n)) for n in range(2, 9)]).alias("body"))
    expected = {r.id: r.keywords for r in enrich.keywords_tfidf(df, k=3).collect()}
    monkeypatch.setattr(enrich, "HOT_WORDS", hot_words)
    assert {r.id: r.keywords for r in enrich.keywords_tfidf(df, k=3).collect()} == expected
    assert expected["7"] == ["wwwwwww", "all"]


def plain_tfidf(rows, k):
    """Keywords by plain counting; rows that share an id are one text."""
    counts = {}
    for name, body in rows:
        counts.setdefault(name, Counter()).update(re.findall("[a-z]+", (body or "").lower()))
    having = Counter(w for c in counts.values() for w in c)
    order = lambda c: sorted(c, key=lambda w: (-round(c[w] * math.log(len(rows) / having[w]), 9), w))
    return {name: order(c)[:k] for name, c in counts.items()}


@pytest.mark.parametrize("share, hot_words, shared", [(0.0005, 100_000, False), (0.05, 100_000, True), (0.05, 7, True), (0.3, 0, False)])
def test_tfidf_beside_plain_counting(spark, monkeypatch, plan, share, hot_words, shared):
    """Rare words, frequent ones and ties; repeated and null ids; no count of each word of a row shuffles."""
    monkeypatch.setattr(enrich, "HOT_WORD_SHARE", share)
    monkeypatch.setattr(enrich, "HOT_WORDS", hot_words)
    rng = random.Random(hot_words)
    word = lambda: "abcdefgh"[rng.randrange(8)] * rng.randrange(1, 1 + int(rng.paretovariate(0.7)) % 12 + 1)
    rows = [(str(i), " ".join(word() for _ in range(rng.choice([0, 1, 3, 30, 80])))) for i in range(150)]
    if shared:
        rows += [("3", "a bb ccc"), ("3", None), (None, "a a dd"), (None, "eee"), ("149", rows[149][1])]
    df = spark.createDataFrame(rows, "id string, body string").repartition(3)
    made = enrich.keywords_tfidf(df, k=3)
    got = made.collect()
    assert {r.id: r.keywords for r in got} == plain_tfidf(rows, 3) and len(got) == len({r[0] for r in rows})
    if not shared:
        assert not re.search(r"hashpartitioning\(id#\d+, word", plan(made))


def flaky(failures):
    """A client that fails ``failures`` times for each prompt, then answers."""
    def make():
        seen = {}

        def complete(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if seen[prompt] <= failures:
                raise RuntimeError(f"down {seen[prompt]}")
            return " price, , size ,"
        return complete
    return make


@pytest.mark.parametrize("failures, keywords, attempts, error, waits", [
    (0, ["price", "size"], 1, None, []),
    (1, ["price", "size"], 2, "down 1", [1]),
    (2, ["price", "size"], 3, "down 2", [1, 2]),
    (3, None, 3, "down 3", [1, 2]),
])
def test_retry(spark, tmp_path, failures, keywords, attempts, error, waits):
    path = tmp_path / "waits"
    path.touch()
    batch = spark.createDataFrame([("1", "text")], "id string, body string")

    def wait(seconds, path=str(path)):
        with open(path, "a") as f:
            f.write(f"{seconds}\n")

    out = enrich.complete_with_retry(batch, flaky(failures), sleep=wait, calls=1).collect()
    assert [(r.keywords, r.attempts, r.error) for r in out] == [(keywords, attempts, error)]
    assert [float(x) for x in path.read_text().split()] == waits


def test_empty_answer_is_a_success(spark):
    batch = spark.createDataFrame([("1", "text")], "id string, body string")
    out = enrich.complete_with_retry(batch, lambda: lambda prompt: None)
    assert [(r.keywords, r.attempts) for r in out.collect()] == [([], 1)]
    assert enrich.run_summary(out).first() == (1, 0, 0, 1)


def test_calls_are_spread(spark):
    batch = spark.createDataFrame([(str(i), "text") for i in range(50)], "id string, body string").coalesce(1)
    out = enrich.complete_with_retry(batch, flaky(0), calls=6)
    assert out.rdd.getNumPartitions() == 6 and out.count() == 50


OUTCOME = "id string, keywords array<string>, attempts int, error string, finished_at timestamp_ntz"


def test_outcomes_set_states(spark):
    facts = spark.createDataFrame(
        [fact("won"), fact("lost"), fact("long"), fact("mute"), fact("idle"), fact("dead", status="FAILED")], ENRICHED)
    at = pd.Timestamp("2024-01-31").to_pydatetime()
    outcomes = spark.createDataFrame([
        ("won", ["a"], 2, "down", at), ("lost", None, 3, "down", at), ("long", None, 3, "x" * 3000, at),
        ("mute", None, 3, "", at), ("dead", ["b"], 1, None, at), ("stranger", ["c"], 1, None, at),
    ], OUTCOME)
    got = {r.id: r for r in enrich.apply_outcomes(facts, outcomes).collect()}
    assert len(got) == 6
    state = {k: (r.enrichment_status, r.retry_count, r.keywords, r.error_message, r.failed_at) for k, r in got.items()}
    assert state["won"] == ("FULLY_ENRICHED", 1, ["a"], None, None)
    assert state["lost"] == ("FAILED", 3, None, "down", at)
    assert state["long"][3] == "x" * 1990
    assert state["mute"][3] == "unknown error"
    assert state["idle"] == ("FAST_ONLY", 0, None, None, None)
    # Failed is final.
    assert state["dead"] == ("FAILED", 0, None, None, None)


def test_repeated_outcomes_count_once(spark):
    facts = spark.createDataFrame([fact("a")], ENRICHED)
    outcomes = spark.createDataFrame(
        [("a", None, 3, "down", None), ("a", ["x"], 2, None, None), ("a", ["x"], 2, None, None)], OUTCOME)
    got = enrich.apply_outcomes(facts, outcomes).collect()
    assert [(r.enrichment_status, r.keywords) for r in got] == [("FULLY_ENRICHED", ["x"])]


def test_summary_and_alert(spark):
    outcomes = spark.createDataFrame(
        [("a", ["x"], 1, None, None), ("b", [], 3, "e", None), ("c", None, 3, "e", None)], OUTCOME)
    summary = enrich.run_summary(outcomes)
    assert summary.first().asDict() == {"processed": 2, "failed": 1, "retried": 1, "total": 3}
    alert = enrich.failure_alert(summary).collect()
    assert [r.level for r in alert] == ["WARN"] and "failed=1 of total=3" in alert[0].message
    assert enrich.failure_alert(enrich.run_summary(outcomes.where("keywords is not null"))).count() == 0


def test_update_from_candidates(spark):
    facts = spark.createDataFrame([fact("a"), fact("b", keywords=["old"]), fact("c")], ENRICHED)
    news = spark.createDataFrame([("a", ["new"]), ("b", None)], "id string, keywords array<string>")
    got = {r.id: r.keywords for r in enrich.update_from_candidates(facts, news, ["keywords"]).collect()}
    assert got == {"a": ["new"], "b": ["old"], "c": None}


def test_products_with_equal_column_names(spark):
    reviews = spark.createDataFrame([("1", "A", "t1"), ("2", "Z", "t2"), ("3", None, "t3")], "id string, asin string, title string")
    products = spark.createDataFrame([("A", "Lamp", 9.5)], "asin string, title string, price double")
    out = enrich.reviews_with_products(reviews, products)
    assert out.columns == ["id", "asin", "title", "product_title", "price"]
    assert {(r.id, r.product_title) for r in out.collect()} == {("1", "Lamp"), ("2", None), ("3", None)}

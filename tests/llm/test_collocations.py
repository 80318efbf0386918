"""Collocations beside plain counting, and their SQL twin."""

import random

import plain
import pytest
from compare import database, differences
from opinionmill.llm import collocations, queries


def check(df, rows, support):
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())
    assert got == plain.collocations(rows, support, collocations.TOP)


def test_op13(spark, sf):
    assert differences(database(sf), queries.op13_collocations(spark, sf), queries.oracle_sql()["op13_collocations"]) is None


@pytest.mark.parametrize("support, held", [(30, 1 << 19), (3, 40)])
def test_phrases_of_odd_texts(spark, made, odd, empty, monkeypatch, support, held):
    """Null languages, copies, ties, overlaps, phrases inside of others, and tasks that send their counts early."""
    monkeypatch.setattr(collocations, "SUPPORT", support)
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "AT_ONCE", 2_000)
    rng = random.Random(support)
    words = ["the", "The", "of", "a", "é", "x y", "ÀB", "b", "1", "\x1c"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\x0b", "  ", "; "]) for _ in range(rng.randint(0, 60)))
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([text(), text(), None, "", "a a a a a a"]), rng.choice(["en", "de", None, "und"])) for _ in range(150)]
    rows += [(7, "new york city hall. new york city", "en")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    check(collocations.collocations(docs), [(lang, t) for _, t, lang in rows], support)
    check(collocations.collocations(odd), [(r.lang, r.text) for r in odd.collect()], support)
    assert collocations.collocations(empty).count() == 0


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BITS", 64)
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(80)), "en") for i in range(60)]
    check(collocations.collocations(spark.createDataFrame(rows, "doc_id long, text string, lang string")), [(g, t) for _, t, g in rows], 30)


def test_every_locally_frequent_phrase_is_frequent_somewhere(spark, made):
    """The supports of the shards of a language add up to no less than the whole support."""
    rows = [(i, "one two three four five six", "en") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tokens = docs.transform(collocations.dealt).mapInArrow(collocations.in_tokens, collocations.TOKENS_TYPE)
    words = collocations.count_words(tokens)
    needs = [r.need for r in collocations.supports(words).collect()]
    assert sum(n - 1 for n in needs) < collocations.SUPPORT <= sum(needs) and len(needs) <= collocations.SHARDS


def test_a_word_of_all_shards_is_counted_as_one_row_and_added_up_once_a_side(spark):
    """Neither a row for each shard of a word, nor a second sum in the tasks that have just added up."""
    rows = [(i, "one two, two", "en") for i in range(50)]
    tokens = spark.createDataFrame(rows, "doc_id long, text string, lang string").transform(collocations.dealt).mapInArrow(
        collocations.in_tokens, collocations.TOKENS_TYPE)
    words = collocations.count_words(tokens)
    assert sorted((r.word, sum(r[c] for c in collocations.IN_SHARDS)) for r in words.collect()) == [("one", 50), ("two", 100)]
    plan = words._jdf.queryExecution().sparkPlan().toString().splitlines()
    below = plan[next(i for i, line in enumerate(plan) if "MapInArrow" in line) - 1]
    assert "Aggregate" not in below, plan


def test_a_phrase_is_counted_where_its_pairs_are_in_the_filter():
    """The filter holds each part of two words of a frequent phrase, so no frequent phrase is lost."""
    batches = collocations.in_tokens(iter([collocations.pa.record_batch({"text": ["a b c d. b c d a", "a b, c"], "lang": ["en"] * 2, "shard": [0, 0]})]))
    row = next(collocations.each_slice(batches))
    assert sorted(row["words"].to_pylist()) == ["a", "b", "c", "d"]
    full = collocations.np.full(collocations.BITS // 64, (1 << 64) - 1, collocations.np.uint64)
    found = {r["name"].removeprefix("en:"): r["n"] for r in collocations.candidates_of(row, full).to_pylist()}
    assert found == {"a b": 2, "b c": 2, "c d": 2, "d a": 1, "a b c": 1, "b c d": 2, "c d a": 1, "a b c d": 1, "b c d a": 1}
    assert not collocations.candidates_of(row, collocations.np.zeros_like(full)).num_rows

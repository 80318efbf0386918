"""Sentiment for every new review, keywords for a chosen subset."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from opinionmill.functions.text import keyword_prompt, non_blank, tokens
from opinionmill.functions.times import AsOf, moment
from opinionmill.operators.ingest import add_missing_columns
from opinionmill.plans.joins import BROADCAST_ROWS, first_per_key, first_rows, fits_broadcast, local_copy, lookup_join, without_known

# Fixed values.
FAST_ONLY, FULLY_ENRICHED, FAILED = "FAST_ONLY", "FULLY_ENRICHED", "FAILED"
BATCH_ROWS = 500
MAX_ATTEMPTS = 3
ERROR_CHARS = 1990
KEYWORDS_PER_REVIEW = 5
HELPFUL_ABOVE = 5
EXTREME_STARS = (1, 5)

# Clients that are asked at the same time, where the caller names no number that its rate limit allows.
CALLS = 16

# Weights of words are added up at this many places, exactly.
WEIGHT_PLACES = 9
# Words of the list that one lookup passes over, on average.
WORDS_PER_SLOT = 2
# Bytes of the longest list that becomes a constant of the plan, which the driver holds and writes out several times.
CONSTANT_BYTES = 4 * 1024 * 1024
# Bits of the filter that a list beyond a broadcast is told by, a power of two: 2 MB.
FILTER_BITS = 1 << 24

# Words whose count is broadcast, as digests of 16 bytes: those in at least this share of the texts,
# as far as they are no more than this.
HOT_WORD_SHARE = 0.0005
HOT_WORDS = 100_000
# Weights that are nearer than this may be equal once they are rounded.
WEIGHT_MARGIN = 1e-8

Completer = Callable[[str], str | None]


# Fast tier


def enrichable(reviews: DataFrame) -> DataFrame:
    return reviews.where(non_blank(F.col("body")))


def unprocessed(reviews: DataFrame, enriched: DataFrame) -> DataFrame:
    """Reviews whose id the fact table lacks, each id once."""
    return without_known(reviews.where(F.col("id").isNotNull()), enriched, "id")


def sentiment_score(df: DataFrame, lexicon: DataFrame, text: str = "body", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add ``sentiment``: (positive - negative) / (positive + negative) word weight, 0 without a hit.

    ``lexicon`` has words and their weights, below zero for a negative word; the weights of a word
    that it holds several times are added. A list that fits a broadcast scores each row where it
    lies. A larger one is joined to the words of the texts. Both add whole numbers, so they agree
    whatever the ids are and however often a text occurs.
    """
    places = F.col("weight").cast(f"decimal(28,{WEIGHT_PLACES})") * 10**WEIGHT_PLACES
    weights = lexicon.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum(places).cast("bigint").alias("weight"))
    small = local_copy(weights, max_rows, CONSTANT_BYTES)
    return _scored_in_row(df, small, text) if small is not None else _scored_by_join(df, weights, text)


def _ratio(positive: Column, negative: Column) -> Column:
    return F.coalesce(F.try_divide((positive - negative).cast("double"), (positive + negative).cast("double")), F.lit(0.0))


def _scored_in_row(df: DataFrame, weights: DataFrame, text: str) -> DataFrame:
    """The word list as one constant, an array of small maps, which a hash of the word chooses from."""
    slots = max(1, weights.count() // WORDS_PER_SLOT)
    slot = lambda word: F.pmod(F.xxhash64(word), F.lit(slots)).cast("int")
    maps: list[dict[str, int]] = [{} for _ in range(slots)]
    for row in weights.select("word", "weight", slot(F.col("word")).alias("slot")).collect():
        maps[row["slot"]][row["word"]] = row["weight"]
    # Spark folds the constant once, when it plans the query.
    by_slot = F.from_json(F.lit(json.dumps(maps)), "array<map<string, bigint>>")
    found = F.transform(tokens(F.col(text)), lambda t: F.try_element_at(F.get(by_slot, slot(t)), t))
    none = F.lit(0).cast("bigint")
    score = F.aggregate(
        F.filter(found, lambda w: w.isNotNull()), F.struct(none.alias("up"), none.alias("down")),
        lambda sums, w: F.struct(
            (sums["up"] + F.greatest(w, none)).alias("up"), (sums["down"] + F.greatest(-w, none)).alias("down")
        ),
        lambda sums: _ratio(sums["up"], sums["down"]),
    )
    return df.withColumn("sentiment", F.coalesce(score, F.lit(0.0)))


def _listed_words(words: DataFrame, bits: int = FILTER_BITS) -> Callable[[Column], Column]:
    """For an array of hashes of words, whether each word may be among ``words``: a Bloom filter with two bits a word.

    It has ``bits`` bits at most, fewer for a short list, whatever the list holds; a full one keeps every word. Tasks
    get it as a broadcast value: a constant of the plan is written out in the driver with each text of the plan.
    """
    bits = max(64, min(bits, 1 << (16 * max(1, words.count())).bit_length()))
    spread = F.xxhash64("word")
    places = [spread.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(spread, 32).bitwiseAND(F.lit(bits - 1))]
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    found = words.select(F.explode(F.array(*places)).alias("place")).groupBy(
        F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    held = np.zeros(bits // 64, np.uint64)
    held[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    shared = words.sparkSession.sparkContext.broadcast(held)

    @F.arrow_udf("array<boolean>")
    def may_be(hashes: pa.Array) -> pa.Array:
        spread = hashes.flatten().to_numpy().view(np.uint64)
        kept = np.ones(len(spread), bool)
        for place in (spread, spread >> np.uint64(32)):
            place = place & np.uint64(bits - 1)
            kept &= (shared.value[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        # Null arrays have no values, and come back empty.
        ends = np.cumsum(hashes.value_lengths().fill_null(0).to_numpy())
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(kept))

    return may_be


def _scored_by_join(df: DataFrame, weights: DataFrame, text: str) -> DataFrame:
    """Only words that may be listed leave their row, with their counts, under a digest of their text.

    Equal texts have equal scores; a task sends one row for a word of them.
    """
    digest = F.unhex(F.md5(F.col(text)))
    may_be = _listed_words(weights.select("word"))
    words = df.select(digest.alias("_text"), tokens(F.col(text)).alias("_words")).withColumn(
        "_listed", may_be(F.transform("_words", lambda w: F.xxhash64(w))))
    words = words.select("_text", F.filter("_words", lambda w, i: F.get("_listed", i)).alias("_words"))
    # A text counts once, whatever the number of its rows.
    texts = words.where(F.size("_words") > 0).groupBy("_text").agg(F.first("_words").alias("_words"))
    counts = texts.select("_text", F.explode("_words").alias("word")).groupBy("_text", "word").agg(F.count("*").alias("n"))
    met = lookup_join(counts, weights, "word", ["_text"], max_rows=0).where(F.col("weight").isNotNull())
    total = F.col("weight") * F.col("n")
    none = F.lit(0).cast("bigint")
    scores = met.groupBy("_text").agg(
        _ratio(F.sum(F.greatest(total, none)), F.sum(F.greatest(-total, none))).alias("sentiment")
    )
    joined = df.withColumn("_text", digest).join(scores, "_text", "left")
    return joined.select(*df.columns, F.coalesce("sentiment", F.lit(0.0)).alias("sentiment"))


def scored_with(scorer: Callable[[pd.Series], pd.Series]) -> Callable[[DataFrame], DataFrame]:
    """A scoring step from a function over batches of text, for use in place of the word list."""
    udf = F.pandas_udf(scorer, "double")

    def step(df: DataFrame) -> DataFrame:
        return df.withColumn("sentiment", udf(F.col("body")))

    return step


def enrich_fast(
    reviews: DataFrame, enriched: DataFrame, score: Callable[[DataFrame], DataFrame], as_of: AsOf = None,
) -> DataFrame:
    """Rows to append to the fact table: new reviews with text, scored and stamped."""
    return scored_facts(unprocessed(enrichable(reviews), enriched), score, as_of)


def scored_facts(fresh: DataFrame, score: Callable[[DataFrame], DataFrame], as_of: AsOf = None) -> DataFrame:
    """Rows of the fact table for reviews that are known to be new and to have text."""
    row_hash = F.col("row_hash") if "row_hash" in fresh.columns else F.lit(None).cast("string")
    stamp = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    return score(fresh).select(
        "id", "asin", "body", F.col("stars").cast("bigint").alias("stars"), row_hash.alias("row_hash"),
        "sentiment", F.lit(FAST_ONLY).alias("enrichment_status"), stamp.alias("created_at"),
    )


# Keyword tier: choosing the batch


def _pending(enriched: DataFrame) -> DataFrame:
    pending = enriched.where(
        F.col("keywords").isNull() & ~F.col("enrichment_status").isin(FULLY_ENRICHED, FAILED)
    )
    return enrichable(pending) if "body" in pending.columns else pending


def strategic_pool(enriched: DataFrame, reviews: DataFrame) -> DataFrame:
    """Pending reviews worth a costly call: id, stars, found_helpful.

    Texts stay behind: only ids, stars and votes are shuffled. A table without its texts is taken
    to hold reviews with text only. A review that occurs several times counts as verified if any
    copy is, with the votes of its best copy.
    """
    votes = reviews.groupBy("id").agg(
        F.max("verified_purchase").alias("verified"), F.max("found_helpful").alias("found_helpful")
    )
    worth = (
        F.col("verified") | (F.col("found_helpful") > HELPFUL_ABOVE) | F.col("stars").isin(*EXTREME_STARS)
    )
    return _pending(enriched).select("id", "stars").join(votes, "id").where(worth).select("id", "stars", "found_helpful")


def strategic_batch(
    enriched: DataFrame, reviews: DataFrame, n: int = BATCH_ROWS, texts: DataFrame | None = None,
) -> DataFrame:
    """The ``n`` most helpful of the pool with their text: id, stars, found_helpful, body.

    ``texts`` names the table to read the texts from, if not ``enriched``.
    """
    pool = strategic_pool(enriched, reviews)
    votes = F.col("found_helpful")
    # Whole numbers in descending order; the negative of the least one would overflow.
    falling = F.bitwise_not(votes) if dict(pool.dtypes)["found_helpful"] in ("int", "bigint") else F.negative(votes)
    key = [votes.isNull().alias("no_votes"), falling.alias("votes"), F.col("stars").isNull().alias("no_stars"), "stars", "id"]
    chosen = first_rows(pool, n, F.struct(*key))
    texts = (enriched if texts is None else texts).select("id", "body")
    # n bounds the chosen side.
    return texts.join(F.broadcast(chosen) if n <= BROADCAST_ROWS else chosen, "id").select(
        "id", "stars", "found_helpful", "body"
    )


# Keyword tier: extraction


def keywords_tfidf(df: DataFrame, id: str = "id", text: str = "body", k: int = KEYWORDS_PER_REVIEW) -> DataFrame:
    """The ``k`` words of each text with the largest count x ln(texts / texts with the word).

    ``id`` names a text; rows that share one, or have none, are one text. Weights are compared at nine
    places, equal ones by word. Texts without a word get an empty list. Texts stay where they lie, and the
    words of a row are counted there. Frequent words meet their count by broadcast. Of a row only words
    go on that may be among its best ``k``; the rare ones of them shuffle to meet their count.
    """
    counts = df.groupBy(id).agg(F.count("*").alias("n"))
    shared = local_copy(counts.where((F.col("n") > 1) | F.col(id).isNull()).select(F.col(id).alias("_shared")))
    if shared is None:
        alone, several = None, df
    elif shared.isEmpty():
        alone, several = df, None
    else:
        same = F.col(id).eqNullSafe(F.col("_shared"))
        alone, several = (df.join(F.broadcast(shared), same, how) for how in ("left_anti", "left_semi"))
    total = df.select(F.count("*").alias("n"))
    each = several and several.select(F.col(id), F.explode_outer(tokens(F.col(text))).alias("word"))
    words = each and each.groupBy(id, "word").agg(F.count("*").alias("tf")).withColumn("digest", F.unhex(F.md5("word")))
    parts = [words.select("word")] if words else []
    if alone:
        parts.append(alone.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("word")))
    texts_with = reduce(DataFrame.union, parts).where(F.col("word").isNotNull()).groupBy("word").agg(F.count("*").alias("having"))
    common = texts_with.where(F.col("having") >= total.scalar() * HOT_WORD_SHARE)
    hot = local_copy(common.orderBy(F.desc("having"), "word").limit(HOT_WORDS).select(F.unhex(F.md5("word")).alias("digest"), "having"), HOT_WORDS)

    weight = F.round(F.col("tf") * F.ln(total.scalar() / F.col("having")), 9)
    place = F.row_number().over(Window.partitionBy(id).orderBy(F.desc_nulls_last("weight"), "word"))
    found = []
    if words:
        met = words.join(F.broadcast(hot), "digest", "left").drop("digest")
        # A row without a word stands for a text without any.
        best = met.where(F.col("having").isNotNull() | F.col("word").isNull()).withColumn("weight", weight).withColumn("place", place)
        found += [best.where(F.col("place") <= k).select(id, "word", "tf", "having"), met.where(F.col("having").isNull() & F.col("word").isNotNull())]
    if alone:
        likely = alone.select(id, F.explode_outer(_likely_words(hot, df.count(), k)(tokens(F.col(text)))).alias("w"))
        found.append(likely.select(id, "w.word", "w.tf", "w.having"))
    each = reduce(DataFrame.union, (f.select(id, "word", "tf", "having") for f in found))
    # A rare word's key is the word; the other rows meet nothing and are spread.
    rare = F.col("having").isNull() & F.col("word").isNotNull()
    key = F.when(rare, F.col("word")).otherwise(F.concat(F.lit("+"), F.xxhash64(id).cast("string")))
    met = each.withColumn("_key", key).join(texts_with.toDF("_key", "_rare"), "_key", "left").withColumn("having", F.coalesce("having", "_rare"))
    ranked = met.select(id, "word", weight.alias("weight")).withColumn("place", place).where(F.col("place") <= k)
    chosen = F.collect_list(F.when(F.col("word").isNotNull(), F.struct("place", "word")))
    return ranked.groupBy(id).agg(F.transform(F.array_sort(chosen), lambda r: r["word"]).alias("keywords"))


def _likely_words(hot: DataFrame, texts: int, k: int) -> Callable[[Column], Column]:
    """From the words of a text, those that may be among its ``k`` of most weight: (word, tf, having), the last null for a rare one.

    Between no text but its own and the most texts that a word outside of ``hot`` can have, a rare word has bounds of its
    weight. A word goes if ``k`` others surely have more, or ``k`` have as much by the same counts and come before it.
    """
    held = hot.toArrow()
    having = held.column("having").to_numpy()
    most = having.min() if len(having) == HOT_WORDS > 0 else texts if not HOT_WORDS else max(1.0, texts * HOT_WORD_SHARE)
    bounds = np.log(texts / most), np.log(max(texts, 1))
    shared = hot.sparkSession.sparkContext.broadcast((held.column("digest").combine_chunks().cast(pa.binary()), having))

    def likely(words: pa.Array) -> pa.Array:
        digests, having = shared.value
        encoded = words.flatten().dictionary_encode()
        kinds, codes = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        digest = pa.array([hashlib.md5(w.encode()).digest() for w in kinds.to_pylist()], pa.binary())
        at = pc.index_in(digest, value_set=digests).fill_null(-1).to_numpy()
        # One row for each text and word, by text.
        owner = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy())
        pair, tf = np.unique(owner * len(kinds) + codes, return_counts=True)
        owner, code = np.divmod(pair, max(1, len(kinds)))
        rare = at[code] < 0
        texts_with = np.where(rare, 0, np.r_[having, 0][at[code]])
        exact = np.log(texts / np.maximum(texts_with, 1))
        low, high = (tf * np.where(rare, bound, exact) for bound in bounds)
        # The k-th largest lower bound of each text; a text of fewer words keeps all.
        order = np.lexsort((-low, owner))
        first = np.searchsorted(owner, np.arange(len(words)))
        count = np.diff(np.r_[first, len(owner)])
        least = np.full(len(words), -np.inf)
        full = np.flatnonzero(count >= k)
        least[full] = low[order[first[full] + k - 1]]
        keep = high >= least[owner] - WEIGHT_MARGIN
        # Words of equal counts have equal weights, so their order decides.
        by_word = np.empty(len(kinds), np.int64)
        by_word[pc.sort_indices(kinds).to_numpy()] = np.arange(len(kinds))
        order = np.lexsort((by_word[code], texts_with, tf, owner))
        group = np.r_[True, np.any([np.diff(x[order]) != 0 for x in (owner, tf, texts_with)], axis=0)][:len(order)]
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(group, np.arange(len(order)), 0))
        keep[order] &= rare[order] | (rank < k)
        ends = np.r_[0, np.cumsum(np.bincount(owner[keep], minlength=len(words)))]
        out = pa.StructArray.from_arrays([
            kinds.take(pa.array(code[keep])).cast(pa.string()), pa.array(tf[keep], pa.int64()),
            pa.array(texts_with[keep], pa.int64(), mask=rare[keep]),
        ], ["word", "tf", "having"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), out)

    return F.arrow_udf(likely, "array<struct<word: string, tf: bigint, having: bigint>>")


def tfidf_outcomes(batch: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Outcomes of the keyword tier where no completion client is at hand."""
    return keywords_tfidf(batch).select(
        "id", "keywords", F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("error"),
        moment(as_of).alias("finished_at"),
    )


def split_completion(answer: str | None) -> list[str]:
    """The keywords of an answer. An empty answer gives none, which still counts as success."""
    return [word for word in map(str.strip, (answer or "").split(",")) if word]


def complete_with_retry(
    batch: DataFrame, make_completer: Callable[[], Completer], max_attempts: int = MAX_ATTEMPTS,
    sleep: Callable[[float], None] = time.sleep, calls: int = CALLS, as_of: AsOf = None,
) -> DataFrame:
    """One outcome per review: id, keywords, attempts, error, finished_at.

    The batch is spread over ``calls`` partitions. Each makes one client and asks it row by row,
    waiting 1, 2, 4, ... seconds after a failure. Calls cost money and a lost executor repeats its
    partition, so write the result before using it twice, and leave speculation off.
    """
    def ask(complete: Completer, prompt: str) -> tuple[list[str] | None, int, str | None]:
        error = None
        for attempt in range(1, max_attempts + 1):
            try:
                return split_completion(complete(prompt)), attempt, error
            except Exception as problem:  # noqa: BLE001 - any failure of the client is an outcome
                error = str(problem)
                if attempt < max_attempts:
                    sleep(2 ** (attempt - 1))
        return None, max_attempts, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = None
        for rows in batches:
            complete = complete or make_completer()
            results = [ask(complete, prompt) for prompt in rows["prompt"]]
            keywords, attempts, errors = ([r[i] for r in results] for i in range(3))
            yield pd.DataFrame({"id": rows["id"], "keywords": keywords, "attempts": attempts, "error": errors})

    prompts = batch.repartition(calls, "id").select("id", keyword_prompt(F.col("body")).alias("prompt"))
    outcome = prompts.mapInPandas(run, "id string, keywords array<string>, attempts int, error string")
    return outcome.withColumn("finished_at", moment(as_of))


# Keyword tier: outcomes


def final_outcomes(outcomes: DataFrame) -> DataFrame:
    """One outcome per id: a success before a failure, then the earliest."""
    return first_per_key(
        outcomes, ["id"],
        [F.col("keywords").isNull().asc(), F.asc_nulls_last("finished_at"), F.asc("attempts"), F.asc_nulls_first("error")],
    )


def with_outcome_columns(facts: DataFrame) -> DataFrame:
    return add_missing_columns(facts, {
        "keywords": ("array<string>", None), "retry_count": ("int", 0), "error_message": ("string", None),
        "failed_at": ("timestamp_ntz", None),
    })


def apply_outcomes(enriched: DataFrame, outcomes: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The fact table with the outcomes of the keyword tier set on its rows.

    Outcomes are few next to the facts and live in an append-only table of their own, so a run
    writes its outcomes only, and readers see both through this join. A review that is already
    fully enriched or failed keeps its state.
    """
    facts = with_outcome_columns(enriched)
    news = final_outcomes(outcomes).select(
        "id", F.col("keywords").alias("_keywords"), F.col("attempts").alias("_attempts"),
        F.col("error").alias("_error"), F.col("finished_at").alias("_finished"),
    )
    met = F.col("_attempts").isNotNull() & ~F.coalesce(
        F.col("enrichment_status").isin(FULLY_ENRICHED, FAILED), F.lit(False)
    )
    won, lost = met & F.col("_keywords").isNotNull(), met & F.col("_keywords").isNull()
    reason = F.coalesce(F.when(F.col("_error") != "", F.col("_error")), F.lit("unknown error"))
    changed = {
        "keywords": F.when(won, F.col("_keywords")).otherwise(F.col("keywords")),
        "enrichment_status": F.when(won, FULLY_ENRICHED).when(lost, FAILED).otherwise(F.col("enrichment_status")),
        "retry_count": F.when(won, F.col("_attempts") - 1).when(lost, max_attempts).otherwise(F.col("retry_count")),
        "error_message": F.when(lost, F.left(reason, F.lit(ERROR_CHARS))).otherwise(F.col("error_message")),
        "failed_at": F.when(lost, F.col("_finished")).otherwise(F.col("failed_at")),
    }
    joined = facts.join(F.broadcast(news) if fits_broadcast(outcomes) else news, "id", "left")
    return joined.select([changed.get(c, F.col(c)).alias(c) for c in facts.columns])


def update_from_candidates(
    target: DataFrame, updates: DataFrame, columns: list[str], most: int | None = None,
) -> DataFrame:
    """Set ``columns`` on the rows whose id is among the updates, one per id; a null leaves the old value.

    ``most`` is a bound on the updates that the caller knows, which saves counting them.
    """
    news = updates.select("id", *[F.col(c).alias(f"_{c}") for c in columns])
    small = most <= BROADCAST_ROWS if most is not None else fits_broadcast(news)
    joined = target.join(F.broadcast(news) if small else news, "id", "left")
    return joined.select([
        (F.coalesce(F.col(f"_{c}"), F.col(c)) if c in columns else F.col(c)).alias(c) for c in target.columns
    ])


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Processed, failed, retried (successes after the first attempt) and total."""
    won = F.col("keywords").isNotNull()
    return outcomes.agg(
        F.count_if(won).alias("processed"), F.count_if(~won).alias("failed"),
        F.count_if(won & (F.col("attempts") > 1)).alias("retried"), F.count("*").alias("total"),
    )


def failure_alert(summary: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One WARN log row if any review failed, else none."""
    return summary.where(F.col("failed") > 0).select(
        F.localtimestamp().alias("log_timestamp"), F.lit("WARN").alias("level"),
        F.format_string(
            f"keyword extraction: failed=%d of total=%d, attempts={max_attempts}, state={FAILED}",
            F.col("failed"), F.col("total"),
        ).alias("message"),
    )


# Products


def reviews_with_products(reviews: DataFrame, products: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Reviews with the columns of their product, if it is known. Up to ``max_rows`` products are broadcast.

    A product column whose name a review column has already gets the prefix ``product_``.
    """
    taken = {c.lower() for c in reviews.columns}
    renamed = products.select([
        F.col(c).alias(f"product_{c}" if c.lower() in taken and c.lower() != "asin" else c) for c in products.columns
    ])
    return lookup_join(reviews, renamed, "asin", ["id"], max_rows=max_rows)

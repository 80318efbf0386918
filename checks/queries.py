"""One query per operator, over the whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.fixtures import table, view
from opinionmill.functions import text
from opinionmill.functions.typing import typed_reviews
from opinionmill.operators import enrich, ingest, monitoring as mon, quality, reviews as rev, rollups
from opinionmill.plans import batch
from opinionmill.plans.membership import KeyIndex
from opinionmill.plans.rollups import Rollup
from opinionmill.plans.sample import StoreSample
from opinionmill.plans.store import ReviewStore
from opinionmill.session import shared_folder
from opinionmill.sources import mirror, tables
from opinionmill.streaming.incremental import enrich_stream, enrich_stream_keyed, keyword_step, raw_stream

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2024-01-31 00:00:00"
NEGATIVE = ("worthless", "trash", "moron", "idiot", "pathetic", "scum", "disgusting", "clown", "stupid", "loser")
POSITIVE = ("the", "with", "that")

_found: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _found[fn.__name__] = fn
    return fn


def on(view_name: str, name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """Register ``build`` over one view."""
    _found[name] = lambda spark, sf: build(view(spark, sf, view_name))


def queries() -> dict[str, Query]:
    return dict(_found)


def lexicon(spark: SparkSession) -> DataFrame:
    rows = [(w, -1.0) for w in NEGATIVE] + [(w, 1.0) for w in POSITIVE]
    return spark.createDataFrame(rows, "word string, weight double")


def scorer(spark: SparkSession):
    words = lexicon(spark)
    return lambda df: enrich.sentiment_score(df, words)


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.csv_to_array(view(spark, sf, "enriched"), "keywords_csv", "keywords")


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "outcomes").select(
        "id", text.parse_keywords(F.col("answer")).alias("keywords"), "attempts", "error",
        F.col("finished_at").cast("timestamp_ntz").alias("finished_at"),
    )


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as text, so that results compare as plain values."""
    return df.withColumns({c: F.array_join(c, "|") for c in columns})


# Ingest

on("dirty_reviews", "clean_nulls", ingest.clean_nulls)
on("reviews", "row_hash", lambda df: ingest.add_row_hash(df).select("id", "row_hash"))
on("reviews", "raw_projection", ingest.raw_projection)
on("reviews", "typed_reviews", typed_reviews)
on("reviews", "upper_columns", ingest.upper_columns)
on("object_names", "view_name", lambda df: df.select("p_partkey", text.view_name(F.col("object_name")).alias("view_name")))
on("reviews", "add_missing_columns", lambda df: ingest.add_missing_columns(
    df.select("id", "stars"), {"stars": ("int", 9), "retry_count": ("int", 0), "error_message": ("string", None)}))
on("enriched", "csv_to_array", lambda df: joined(
    ingest.csv_to_array(df, "keywords_csv", "keywords"), "keywords"))
on("enriched", "parse_keywords", lambda df: joined(
    df.select("id", text.parse_keywords(F.col("keywords_csv")).alias("keywords")), "keywords"))


@query
def merge_on_hash(spark: SparkSession, sf: str) -> DataFrame:
    target, batch = (ingest.raw_projection(view(spark, sf, name)) for name in ("merge_target", "merge_batch"))
    return ingest.merged(batch, target, "row_hash", copies_equal=True)


@query
def merge_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Both tables loaded one after the other, keys told by an index of the target; then the second once more."""
    path = folder(spark, "merge_indexed")
    index = KeyIndex(spark, f"{path}/index", f"{path}/raw", "row_hash")
    for name in ("merge_target", "merge_batch", "merge_batch"):
        ingest.ingest_raw(spark, view(spark, sf, name), f"{path}/raw", index)
    return tables.read_path(spark, f"{path}/raw")


@query
def merge_on_key(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.merged(view(spark, sf, "merge_batch"), view(spark, sf, "merge_target"), "id")


# Enrich

on("reviews", "enrichable_reviews", lambda df: enrich.enrichable(df).select("id", "asin", "body"))
on("reviews", "keyword_prompt", lambda df: df.select("id", text.keyword_prompt(F.col("body")).alias("prompt")))


@query
def unprocessed_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.unprocessed(view(spark, sf, "reviews"), view(spark, sf, "known_reviews")).select("id", "asin", "body")


@query
def sentiment_score(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.sentiment_score(view(spark, sf, "reviews"), lexicon(spark)).select("id", "sentiment")


@query
def sentiment_score_large_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """The way taken by a word list too large for a broadcast."""
    return enrich.sentiment_score(view(spark, sf, "reviews"), lexicon(spark), max_rows=0).select("id", "sentiment")


@query
def sentiment_score_middle_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """A long word list with a weight of its own for each word; the words added occur in no text."""
    more = table(spark, sf, "part").select(
        F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("word"), (F.col("p_partkey") / 7.0).alias("weight"))
    words = lexicon(spark).unionByName(more)
    return enrich.sentiment_score(view(spark, sf, "reviews"), words).select("id", "sentiment")


@query
def sentiment_graded(spark: SparkSession, sf: str) -> DataFrame:
    """Graded weights over rows with null and repeated ids."""
    return enrich.sentiment_score(view(spark, sf, "odd_reviews"), view(spark, sf, "graded_words")).select("n", "id", "sentiment")


@query
def sentiment_graded_large(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the way of a large word list."""
    words = view(spark, sf, "graded_words")
    return enrich.sentiment_score(view(spark, sf, "odd_reviews"), words, max_rows=0).select("n", "id", "sentiment")


@query
def enrich_fast(spark: SparkSession, sf: str) -> DataFrame:
    fresh = enrich.enrich_fast(
        ingest.add_row_hash(view(spark, sf, "reviews")), view(spark, sf, "known_reviews"), scorer(spark), AS_OF)
    return fresh.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query
def strategic_pool(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.strategic_pool(enriched(spark, sf), typed_reviews(view(spark, sf, "reviews")))


@query
def strategic_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.strategic_batch(enriched(spark, sf), typed_reviews(view(spark, sf, "reviews")))


@query
def keywords_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return joined(enrich.keywords_tfidf(enrich.enrichable(view(spark, sf, "reviews"))), "keywords")


def _first_words_client():
    """Stands in for a hosted model: the first words of the text, and trouble with some prompts."""
    tries: dict[str, int] = {}

    def complete(prompt: str) -> str | None:
        tries[prompt] = tries.get(prompt, 0) % enrich.MAX_ATTEMPTS + 1
        if tries[prompt] <= len(prompt) % 4:
            raise RuntimeError(f"try {tries[prompt]} failed")
        del tries[prompt]
        if len(prompt) % 3 == 0:
            return None
        return ", ".join(prompt[len(text.KEYWORD_INSTRUCTION):].split(" ")[:3])

    return complete


@query
def complete_with_retry(spark: SparkSession, sf: str) -> DataFrame:
    batch = enrich.enrichable(view(spark, sf, "reviews"))
    done = enrich.complete_with_retry(batch, _first_words_client, sleep=lambda s: None, as_of=AS_OF)
    return joined(done.select("id", "keywords", "attempts", "error"), "keywords")


@query
def apply_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    done = enrich.apply_outcomes(enriched(spark, sf), outcomes(spark, sf))
    return joined(done, "keywords")


@query
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.run_summary(outcomes(spark, sf))


@query
def failure_alert(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.failure_alert(enrich.run_summary(outcomes(spark, sf))).select("level", "message")


@query
def update_from_candidates(spark: SparkSession, sf: str) -> DataFrame:
    facts = enriched(spark, sf)
    chosen = enrich.strategic_batch(facts, typed_reviews(view(spark, sf, "reviews")))
    news = chosen.select(
        "id", F.split(F.concat(F.lit("stars,"), F.col("stars").cast("string")), ",").alias("keywords"),
        F.lit("FULLY_ENRICHED").alias("enrichment_status"))
    done = enrich.update_from_candidates(facts, news, ["keywords", "enrichment_status"], most=enrich.BATCH_ROWS)
    return joined(done.select("id", "keywords", "enrichment_status"), "keywords")


@query
def reviews_with_products(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.reviews_with_products(view(spark, sf, "reviews"), view(spark, sf, "products"))


@query
def reviews_with_products_large(spark: SparkSession, sf: str) -> DataFrame:
    """The way taken by a product table too large to broadcast; hot products are split off by their share."""
    return enrich.reviews_with_products(view(spark, sf, "reviews"), view(spark, sf, "products"), max_rows=0)


def folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run of a query."""
    return f"{shared_folder(spark, name)}/{uuid.uuid4().hex}"


def arriving(spark: SparkSession, sf: str) -> DataFrame:
    """Raw reviews as they come in files."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("asin"), F.col("text").alias("body"),
        (F.col("n_chars") % 5 + 1).cast("string").alias("stars"), F.lit("TRUE").alias("verified_purchase"),
        F.lit("0").alias("found_helpful"))


def streamed(spark: SparkSession, sf: str, run: Callable) -> DataFrame:
    """A stream in two runs over a store that knows some reviews: what it knows stays, the rest is scored once."""
    root = folder(spark, "enrich_stream")
    raw = arriving(spark, sf)
    store = ReviewStore(spark, f"{root}/store")
    known = raw.where("asin = 'src15'").select(
        "id", "asin", "body", F.col("stars").cast("bigint").alias("stars"), F.lit("h").alias("row_hash"),
        F.lit(0.5).alias("sentiment"), F.lit("FAST_ONLY").alias("enrichment_status"),
        F.lit(AS_OF).cast("timestamp").alias("created_at"))
    store.write_facts(known, "seed")
    # Each run finds new files; the second also brings the rows of the first once more.
    for part in (raw.where("asin < 'src15'"), raw):
        part.write.mode("append").parquet(f"{root}/raw")
        stream = raw_stream(spark, f"{root}/raw", raw.schema)
        run(stream, store, f"{root}/checkpoint", scorer(spark), AS_OF).awaitTermination()
    return store.enriched().select("id", "asin", "body", "stars", "sentiment", "enrichment_status", "retry_count")


@query
def enrich_stream_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Each batch meets the store."""
    return streamed(spark, sf, enrich_stream)


@query
def enrich_stream_by_state(spark: SparkSession, sf: str) -> DataFrame:
    """The known ids are the state of the stream."""
    return streamed(spark, sf, enrich_stream_keyed)


@query
def keyword_step_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The keyword tier as the child step of a stream: each run draws from all that is pending."""
    root = folder(spark, "keyword_step")
    raw = arriving(spark, sf)
    store = ReviewStore(spark, f"{root}/store")
    step = keyword_step(lambda: tables.read_path(spark, f"{root}/raw", raw.schema), n=table(spark, sf, "documents").count())
    for part in (raw.where("asin < 'src15'"), raw.where("asin >= 'src15'")):
        part.write.mode("append").parquet(f"{root}/raw")
        stream = raw_stream(spark, f"{root}/raw", raw.schema)
        enrich_stream(stream, store, f"{root}/checkpoint", scorer(spark), AS_OF, step).awaitTermination()
    return joined(store.enriched().select("id", "asin", "enrichment_status", "retry_count", "keywords"), "keywords")


def built_store(spark: SparkSession, sf: str) -> ReviewStore:
    """Loads and outcomes before and after a compaction; the rest of the outcomes meet the base."""
    store = ReviewStore(spark, folder(spark, "compacted_store"))
    scored = enriched(spark, sf).select(
        "id", "asin", "body", F.col("stars").cast("bigint").alias("stars"), F.lit(None).cast("string").alias("row_hash"),
        "sentiment", F.lit("FAST_ONLY").alias("enrichment_status"), F.lit(AS_OF).cast("timestamp").alias("created_at"))
    done = outcomes(spark, sf)
    early = F.col("id").cast("bigint") % 2 == 0
    store.write_facts(scored.where(early), "a")
    store.write_outcomes(done.where(early), "a")
    store.compact()
    store.write_facts(scored.where(~early), "b")
    store.write_outcomes(done.where(~early), "b")
    return store


@query
def compacted_store(spark: SparkSession, sf: str) -> DataFrame:
    return joined(built_store(spark, sf).enriched().drop("row_hash", "created_at"), "keywords")


@query
def cleaned_store(spark: SparkSession, sf: str) -> DataFrame:
    """A second compaction, and what it holds deleted elsewhere."""
    store = built_store(spark, sf)
    store.compact()
    store.clean()
    return joined(store.enriched().drop("row_hash", "created_at"), "keywords")


_rolled: dict[tuple[str, str], Rollup] = {}


def partials(spark: SparkSession, sf: str) -> DataFrame:
    """The partial sums of such a store, which one session builds once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _rolled:
        _rolled[key] = Rollup(built_store(spark, sf))
    return _rolled[key].table()


@query
def sample_of_store(spark: SparkSession, sf: str) -> DataFrame:
    """The stratified sample of a store from the sketches of its loads and its base."""
    rows = StoreSample(built_store(spark, sf), 50).table()
    return rows.select("id", "stars", "body", "enrichment_status", "retry_count")


# Reading and writing


def as_csv(df: DataFrame, path: str) -> str:
    df.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@query
def csv_load(spark: SparkSession, sf: str) -> DataFrame:
    """The reviews written as CSV and read again, line breaks, quotes and all."""
    return tables.read_csv(spark, as_csv(view(spark, sf, "reviews"), folder(spark, "csv_load")))


@query
def bulk_append(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends to one folder, read back."""
    path, reviews = folder(spark, "bulk_append"), view(spark, sf, "reviews")
    for part in (reviews.where("stars <= 3"), reviews.where("stars > 3 or stars is null")):
        tables.append(part, path)
    return tables.read_path(spark, path)


@query
def clustered_read(spark: SparkSession, sf: str) -> DataFrame:
    """All reviews out of the clustered layout."""
    path = folder(spark, "clustered_read")
    tables.write_clustered(view(spark, sf, "reviews"), path)
    return tables.read_path(spark, path)


@query
def first_available(spark: SparkSession, sf: str) -> DataFrame:
    """The third of four sources is the first that is there."""
    loaders = [
        lambda: spark.table("no_such_schema.no_such_table"), lambda: spark.read.parquet(f"{sf}/no_such_table.parquet"),
        lambda: view(spark, sf, "products"), lambda: view(spark, sf, "reviews")]
    return tables.first_available(spark, loaders, view(spark, sf, "products").schema)


@query
def mirror_views(spark: SparkSession, sf: str) -> DataFrame:
    """A schema of tables seen through the views that mirror it."""
    name = f"mirror_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE SCHEMA {name}_raw")
    for each in ("part", "nation"):
        spark.sql(f"CREATE TABLE {name}_raw.tb_{each} USING parquet LOCATION '{sf}/{each}.parquet'")
    done = mirror.mirror_schema(spark, f"{name}_raw", f"{name}_views").where("created")
    parts = spark.table(f"{name}_views.VW_TB_PART").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"))
    nations = spark.table(f"{name}_views.VW_TB_NATION").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    names = done.select(F.lit(-1).alias("key"), F.col("name").alias("value"))
    return parts.unionByName(nations).unionByName(names).select(F.col("key").cast("bigint").alias("key"), "value")


@query
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """What the load of the two files and a keyword run leave in the log."""
    root = folder(spark, "run_log")
    log = f"{root}/logs"
    files = [as_csv(view(spark, sf, name), f"{root}/{name}") for name in ("products", "reviews")]
    batch.stage_files(spark, *files, root, log_path=log)
    batch.stage_to_raw(spark, root, log)
    store, raw = ReviewStore(spark, f"{root}/store"), tables.read_path(spark, f"{root}/raw/reviews")
    batch.fast_tier(store, raw, scorer(spark), "one", AS_OF, log)
    # A run that is repeated has its outcomes already.
    for _ in range(2):
        batch.keyword_tier(store, raw, "one", log_path=log)
    return tables.read_path(spark, log).select("level", "message")


# Questions over the enriched table

for _name, _build in {
    "kpis": rev.kpis,
    "stars_distribution": rev.stars_distribution,
    "sentiment_by_stars": rev.sentiment_by_stars,
    "nps_summary": rev.nps_summary,
    "nps_score": rev.nps_score,
    "status_breakdown": rev.status_breakdown,
    "best_products": rev.product_ranking,
    "worst_products": lambda t: rev.product_ranking(t, best=False),
    "stars_sentiment_breakdown": rev.stars_sentiment_breakdown,
}.items():
    on("enriched", _name, _build)
    on("scored_facts", f"{_name}_facts", _build)

for _name, _build in {
    "kpis": rollups.kpis,
    "stars_distribution": rollups.stars_distribution,
    "sentiment_by_stars": rollups.sentiment_by_stars,
    "nps_summary": rollups.nps_summary,
    "nps_score": rollups.nps_score,
    "status_breakdown": rollups.status_breakdown,
    "best_products": rollups.product_ranking,
    "worst_products": lambda p: rollups.product_ranking(p, best=False),
    "stars_sentiment_breakdown": rollups.stars_sentiment_breakdown,
    "enrichment_coverage": rollups.enrichment_coverage,
    "null_stats": rollups.null_stats,
}.items():
    _found[f"{_name}_rollup"] = lambda spark, sf, build=_build: build(partials(spark, sf))

on("scored_facts", "ingestion_timeline", rev.ingestion_timeline)
on("enriched", "top_reviews", rev.top_reviews)
on("enriched", "sentiment_scatter", rev.sentiment_scatter)


@query
def reviews_filtered(spark: SparkSession, sf: str) -> DataFrame:
    kept = rev.reviews_filtered(enriched(spark, sf), [1, 5, 3], -0.9, 0.8, "p1", "FAST_ONLY")
    return joined(kept, "keywords")


@query
def reviews_unfiltered(spark: SparkSession, sf: str) -> DataFrame:
    return joined(rev.reviews_filtered(enriched(spark, sf), status="FAILED", asin="  "), "keywords")


@query
def keywords_raw(spark: SparkSession, sf: str) -> DataFrame:
    return joined(rev.keywords_raw(enriched(spark, sf)), "keywords")


@query
def keyword_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return rev.keyword_frequency(enriched(spark, sf))


@query
def enrichment_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rev.enrichment_coverage(enriched(spark, sf))


@query
def null_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rev.null_stats(enriched(spark, sf))


# Logs, tasks, usage

on("pipeline_logs", "event_log_tail", lambda df: mon.event_log_tail(df, tie="event_id"))
on("event_records", "event_record_tail", mon.event_record_tail)
on("pipeline_logs", "log_stage_classify", lambda df: mon.classify(df).select("event_id", "stage"))
on("pipeline_logs", "stage_durations", mon.stage_durations)
on("metering", "metering_30d", lambda df: mon.metering_30d(df, AS_OF, "service_type", "purchase"))
on("metering", "metering_10d", lambda df: mon.metering_30d(df, AS_OF, digits=4, days=10))
on("storage", "storage_30d", lambda df: mon.storage_30d(df, AS_OF, "pur"))
on("metering", "usage_by_function", lambda df: mon.usage_by_function(df, AS_OF))
on("query_history", "call_counts_by_function", lambda df: mon.call_counts_by_function(df, AS_OF))
on("snapshots", "latest_snapshot", mon.latest_snapshot)
on("task_history", "latest_per_key", lambda df: mon.latest_per_key(df, "task_name", "completed_time", "event_id"))


@query
def json_field(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", text.json_field(F.col("props"), "k").alias("k"))


@query
def cost_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    metering = view(spark, sf, "metering")
    return mon.cost_snapshot(
        metering, metering, view(spark, sf, "storage"), AS_OF, warehouse_name="WH_CLICK", database_like="view",
        service="signup")


@query
def snapshot_append(spark: SparkSession, sf: str) -> DataFrame:
    """Today's row goes in once; a day that is there already stays as it is."""
    snapshots = view(spark, sf, "snapshots")
    return mon.append_snapshot(
        cost_snapshot(spark, sf).unionByName(
            snapshots.withColumn("storage_gb", F.lit(1.0))), snapshots)


@query
def task_status(spark: SparkSession, sf: str) -> DataFrame:
    return mon.task_status(view(spark, sf, "tasks"), view(spark, sf, "task_history"), AS_OF, tie="event_id")


# Quality

on("reviews", "quality_reviews", lambda df: quality.run_checks(df, quality.review_rules()))
on("products", "quality_products", lambda df: quality.run_checks(df, quality.product_rules()))
on("reviews", "stratified_sample", lambda df: quality.stratified_sample(df, 50).select("id", "stars", "body"))

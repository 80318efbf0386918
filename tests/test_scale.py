"""What has to hold when a key carries a third of the rows or a side outgrows a broadcast."""

import pytest
from pyspark.sql import functions as F

from opinionmill.operators import enrich, ingest, monitoring as mon, quality, reviews as rev
from opinionmill.plans import joins
from opinionmill.plans.store import ReviewStore
from opinionmill.schemas import REVIEWS_FAST

N = 6000


@pytest.fixture
def no_small_sides(spark):
    """Neither the planner nor the runtime turns a shuffle join into a broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture
def hot_reviews(spark):
    """A third of the reviews are of one product, a third of none."""
    return spark.range(N).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, "HOT").when(F.col("id") % 3 == 1, F.concat(F.lit("P"), F.col("id") % 400)).alias("asin"))


@pytest.fixture
def products(spark):
    names = spark.range(400).select(F.concat(F.lit("P"), F.col("id")).alias("asin"), F.concat(F.lit("name "), F.col("id")).alias("title"))
    return names.union(spark.createDataFrame([("HOT", "hot one")], "asin string, title string"))


def largest_partition(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def set_limit(monkeypatch, rows):
    monkeypatch.setattr(joins.fits_broadcast, "__defaults__", (rows, 1 << 26))
    monkeypatch.setattr(joins.local_copy, "__defaults__", (rows, 1 << 26))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", rows)


def test_size_check(spark):
    df = spark.range(10).select(F.lit("x" * 100).alias("v"))
    assert joins.fits_broadcast(df, 10, 1000) and not joins.fits_broadcast(df, 9) and not joins.fits_broadcast(df, 10, 999)
    assert joins.fits_broadcast(df.limit(0), 0)


def test_size_check_stops_early(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for rows in batches:
            seen.add(len(rows))
            yield rows

    many = spark.range(0, 100_000, 1, 100).mapInPandas(count, "id long")
    assert not joins.fits_broadcast(many, 10)
    assert seen.value < 20_000


def test_hot_key_does_not_fill_a_task(spark, hot_reviews, products, no_small_sides, rows):
    plain = hot_reviews.join(products, "asin", "left")
    spread = joins.lookup_join(hot_reviews, products, "asin", ["id"], max_rows=0)
    assert largest_partition(spread) < N / 3 < largest_partition(plain)
    assert rows(spread.select("id", "asin", "title")) == rows(plain.select("id", "asin", "title"))
    assert spread.count() == N


def test_spread_keeps_rows_of_broadcast_and_shuffle_alike(hot_reviews, products, rows):
    small = joins.lookup_join(hot_reviews, products.where("asin != 'P7'"), "asin", ["id"])
    large = joins.lookup_join(hot_reviews, products.where("asin != 'P7'"), "asin", ["id"], max_rows=0)
    assert small.columns == large.columns and rows(small) == rows(large)


def batch_and_target(spark):
    # One id in three copies of every row, others twice now and then, a tenth known.
    batch = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "HOT").when(F.col("id") % 50 == 1, (F.col("id") - 1).cast("string"))
        .otherwise(F.col("id").cast("string")).alias("id"), (F.col("id") % 7).alias("v"), F.lit("text").alias("body"))
    target = spark.range(0, 3000, 10).select(F.col("id").cast("string").alias("id"))
    return batch, target


@pytest.mark.parametrize("limit", [0, 1, 500, 100_000])
def test_new_rows_are_the_same_whatever_is_small(spark, monkeypatch, rows, limit):
    batch, target = batch_and_target(spark)
    expected = {}
    known = {r.id for r in target.collect()}
    for r in batch.collect():
        if r.id not in known:
            expected[r.id] = min(expected.get(r.id, 9), r.v)
    set_limit(monkeypatch, limit)
    got = joins.without_known(batch, target, "id")
    assert got.columns == batch.columns and got.count() == len(expected)
    assert {(r.id, r.v) for r in got.collect()} == set(expected.items())
    equal = joins.without_known(batch.select("id", "body"), target, "id", copies_equal=True)
    assert sorted(r.id for r in equal.collect()) == sorted(expected)


def test_large_batch_is_not_shuffled_for_few_repeats(spark, monkeypatch, plan):
    # Copies of one hot id and a few known ids: both sets are small, the batch is not.
    batch = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("id").cast("string")).alias("id"), F.lit("text").alias("body"))
    target = spark.range(0, 3000, 100).select(F.col("id").cast("string").alias("id"))
    set_limit(monkeypatch, 100)
    text = plan(joins.without_known(batch, target, "id"))
    shuffles = [line for line in text.split("\n") if "Exchange hashpartitioning" in line]
    # The only one is of the copies, of which each task sends the first.
    assert len(shuffles) == 1 and "WindowGroupLimit" in text


def test_small_batch_leaves_target_in_place(spark, plan, no_small_sides):
    batch = spark.createDataFrame([("1", "x")], "id string, body string")
    target = spark.range(10000).select(F.col("id").cast("string").alias("id"))
    text = plan(joins.without_known(batch, target, "id"))
    assert "SortMergeJoin" not in text and "Exchange hashpartitioning" not in text


@pytest.mark.parametrize("limit", [0, 500, 100_000])
def test_merge_reads_its_source_once(spark, monkeypatch, tmp_path, limit):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for rows in batches:
            seen.add(len(rows))
            yield rows

    batch, target = batch_and_target(spark)
    path = str(tmp_path / "merged")
    target.withColumn("v", F.lit(0).cast("bigint")).withColumn("body", F.lit("text")).write.parquet(path)
    source = batch.mapInPandas(count, "id string, v long, body string")
    set_limit(monkeypatch, limit)
    added = ingest.merge_append(spark, source, path, "id")
    assert seen.value == 3000 and added == len({r.id for r in batch.collect()} - {r.id for r in target.collect()})


@pytest.mark.parametrize("build", [
    lambda df: mon.latest_per_key(df, "id", "v"),
    lambda df: joins.first_per_key(df, ["id"], [F.col("v").asc()]),
    lambda df: enrich.final_outcomes(df.select("id", F.array(F.lit("a")).alias("keywords"), F.lit(None).cast("timestamp").alias("finished_at"),
                                               F.lit(1).alias("attempts"), F.lit("").alias("error"))),
])
def test_first_row_is_cut_before_the_shuffle(spark, plan, build):
    batch, _ = batch_and_target(spark)
    text = plan(build(batch))
    limits = [line for line in text.split("\n") if "WindowGroupLimit" in line]
    assert any("Partial" in line for line in limits) and any("Final" in line for line in limits)


@pytest.fixture
def facts(spark, tmp_path):
    path = str(tmp_path / "facts")
    spark.range(100).select(
        F.col("id").cast("string").alias("id"), F.lit("A").alias("asin"), F.lit("text").alias("body"), (F.col("id") % 5 + 1).alias("stars"),
        (F.col("id") / 100).alias("sentiment"), F.array(F.lit("k")).alias("keywords"), F.lit("FAST_ONLY").alias("enrichment_status"),
        F.current_timestamp().alias("created_at"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_scans_read_only_what_is_asked(facts, plan):
    assert "ReadSchema: struct<stars:bigint>" in plan(rev.stars_distribution(facts))
    assert "ReadSchema: struct<sentiment:double,enrichment_status:string>" in plan(rev.kpis(facts))
    assert "body" not in plan(rev.product_ranking(facts))


def test_filters_reach_the_scan(facts, plan):
    text = plan(rev.reviews_filtered(facts, [1, 5], -0.5, 0.5, status="FAST_ONLY"))
    pushed = text[text.index("PushedFilters"):]
    for part in ("In(stars, [1,5])", "GreaterThanOrEqual(sentiment,-0.5)", "EqualTo(enrichment_status,FAST_ONLY)"):
        assert part in pushed


@pytest.mark.parametrize("question", [rev.top_reviews, rev.reviews_filtered, rev.keyword_frequency, rev.product_ranking])
def test_lists_keep_only_their_top(facts, plan, question):
    text = plan(question(facts))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


@pytest.mark.parametrize("question", [
    rev.kpis, rev.stars_distribution, rev.status_breakdown, rev.ingestion_timeline, rev.product_ranking,
    rev.stars_sentiment_breakdown, rev.nps_score, rev.null_stats,
])
def test_groups_are_summed_before_the_shuffle(facts, plan, question):
    assert "partial_" in plan(question(facts))


def test_scores_need_no_shuffle(spark, facts, plan):
    words = spark.createDataFrame([("good", 1.0)], "word string, weight double")
    assert "Exchange" not in plan(enrich.sentiment_score(facts, words))


def test_texts_stay_out_of_the_choice(facts, plan, no_small_sides):
    reviews = facts.select("id", F.lit(True).alias("verified_purchase"), F.lit(9).alias("found_helpful"))
    pending = facts.withColumn("keywords", F.lit(None).cast("array<string>"))
    text = plan(enrich.strategic_pool(pending, reviews))
    shuffled = [line for line in text.split("\n") if "Project [id" in line]
    assert "SortMergeJoin" in text and not any("body" in line for line in shuffled)


def test_store_reads_texts_of_the_batch_only(spark, facts, plan, tmp_path, no_small_sides):
    store = ReviewStore(spark, str(tmp_path / "store"))
    columns = facts.select(*[c for c in REVIEWS_FAST.names if c != "row_hash"], F.lit("h").alias("row_hash"))
    store.write_facts(columns.withColumn("enrichment_status", F.lit("FAST_ONLY")).select(REVIEWS_FAST.names), "a")
    reviews = facts.select("id", F.lit(True).alias("verified_purchase"), F.lit(9).alias("found_helpful"))
    states = store.enriched().drop("body")
    text = plan(enrich.strategic_batch(states, reviews, 5, texts=store.facts()))
    scans = [line for line in text.split("\n") if "FileScan" in line and "body" in line]
    assert len(scans) == 1 and "BroadcastHashJoin" in text
    joins_above = text[:text.index(scans[0])]
    assert "SortMergeJoin" not in joins_above and "Exchange hashpartitioning" not in joins_above


def test_uniqueness_reads_its_own_column(facts, plan):
    text = plan(quality.run_checks(facts, quality.review_rules()))
    assert "ReadSchema: struct<id:string>" in text and "Expand" not in text


def test_stratum_is_cut_before_the_shuffle(hot_reviews, plan):
    df = hot_reviews.withColumn("stars", F.when(F.col("asin") == "HOT", 5).otherwise(1)).withColumn("body", F.lit("text"))
    text = plan(quality.stratified_sample(df.drop("asin"), 10))
    limits = [line for line in text.split("\n") if "WindowGroupLimit [stars" in line]
    assert any("Partial" in line for line in limits) and any("Final" in line for line in limits)


def test_tfidf_shuffles_no_text(facts, plan, no_small_sides):
    text = plan(enrich.keywords_tfidf(facts))
    for line in text.split("\n"):
        if "Exchange" in line:
            assert "body" not in line
    assert "Exchange hashpartitioning(id" in text and "WindowGroupLimit" in text


def test_long_frequent_word_fills_no_task(spark, no_small_sides):
    long = "x" * 80
    df = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit(f"{long} word"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("body"))
    got = enrich.keywords_tfidf(df, k=2)
    assert got.count() == 2000 and largest_partition(got) < 1000
    assert got.where(F.get("keywords", F.lit(1)) == long).count() == 2000


def test_cost_snapshot_joins_nothing(spark, plan):
    m = spark.createDataFrame([], "start_time timestamp_ntz, credits_used double, warehouse_name string, service_type string")
    s = spark.createDataFrame([], "usage_date date, average_database_bytes double, database_name string")
    assert "Join" not in plan(mon.cost_snapshot(m, m, s, "2024-01-31", warehouse_name="WH"))


def test_raw_merge_has_one_shuffle_of_rows(spark, monkeypatch, plan, no_small_sides):
    set_limit(monkeypatch, 0)
    batch = ingest.raw_projection(spark.range(1000).select("id", F.lit("text").alias("body")))
    text = plan(ingest.new_rows(batch, batch.limit(0), "row_hash", copies_equal=True))
    rows = [line for line in text.split("\n") if "Exchange hashpartitioning(row_hash" in line]
    assert len(rows) <= 2

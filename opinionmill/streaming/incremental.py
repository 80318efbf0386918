"""New raw reviews to the enriched table, as a restartable stream."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from opinionmill.functions.times import AsOf
from opinionmill.functions.typing import typed_reviews
from opinionmill.operators.enrich import BATCH_ROWS, enrichable, scored_facts, tfidf_outcomes, unprocessed
from opinionmill.plans.batch import Extract, Score, fast_tier, keyword_tier
from opinionmill.plans.store import ReviewStore
from opinionmill.schemas import REVIEWS_STAGING, all_strings
from opinionmill.sources.tables import folders, has_files

# A backlog is worked off in batches of this many files.
FILES_PER_BATCH = 1_000


def raw_stream(
    spark: SparkSession, path: str, schema: T.StructType | None = None, files_per_batch: int = FILES_PER_BATCH,
    **options: str,
) -> DataFrame:
    """The insert-only raw folder as a stream: every new file is new rows."""
    return (
        spark.readStream.schema(schema or all_strings(REVIEWS_STAGING))
        .option("maxFilesPerTrigger", files_per_batch).options(**options).parquet(path)
    )


def keyword_step(
    raw: Callable[[], DataFrame], n: int = BATCH_ROWS, extract: Extract = tfidf_outcomes, log_path: str | None = None,
) -> Callable[[ReviewStore, DataFrame, str], object]:
    """A ``then`` that runs the keyword tier over all pending reviews, those of earlier batches too.

    ``raw`` loads the whole raw table, which the votes come from.
    """
    return lambda store, batch, load_id: keyword_tier(store, raw(), load_id, n, extract, log_path)


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    line = spark.read.text(posixpath.join(checkpoint, "metadata")).first()[0]
    return json.loads(line)["id"]


def enrich_stream(
    raw: DataFrame, store: ReviewStore, checkpoint: str, score: Score, as_of: AsOf = None,
    then: Callable[[ReviewStore, DataFrame, str], object] | None = None,
) -> StreamingQuery:
    """Score all raw rows that are new since the last call, then stop.

    Each batch drops reviews that are enriched already and writes its own folder, named after the
    stream and the batch, so a batch that runs twice gives the same table. ``then`` runs after the
    rows of the batch are written, with the store, the batch and the name of its load. Call it as
    often as new data should be looked for; without new files no batch runs.
    """
    def on_batch(batch: DataFrame, number: int) -> None:
        load_id = f"{_stream_id(store.spark, checkpoint)}-{number:09d}"
        # The merge, the scores and the next step all look at the batch.
        kept = batch.persist()
        try:
            fast_tier(store, kept, score, load_id, as_of)
            if then:
                then(store, kept, load_id)
        finally:
            kept.unpersist()

    return (
        raw.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def enrich_stream_keyed(
    raw: DataFrame, store: ReviewStore, checkpoint: str, score: Score, as_of: AsOf = None,
    then: Callable[[ReviewStore, DataFrame, str], object] | None = None,
) -> StreamingQuery:
    """:func:`enrich_stream` with the known ids in the stream's state instead of a join of each batch with the store.

    The state is a de-duplication on the id, partitioned like every shuffle of the stream. Its first load are the ids
    that the store holds when the stream first starts, which come in with its first batch; only that batch looks into
    the store, as its rows may have met the state before those ids. From then on a batch reads its own files and the
    state of their ids, so the stream has to be the only writer of facts to the store. Of rows of one batch that share an
    id any one is taken. The state holds all ids: large ones belong in RocksDB
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    spark = store.spark
    snapshot = f"{checkpoint.rstrip('/')}-known"
    # Until the first batch is planned the snapshot may be taken anew.
    if "offsets" not in folders(spark, checkpoint) or not has_files(spark, posixpath.join(checkpoint, "offsets")):
        store.facts().select("id").where(F.col("id").isNotNull()).distinct().write.mode("overwrite").parquet(snapshot)
    known = spark.readStream.schema("id string").parquet(snapshot).withColumn("_known", F.lit(True))
    reviews = enrichable(typed_reviews(raw)).where(F.col("id").isNotNull()).withColumn("_known", F.lit(False))
    fresh = reviews.unionByName(known, allowMissingColumns=True).dropDuplicates(["id"])

    def on_batch(batch: DataFrame, number: int) -> None:
        load_id = f"{_stream_id(spark, checkpoint)}-{number:09d}"
        kept = batch.where(~F.col("_known")).drop("_known").persist()
        try:
            new = kept if number else unprocessed(kept, store.facts(without=load_id))
            store.write_facts(scored_facts(new, score, as_of), load_id)
            if then:
                then(store, kept, load_id)
        finally:
            kept.unpersist()

    return (
        fresh.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )

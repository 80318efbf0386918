"""The batch run from files to the enriched table."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from opinionmill.functions.times import AsOf
from opinionmill.functions.typing import as_staging, typed_reviews
from opinionmill.operators.enrich import enrich_fast, failure_alert, run_summary, strategic_batch, tfidf_outcomes
from opinionmill.operators.ingest import clean_nulls, ingest_raw, merge_append
from opinionmill.operators.monitoring import append_snapshot
from opinionmill.plans.membership import KeyIndex
from opinionmill.plans.store import ReviewStore
from opinionmill.schemas import COST_SNAPSHOT, PRODUCTS_STAGING, REVIEWS_STAGING
from opinionmill.sources.tables import (
    append_log_rows, append_rows, csv_parts, first_available, logged, read_csv, read_path,
)

Score = Callable[[DataFrame], DataFrame]
Extract = Callable[[DataFrame], DataFrame]


def stage_files(
    spark: SparkSession, products_csv: str, reviews_csv: str, root: str, bad_rows: str = "fail", log_path: str | None = None,
) -> tuple[int, int]:
    """CSV files to typed staging folders, insert-only on ASIN and ID; returns the rows added.

    A line with too many values stops the load, is passed over with "skip", or goes to the folder
    ``quarantine`` with "quarantine", which the log counts.
    """
    def load(csv: str, schema, name: str, key: str) -> int:
        with logged(spark, log_path, f"seed load of {name}") as notes:
            if bad_rows == "quarantine":
                rows, bad = csv_parts(spark, csv)
                seen = Observation()
                target = posixpath.join(root, "quarantine", name, f"load={uuid.uuid4().hex}")
                bad.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(target)
                notes.append(f"quarantined={seen.get['n']}")
            else:
                rows = read_csv(spark, csv, bad_rows=bad_rows)
            typed = as_staging(clean_nulls(rows), schema)
            added = merge_append(spark, typed, posixpath.join(root, "source", name), key)
            notes.append(f"added={added}")
        return added

    return (
        load(products_csv, PRODUCTS_STAGING, "products", "ASIN"),
        load(reviews_csv, REVIEWS_STAGING, "reviews", "ID"),
    )


def stage_to_raw(spark: SparkSession, root: str, log_path: str | None = None, indexed: bool = False) -> dict[str, int]:
    """Hash the staging folders and merge them into the raw ones, with an index of the hashes if ``indexed``."""
    added = {}
    for name in ("products", "reviews"):
        with logged(spark, log_path, f"migration of {name} to raw") as notes:
            source = read_path(spark, posixpath.join(root, "source", name))
            path = posixpath.join(root, "raw", name)
            index = KeyIndex(spark, posixpath.join(root, "index", name), path, "row_hash") if indexed else None
            added[name] = ingest_raw(spark, source, path, index)
            notes.append(f"added={added[name]}")
    return added


def fast_tier(
    store: ReviewStore, raw_reviews: DataFrame, score: Score, load_id: str, as_of: AsOf = None, log_path: str | None = None,
) -> DataFrame:
    """Score and append the reviews the store lacks; returns the rows written."""
    with logged(store.spark, log_path, f"sentiment run {load_id}"):
        fresh = enrich_fast(typed_reviews(raw_reviews), store.facts(without=load_id), score, as_of)
        return store.write_facts(fresh, load_id)


def keyword_tier(
    store: ReviewStore, raw_reviews: DataFrame, load_id: str, n: int = 500, extract: Extract = tfidf_outcomes,
    log_path: str | None = None,
) -> DataFrame:
    """Extract keywords for the strategic batch, write the outcomes, and return the run summary.

    The outcomes are read back from what was written, so a costly client is asked once; a load that
    has its outcomes already asks for none.
    """
    with logged(store.spark, log_path, f"keyword run {load_id}") as notes:
        if store.has_outcomes(load_id):
            outcomes = store.outcomes_of(load_id)
        else:
            # Every stored review has text, so the choice need not read the texts.
            states = store.enriched().drop("body")
            # The extraction reads the batch several times, and a large one shuffles its texts.
            batch = strategic_batch(states, typed_reviews(raw_reviews), n, texts=store.facts()).persist()
            try:
                outcomes = store.write_outcomes(extract(batch), load_id)
            finally:
                batch.unpersist()
        summary = run_summary(outcomes)
        if log_path:
            done = summary.first().asDict()
            notes += [f"{k}={v}" for k, v in done.items()]
    if log_path and summary.first()["failed"]:
        append_log_rows(failure_alert(summary), log_path)
    return summary


def daily_snapshot(spark: SparkSession, snapshot: DataFrame, path: str) -> None:
    """Append the day's cost row to the snapshot folder, once a day."""
    existing = first_available(spark, [lambda: read_path(spark, path)], COST_SNAPSHOT)
    append_rows(append_snapshot(snapshot, existing), path)

"""The stratified sample of a review store, kept up load by load, so that a new load alone is ranked.

A load has a sketch: the first ``k`` rows of each of its strata in the sample's order. A row among the first ``k`` of the
whole store is among the first ``k`` of its load, so the first ``k`` of all sketches together are those of the store,
exactly. A base has a sketch of its own, which replaces those of the loads it holds. Young outcomes are set on the rows
that are left; they change neither keys nor strata.

An id lies in one load of a store, as its loads skip rows of others; only within a load may it repeat. Rows without an id
or stratum take no part; a store without rows gives none. A sketch holds at most ``k`` rows for each stratum, whatever
the load's size. It counts from the moment it is complete, and a half-written one is written anew.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql import DataFrame

from opinionmill.operators.enrich import apply_outcomes, with_outcome_columns
from opinionmill.operators.quality import stratified_sample
from opinionmill.plans.store import ReviewStore, State
from opinionmill.schemas import REVIEWS_ENRICHED
from opinionmill.sources.tables import complete, folders, remove_folder


@dataclass(frozen=True)
class StoreSample:
    store: ReviewStore
    k: int
    stratum: str = "stars"

    @property
    def root(self) -> str:
        return posixpath.join(self.store.root, "sample", f"{self.stratum}-{self.k}")

    def _sketches(self, state: State) -> dict:
        """Names of the sketches that make up the store, and the rows of each."""
        parts = {f"facts-{load}": lambda load=load: with_outcome_columns(self.store.load_rows("facts", [load])) for load in state.facts}
        if state.base is not None:
            parts[f"base-{posixpath.basename(state.base)}"] = lambda: self.store.base_rows(state)
        return parts

    def _refresh(self, state: State) -> list[str]:
        paths = []
        for name, rows in self._sketches(state).items():
            path = posixpath.join(self.root, name)
            if not complete(self.store.spark, path):
                first = stratified_sample(rows().select(REVIEWS_ENRICHED.names), self.k, stratum=self.stratum)
                first.coalesce(1).write.mode("overwrite").parquet(path)
            paths.append(path)
        return paths

    def refresh(self) -> list[str]:
        """Write the sketches that are missing; returns the folders that make up the sample of the store as it is."""
        return self._refresh(self.store.state())

    def table(self) -> DataFrame:
        """What ``stratified_sample`` gives for all rows of the store, from sketches and young outcomes alone."""
        spark, state = self.store.spark, self.store.state()
        paths = self._refresh(state)
        if not paths:
            return spark.createDataFrame([], REVIEWS_ENRICHED)
        rows = stratified_sample(spark.read.schema(REVIEWS_ENRICHED).parquet(*paths), self.k, stratum=self.stratum)
        return apply_outcomes(rows, self.store.load_rows("outcomes", state.outcomes)) if state.outcomes else rows

    def clean(self) -> int:
        """Delete the sketches that the sample no longer reads; returns how many went. For a time without readers."""
        used = set(self._sketches(self.store.state()))
        gone = [name for name in folders(self.store.spark, self.root) if name not in used]
        for name in gone:
            remove_folder(self.store.spark, posixpath.join(self.root, name))
        return len(gone)

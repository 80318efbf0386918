"""Partial sums of a review store, one for each load, so that a question reads no facts.

A load of facts has one partial, written once. A base has one of its own, which replaces those of the loads it holds.
Outcomes change the state of reviews that other loads brought: the reviews that young outcomes name are taken off as they
were and added as they are, in one correction for the base and the set of young outcomes. It is made anew when either
changes, by one scan of the facts for the ids of the outcomes.

A partial counts from the moment its folder is complete. It lies in a folder named after what it sums up, so one that is
written twice is the same.
"""

from __future__ import annotations

import hashlib
import posixpath
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from opinionmill.operators import rollups
from opinionmill.operators.enrich import apply_outcomes, with_outcome_columns
from opinionmill.plans.joins import fits_broadcast
from opinionmill.plans.store import ReviewStore
from opinionmill.sources.tables import complete


@dataclass(frozen=True)
class Rollup:
    store: ReviewStore

    def _path(self, name: str) -> str:
        return posixpath.join(self.store.root, "rollup", name)

    def _ensured(self, name: str, make) -> str:
        path = self._path(name)
        if not complete(self.store.spark, path):
            make().write.mode("overwrite").parquet(path)
        return path

    def _correction(self, facts: DataFrame, outcomes: DataFrame) -> DataFrame:
        """What the outcomes change: their reviews as they were, taken off, and as they are."""
        ids = outcomes.select("id").distinct()
        before = facts.join(F.broadcast(ids) if fits_broadcast(ids) else ids, "id", "left_semi")
        after = apply_outcomes(before, outcomes)
        return rollups.added(rollups.partial(before, -1).unionByName(rollups.partial(after)))

    def refresh(self) -> list[str]:
        """Write the partials that are missing; returns the folders that add up to the store as it is."""
        state = self.store.state()
        paths = []
        if state.base is not None:
            name = posixpath.basename(state.base)
            paths.append(self._ensured(f"base-{name}", lambda: rollups.partial(self.store.base_rows(state))))
        for load in state.facts:
            paths.append(self._ensured(f"facts-{load}", lambda load=load: rollups.partial(
                with_outcome_columns(self.store.load_rows("facts", [load])))))
        if state.outcomes:
            of = "\n".join([state.base or "", *state.facts, "", *state.outcomes])
            key = hashlib.sha256(of.encode()).hexdigest()[:32]
            paths.append(self._ensured(f"outcomes-{key}", lambda: self._correction(
                self.store.rows_without_outcomes(state), self.store.load_rows("outcomes", state.outcomes))))
        return paths

    def table(self) -> DataFrame:
        """The partials of the whole store, for the questions of :mod:`opinionmill.operators.rollups`."""
        paths = self.refresh()
        if not paths:
            return rollups.partial(self.store.enriched())
        return rollups.added(self.store.spark.read.parquet(*paths))

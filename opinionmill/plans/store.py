"""The fact table on plain folders: append-only facts and outcomes beside a compacted base.

Every load writes one sub-folder, ``load_id=...``, in overwrite mode. A load that is repeated after
a failure replaces its own rows and nothing else. ``compact`` folds all loads into a new version of
the base, clustered by product and stars; readers take the latest base and only the loads that are
younger than it, so between compactions little is joined, and right after one nothing is.
Readers list the folders of loads, not their files; ``clean`` deletes the loads that the latest base
holds and the bases before it, so neither grows for ever.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from opinionmill.operators.enrich import apply_outcomes, with_outcome_columns
from opinionmill.schemas import BASE_VERSIONS, OUTCOMES, REVIEWS_ENRICHED, REVIEWS_FAST
from opinionmill.sources.tables import append, complete, exists, folders, read_path, remove_folder, write_clustered


@dataclass(frozen=True)
class State:
    """The latest base, if there is one, and the loads that are younger."""

    base: str | None
    facts: list[str]
    outcomes: list[str]


@dataclass(frozen=True)
class ReviewStore:
    spark: SparkSession
    root: str

    def _path(self, *parts: str) -> str:
        return posixpath.join(self.root, *parts)

    def _base(self) -> tuple[str | None, dict[str, list[str]]]:
        """Folder of the latest base, and the loads of each kind that it holds."""
        path = self._path("versions")
        if not exists(self.spark, path):
            return None, {}
        last = read_path(self.spark, path, BASE_VERSIONS).orderBy(F.desc("version"), "folder").first()
        return self._path("base", last["folder"]), {"facts": last["facts"], "outcomes": last["outcomes"]}

    def _loads(self, name: str) -> list[str]:
        """Loads, by the names of their folders."""
        return sorted(m[1] for f in folders(self.spark, self._path(name)) if (m := re.match(r"load_id=(.+)", f)))

    def _read(self, name: str, schema: T.StructType, loads: list[str]) -> DataFrame:
        if not loads:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._path(name, f"load_id={load}") for load in loads])

    def _young(self, name: str, folded: dict[str, list[str]], without: str | None) -> list[str]:
        return [load for load in self._loads(name) if load not in set(folded.get(name, [])) and load != without]

    def state(self) -> State:
        base, folded = self._base()
        return State(base, self._young("facts", folded, None), self._young("outcomes", folded, None))

    def base_rows(self, state: State) -> DataFrame:
        return read_path(self.spark, state.base, REVIEWS_ENRICHED)

    def load_rows(self, name: str, loads: list[str]) -> DataFrame:
        return self._read(name, REVIEWS_FAST if name == "facts" else OUTCOMES, loads)

    def rows_without_outcomes(self, state: State) -> DataFrame:
        """All reviews as they are before the young outcomes."""
        young = with_outcome_columns(self.load_rows("facts", state.facts))
        return young if state.base is None else self.base_rows(state).unionByName(young)

    def facts(self, without: str | None = None) -> DataFrame:
        """The fast tier's columns of all rows, less those of the load ``without`` if it is not in the base yet."""
        base, folded = self._base()
        young = self._read("facts", REVIEWS_FAST, self._young("facts", folded, without))
        if base is None:
            return young
        return read_path(self.spark, base, REVIEWS_ENRICHED).select(REVIEWS_FAST.names).unionByName(young)

    def outcomes(self, without: str | None = None) -> DataFrame:
        """All outcomes, also those that the base holds already."""
        return self._read("outcomes", OUTCOMES, self._young("outcomes", {}, without))

    def has_outcomes(self, load_id: str) -> bool:
        return complete(self.spark, self._path("outcomes", f"load_id={load_id}"))

    def outcomes_of(self, load_id: str) -> DataFrame:
        return read_path(self.spark, self._path("outcomes", f"load_id={load_id}"), OUTCOMES)

    def write_facts(self, df: DataFrame, load_id: str) -> DataFrame:
        return self._write(df, "facts", load_id)

    def write_outcomes(self, df: DataFrame, load_id: str) -> DataFrame:
        return self._write(df, "outcomes", load_id)

    def _write(self, df: DataFrame, name: str, load_id: str) -> DataFrame:
        path = self._path(name, f"load_id={load_id}")
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def enriched(self, without: str | None = None) -> DataFrame:
        """Facts with their outcomes; ``without`` leaves out the outcomes of that load."""
        base, folded = self._base()
        facts, outcomes = self._young("facts", folded, None), self._young("outcomes", folded, without)
        rows = with_outcome_columns(self._read("facts", REVIEWS_FAST, facts))
        if base is not None:
            stored = read_path(self.spark, base, REVIEWS_ENRICHED)
            rows = stored.unionByName(rows) if facts else stored
        return apply_outcomes(rows, self._read("outcomes", OUTCOMES, outcomes)) if outcomes else rows

    def compact(self, partitions: int | None = None) -> int:
        """Fold all loads into a new version of the base and return its number.

        A version counts from the moment it is listed, after its rows are written.
        """
        base, _ = self._base()
        # Loads that have been cleaned up can't be read again, so they need no mention.
        loads = {name: self._loads(name) for name in ("facts", "outcomes")}
        number = 1 if base is None else int(re.search(r"v(\d+)-", base)[1]) + 1
        folder = f"v{number:06d}-{uuid.uuid4().hex}"
        write_clustered(self.enriched().select(REVIEWS_ENRICHED.names), self._path("base", folder), partitions)
        row = [(number, folder, loads["facts"], loads["outcomes"])]
        append(self.spark.createDataFrame(row, BASE_VERSIONS).coalesce(1), self._path("versions"))
        return number

    def clean(self) -> int:
        """Delete the loads that the latest base holds and all other bases; returns how many folders went.

        For a time when no run or reader is under way: both may hold a plan over what goes.
        """
        base, folded = self._base()
        if base is None:
            return 0
        gone = [self._path(name, f"load_id={load}") for name in folded for load in self._loads(name) if load in set(folded[name])]
        gone += [self._path("base", f) for f in folders(self.spark, self._path("base")) if f != posixpath.basename(base)]
        for path in gone:
            remove_folder(self.spark, path)
        return len(gone)

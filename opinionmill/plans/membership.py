"""Which keys a stored table has, told by an index beside it.

An insert-only merge asks of every key of a batch whether the target has it. Reading the target's key column for that
costs as much as the target is large. The index keeps, for each load and each of ``segments`` segments of the keys'
digests, a Bloom filter and the sorted digests themselves, as two columns of one Parquet row:

1. The keys of a batch meet the filters of their segment, some 2 bytes a stored key. What no filter has is new.
2. Of the few others, the digests of the loads and segments that may have them are read, and settle it.

A digest is the first 16 bytes of a key's SHA-256. Segments split by digest, so they are even, whatever the keys are.

The index lists the files that it covers. Files of the table that it doesn't are read and added before an answer, and
a part one of whose files is gone counts no more; its other files are read again. So an answer never depends on whether a
load had the time to write its part.
"""

from __future__ import annotations

import math
import posixpath
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opinionmill.plans.joins import fits_broadcast
from opinionmill.sources.tables import exists, is_absent

DIGEST = 16
BITS_PER_KEY = 16
PROBES = 4

_PARTS = "part string, segment int, n long, bits binary, digests binary"


def digest(key: Column) -> Column:
    return F.substring(F.unhex(F.sha2(key.cast("string"), 256)), 1, DIGEST)


def _digests(values) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(v) for v in values), f"S{DIGEST}") if len(values) else np.zeros(0, f"S{DIGEST}")


def _probes(values, bits: int) -> np.ndarray:
    """The places of each digest in a filter of so many bits, a power of two; a row for each digest."""
    words = np.frombuffer(b"".join(bytes(v) for v in values), "<u4").reshape(-1, PROBES)
    return words & np.uint32(bits - 1)


def _filter(values) -> bytes:
    bits = 1 << max(10, math.ceil(math.log2(max(1, len(values)) * BITS_PER_KEY)))
    out = np.zeros(bits, bool)
    out[_probes(values, bits).ravel()] = True
    return np.packbits(out, bitorder="little").tobytes()


def _may_have(bits: bytes, values) -> np.ndarray:
    held = np.frombuffer(bits, np.uint8)
    places = _probes(values, 8 * len(held))
    return ((held[places >> 3] >> (places & 7)) & 1).all(1)


@dataclass(frozen=True)
class KeyIndex:
    """An index of the column ``key`` of the Parquet folder ``table``, in the folder ``root``."""

    spark: SparkSession
    root: str
    table: str
    key: str
    segments: int = 64

    def _path(self, name: str) -> str:
        return posixpath.join(self.root, name)

    def _stored(self) -> set[str]:
        """The files of the table. Its rows and footers aren't read."""
        try:
            return set(self.spark.read.schema(f"`{self.key}` string").parquet(self.table).inputFiles())
        except AnalysisException as error:
            if is_absent(error):
                return set()
            raise

    def _listed(self) -> dict[str, set[str]]:
        """The files of each part."""
        if not exists(self.spark, self._path("files")):
            return {}
        rows = self.spark.read.schema("part string, files array<string>").parquet(self._path("files")).collect()
        return {r["part"]: set(r["files"]) for r in rows}

    def _parts(self, parts: list[str], *columns: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], _PARTS).select(*columns)
        stored = self.spark.read.schema(_PARTS).parquet(self._path("parts"))
        return stored.where(F.col("part").isin(*parts)).select(*columns)

    def refresh(self) -> list[str]:
        """Bring the index up to the table's files; returns the parts that count."""
        stored, listed = self._stored(), self._listed()
        valid = {part: files for part, files in listed.items() if files <= stored}
        new = sorted(stored - set().union(*valid.values()))
        if new:
            part = uuid.uuid4().hex
            keys = self.spark.read.schema(f"`{self.key}` string").parquet(*new)
            self._write(part, keys)
            # A part counts from the moment its files are listed, after its rows are written.
            row = self.spark.createDataFrame([(part, new)], "part string, files array<string>")
            row.coalesce(1).write.mode("append").parquet(self._path("files"))
            valid[part] = set(new)
        return sorted(valid)

    def _write(self, part: str, keys: DataFrame) -> None:
        known = keys.select(digest(F.col(self.key)).alias("digest")).where(F.col("digest").isNotNull()).distinct()

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            values = np.sort(_digests(rows["digest"]))
            raw = values.tobytes()
            each = [raw[i:i + DIGEST] for i in range(0, len(raw), DIGEST)]
            return pd.DataFrame([{
                "part": part, "segment": rows["segment"].iloc[0], "n": len(values), "bits": _filter(each), "digests": raw,
            }])

        built = known.withColumn("segment", self._segment()).groupBy("segment").applyInPandas(build, _PARTS)
        built.write.partitionBy("part").mode("append").parquet(self._path("parts"))

    def _segment(self) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.segments)).cast("int")

    def known(self, keys: DataFrame) -> DataFrame:
        """The values of the column ``key`` of ``keys``, one row each, that the table has."""
        parts = self.refresh()
        asked = keys.select(F.col(self.key).alias("key")).where(F.col("key").isNotNull()).distinct().withColumn(
            "digest", digest(F.col("key"))).withColumn("segment", self._segment())
        kind = dict(asked.dtypes)["key"]
        if not parts:
            return asked.select(F.col("key").alias(self.key)).limit(0)

        def possible(own: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            found = [
                own.assign(part=part)[_may_have(bits, own["digest"])]
                for part, bits in zip(filters["part"], filters["bits"]) if len(own)
            ]
            return pd.concat(found)[columns] if found else pd.DataFrame(columns=columns)

        columns = ["part", "segment", "key", "digest"]
        filters = self._parts(parts, "part", "segment", "bits")
        maybe = asked.groupBy("segment").cogroup(filters.groupBy("segment")).applyInPandas(
            possible, f"part string, segment int, key {kind}, digest binary").persist()
        try:
            named = maybe.select("part", "segment").distinct()
            wanted = [r["part"] for r in named.select("part").distinct().collect()]
            if not wanted:
                return asked.select(F.col("key").alias(self.key)).limit(0)
            held = self._parts(wanted, "part", "segment", "digests").join(
                F.broadcast(named) if fits_broadcast(named) else named, ["part", "segment"], "left_semi")

            def settled(own: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
                if not len(own) or not len(stored):
                    return own[["key"]].iloc[:0]
                values = np.frombuffer(bytes(stored["digests"].iloc[0]), f"S{DIGEST}")
                mine = _digests(own["digest"])
                at = np.minimum(np.searchsorted(values, mine), len(values) - 1)
                return own[["key"]][values[at] == mine]

            where = ["part", "segment"]
            found = maybe.groupBy(*where).cogroup(held.groupBy(*where)).applyInPandas(settled, f"key {kind}").distinct()
            rows = found.select(F.col("key").alias(self.key)).persist()
            rows.count()
            return rows
        finally:
            maybe.unpersist()

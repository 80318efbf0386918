"""Operator 3, sharding: sampled splitters.

Every row has a size and a place in one order: the hash of its text, then one of its id and its own number, so equal
texts lie together and no two rows, not even repeated ones, have one key. Keys are
drawn with a chance that is proportional to their size; quantiles of the draws split the order into ranges of near equal
bytes. Ranges are measured, and those over ``overfull`` times their share are split again by draws from inside them; a
text that fills a range by its copies is split by rows. With the exact bytes before each range, a running sum inside it
gives the exact bytes before each row, and these decide the shard. Law: ``bytes``.

A group of equal texts stays whole if it is light, at most ``whole`` of a shard; heavier groups are cut by rows. A shard
therefore differs from an equal share by about half of the largest unit at each of its two ends.

Texts never shuffle, only ids, sizes and checksums. Draws and ranges come to the driver: their number follows from
``rows_per_range`` and the row count, 16 draws of 16 bytes for each range.

Defined results: null texts have size 8 and checksum 0, as empty ones do; repeated rows, of one id and one text, are copies
like any other; fewer rows than shards leave shards empty; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import DRAWS, draw, pinned, text_size

#: Each row costs its text and this many bytes.
ROW_BYTES = 8
DRAWS_PER_RANGE = 16
LOWEST = -(1 << 63)


def sized(documents: DataFrame) -> DataFrame:
    """A light row per document: id, size, checksum, and its two-part key. To be written once, as rows are numbered."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (text_size(text) + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"),
        F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("minor"),
    )


def drawn(rows: DataFrame, per_byte: float, seed: int) -> np.ndarray:
    """Keys drawn with the chance size * per_byte, sorted; shape (n, 2)."""
    chance = F.least(F.col("size") * F.lit(per_byte), F.lit(1.0))
    hit = rows.where(draw("key", "minor", seed=seed) < chance * DRAWS).select("key", "minor").toPandas()
    return hit.sort_values(["key", "minor"]).to_numpy(np.int64).reshape(-1, 2)


def quantiles(keys: np.ndarray, parts: int, heavy: float = 0.5) -> list[tuple[int, int]]:
    """Lower bounds of the ranges after the first.

    A bound lies before the first row of its text, so that the text stays in one range, unless the text holds more than
    ``heavy`` of a range.
    """
    if not len(keys):
        return []
    bounds = []
    for key, minor in keys[np.arange(1, parts) * len(keys) // parts].tolist():
        first, last = np.searchsorted(keys[:, 0], [key, key + 1] if key < (1 << 63) - 1 else [key, key], "left")
        bounds.append((key, minor) if (last - first) * parts > heavy * len(keys) else (key, LOWEST))
    return sorted(set(bounds))


def ranged(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """``rows`` with the number of the range that holds their key."""
    split = np.array(bounds, np.int64).reshape(-1, 2)
    major, minor = split[:, 0].copy(), split[:, 1].copy()

    @F.pandas_udf("int")
    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for key, low in parts:
            key, low = key.to_numpy(np.int64), low.to_numpy(np.int64)
            first, last = np.searchsorted(major, key, "left"), np.searchsorted(major, key, "right")
            out = first.copy()
            for i in np.flatnonzero(last > first):
                out[i] += np.searchsorted(minor[first[i]:last[i]], low[i], "right")
            yield pd.Series(out.astype(np.int32))

    return rows.withColumn("range", place("key", "minor"))


def measured(rows: DataFrame) -> pd.DataFrame:
    """Bytes and rows of each range that has any."""
    return rows.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n")).toPandas().sort_values("range")


def splitters(rows: DataFrame, total: int, ranges: int, overfull: float, rounds: int = 4) -> list[tuple[int, int]]:
    """Bounds of ranges none of which holds over ``overfull`` times its share, where keys allow it."""
    per_byte = DRAWS_PER_RANGE * ranges / max(total, 1)
    bounds = quantiles(drawn(rows, per_byte, seed=3), ranges)
    for attempt in range(rounds):
        placed = ranged(rows, bounds)
        full = measured(placed)
        full = full[full["size"] > overfull * total / ranges]
        if full.empty:
            break
        inside = placed.join(F.broadcast(rows.sparkSession.createDataFrame(full[["range"]], "range int")), "range", "left_semi")
        keys = drawn(inside, per_byte, seed=4 + attempt)
        edges = np.array([(LOWEST, LOWEST), *bounds], dtype=object)
        more: set[tuple[int, int]] = set()
        for number, size in zip(full["range"], full["size"]):
            low = tuple(edges[number])
            high = tuple(edges[number + 1]) if number + 1 < len(edges) else None
            own = np.array([k for k in map(tuple, keys.tolist()) if k >= low and (high is None or k < high)], np.int64)
            more.update(quantiles(own.reshape(-1, 2), max(2, int(2 * size * ranges // total))))
        if more <= set(bounds):
            break
        bounds = sorted({*bounds, *more})
    return bounds


def shard(
    documents: DataFrame, shards: int = 24, *, rows_per_range: int = 100_000, least_ranges: int = 960,
    overfull: float = 2.0, whole: float = 0.005,
) -> DataFrame:
    """Each document with its shard and its slot there."""
    rows = pinned(sized(documents))
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(least_ranges, count // rows_per_range)
    rows = ranged(rows, splitters(rows, total, ranges, overfull))
    sums = measured(rows)
    sums["bytes_before"] = sums["size"].cumsum() - sums["size"]
    sums["rows_before"] = sums["n"].cumsum() - sums["n"]
    before = rows.sparkSession.createDataFrame(
        sums[["range", "bytes_before", "rows_before"]], "range int, bytes_before long, rows_before long"
    )
    order = Window.partitionBy("range").orderBy("key", "minor", "text_crc32")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("range", "key")
    met = rows.join(F.broadcast(before), "range").select(
        "*",
        (F.sum("size").over(up_to) - F.col("size") + F.col("bytes_before")).alias("own_start"),
        (F.row_number().over(order) - 1 + F.col("rows_before")).alias("place"),
    ).select(
        "*", F.sum("size").over(group).alias("group_size"), F.min("own_start").over(group).alias("group_start"),
    )
    light = F.col("group_size") <= F.lit(whole * total / shards)
    # The middle of a unit decides, so half of the largest unit is the most that a shard's end is off.
    middle = F.when(light, F.col("group_start") + F.col("group_size") / 2).otherwise(F.col("own_start") + F.col("size") / 2)
    number = F.least(F.floor(middle * F.lit(shards) / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int")
    placed = pinned(met.select("doc_id", "size", "text_crc32", "place", number.alias("shard")))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import posixpath
import sys
import types
import uuid
from collections.abc import Callable, Hashable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opinionmill.session import shared_folder

#: Uniform draws are made in this many steps.
DRAWS = 1 << 30


def own_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, under the application's id."""
    return posixpath.join(shared_folder(spark, "llm"), spark.sparkContext.applicationId, uuid.uuid4().hex)


def pinned(df: DataFrame, **options) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    It cuts the lineage, keeps what several later steps read from being computed again, and outlives lost executors.
    Options are those of the writer. The tables of a run lie under the application's id, to be deleted when it has ended.
    """
    spark = df.sparkSession
    path = own_folder(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def draw(*keys: Column | str, seed: int) -> Column:
    """A uniform draw in [0, DRAWS) that depends on the keys alone, so that a repeated task draws the same."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(DRAWS))


def sampled(df: DataFrame, key: str, expected: int, total: int, seed: int) -> DataFrame:
    """About ``expected`` of ``total`` rows, chosen by the hash of a key that few rows share."""
    rate = min(1.0, expected / max(total, 1))
    return df if rate >= 1 else df.where(draw(key, seed=seed) < int(rate * DRAWS))


def distinct_sample(rows: DataFrame, text: str, expected: int, seed: int, by: str | None = None) -> DataFrame:
    """About ``expected`` different rows, for each value of ``by`` where it is named.

    A row is drawn by the hash of all its columns, so repeated rows, null ids or many rows of an id don't add to it.
    Copies are put together in each task before they shuffle.
    """
    others = [c for c in rows.columns if c != text]
    row = F.xxhash64(*(F.col(c) for c in rows.columns))
    counted = rows.groupBy(*[by] if by else []).agg(F.approx_count_distinct(row, 0.02).alias("n")).collect()
    rate = F.lit(0)
    for found in counted:
        own = int(min(1.0, expected / max(found["n"], 1)) * DRAWS)
        rate = F.when(F.col(by) == found[by], own).otherwise(rate) if by else F.lit(own)
    chosen = rows.where(draw(*rows.columns, seed=seed) < rate)
    return chosen.groupBy(*others, F.xxhash64(text).alias(fresh(rows, "_print"))).agg(F.min(text).alias(text)).select(rows.columns)


def text_size(text: Column) -> Column:
    """UTF-8 bytes; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def texts_of(column) -> list[str]:
    """Python strings of an Arrow column, null as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def batch(schema, columns: list) -> pa.RecordBatch:
    """A record batch of an Arrow schema from one sequence per column."""
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def spaced(parts: list, most: int) -> list:
    """At most ``most`` of the parts, evenly spaced from the first."""
    return parts[::max(1, -(-len(parts) // most))]


def kept_in_worker(name: Hashable, make: Callable[[], object]):
    """What ``make`` gave for this name to an earlier task of the same Python worker, else what it gives now.

    Workers outlive tasks, but the functions that a task brings along don't, so it lies in a module of its own.
    """
    held = sys.modules.setdefault("_kept_in_worker", types.ModuleType("_kept_in_worker")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]

"""Helpers of the two vector searches: classes of equal vectors, and the cut of classes and queries into cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import pinned


def usable(vec: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, odd)


def vectors(embeddings: DataFrame, take: Column | None = None) -> DataFrame:
    """(vec_id, vec) of the rows with an id and a usable vector, of the length that most rows have.

    Of lengths that are equally frequent the larger counts. Vectors of other lengths have no distance to the rest.
    """
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    if take is not None:
        rows = rows.where(take)
    most = rows.groupBy(F.size("vec").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    return rows.where(F.size("vec") == (most["length"] if most else 0))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """(class_id, vec, first, ids): each distinct vector with its ``keep`` smallest ids and the first of them.

    No answer can need more copies of a vector than that. A vector that many rows share sends few rows from each task.
    The class's own id has no meaning; it holds as the classes are written once.
    """
    rank = F.dense_rank().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = rows.withColumn("_rank", rank).where(F.col("_rank") <= keep)
    made = few.groupBy("vec").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    return pinned(made.select(F.monotonically_increasing_id().alias("class_id"), "vec", F.element_at("ids", 1).alias("first"), "ids"))


def asked(rows: DataFrame, every: int, made: DataFrame) -> DataFrame:
    """(query_id, class_id) of the rows whose id is divisible by ``every``."""
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vec").distinct()
    return pinned(queries.join(made.select("vec", "class_id"), "vec").select("query_id", "class_id"))


def block(key: str, blocks: Column | int) -> Column:
    """A block number from 0 for a key."""
    return F.pmod(F.xxhash64(key), F.lit(blocks) if isinstance(blocks, int) else blocks).cast("int")


def every_block(blocks: Column | int) -> Column:
    return F.explode(F.sequence(F.lit(0), (F.lit(blocks) if isinstance(blocks, int) else blocks).cast("int") - 1))


def matrix(column: pd.Series, kind=np.float64) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(kind)


def answers(found: DataFrame, made: DataFrame, queries: DataFrame, k: int, best_first: Column, score: str) -> DataFrame:
    """Each query's ``k`` best rows from the classes found for its class, the row itself left out.

    ``found`` has (query_class, class_id, first, value); ``best_first`` is a number to sort by, the smallest first.
    """
    order = Window.partitionBy("query_class").orderBy(best_first, "first", "class_id")
    few = found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k + 1).drop("_rank", "first")
    named = few.join(made.select("class_id", "ids"), "class_id")
    members = named.select("query_class", "value", best_first.alias("by"), F.explode("ids").alias("vec_id"), "class_id")
    lists = members.groupBy("query_class").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("by", "vec_id", "value", "class_id"))), 1, k + 1).alias("best")
    )
    own = lambda x: (x["vec_id"] == F.col("query_id")) & (x["class_id"] == F.col("query_class"))
    met = queries.join(lists, queries["class_id"] == lists["query_class"]).select(
        "query_id", F.slice(F.filter("best", lambda x: ~own(x)), 1, k).alias("best")
    )
    return met.select("query_id", F.posexplode("best").alias("_rank", "_best")).select(
        "query_id", (F.col("_rank") + 1).alias("rank"), F.col("_best.vec_id").alias("vec_id"), F.col("_best.value").alias(score)
    )


def best_rows(values: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's ``k`` smallest values, ties to the earlier column, smallest first."""
    return np.argsort(values, axis=1, kind="stable")[:, :k]

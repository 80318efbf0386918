"""Operator 4, approximate nearest neighbours: adaptive dimension scan.

Every distinct vector belongs to the list of its nearest centre, and a query probes the lists of its nearest centres.
Inside a list vectors are compared after a random rotation, column block by column block. After each block the partial
distance over d of D columns is an estimate of the whole one; a candidate is abandoned as soon as a hypothesis test says
that its whole distance exceeds the query's current k-th best: partial > threshold * (d / D) * (1 + EPSILON / sqrt(d))^2
for squared distances. What survives all blocks gets its exact distance from the original vectors.

The index is fitted on a bounded sample, ``PER_LIST`` vectors a list for at most ``MOST_LISTS`` lists, chosen by the
hash of their id; every vector is indexed. The sample also sets how many lists to probe: as many as hold ``RECALL`` of
the sample's own true neighbours.

Lists and the queries that probe them are cut into blocks of bounded size; a task sees one block of either. Equal
vectors are one entry with its smallest ids, so a vector that many rows share costs no more than another.

Defined results: rows without an id, and vectors null, empty, zero, of an odd length or with a null or non-finite
component take no part; rows that share id and vector are one; a query finds every row but itself; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import pinned, sampled
from .vectors import answers, asked, best_rows, block, classes, every_block, matrix, vectors

K = 10
PER_LIST = 32
MOST_LISTS = 1_024
RECALL = 0.97
EPSILON = 2.1
COLUMNS = 16
#: Vectors and queries of a block, and of a step inside it.
BLOCK = 4_096
QUERY_BLOCK = 1_024
STEP = 512
QUERY_STEP = 128


def rotation(length: int, seed: int = 41) -> np.ndarray:
    """A random orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(length, length)))[0]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def centres(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """k-means over the sample."""
    rng = np.random.default_rng(seed)
    made = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        nearest = squared(sample, made).argmin(1)
        sizes = np.bincount(nearest, minlength=len(made))
        sums = np.zeros_like(made)
        np.add.at(sums, nearest, sample)
        made[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return made


def probes(sample: np.ndarray, made: np.ndarray, recall: float, queries: int = 256) -> int:
    """Lists to probe so that the sample's own neighbours are found with the given recall."""
    if len(sample) < 3:
        return len(made)
    distance = squared(sample[:queries], sample)
    distance[np.arange(len(distance)), np.arange(len(distance))] = np.inf
    true = best_rows(distance, min(K, len(sample) - 1))
    home = squared(sample, made).argmin(1)
    order = np.argsort(squared(sample[:queries], made), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(made))[None, :], 1)
    needed = np.take_along_axis(place, home[true], 1).ravel()
    return min(len(made), int(np.quantile(needed, recall, method="higher")) + 1)


def scan(queries: np.ndarray, base: np.ndarray, turn: np.ndarray, k: int):
    """Each query's ``k`` nearest of a block, by adaptive scan: squared distances and numbers of the rows.

    Ties go to the row that comes first. A query's own row is not left out; the caller asks for one more.
    """
    turned_base, turned = base @ turn, queries @ turn
    length = base.shape[1]
    cuts = [*range(0, length, COLUMNS), length]
    best = np.full((len(queries), k), np.inf)
    which = np.full((len(queries), k), -1)
    for start in range(0, len(base), STEP):
        part = slice(start, min(start + STEP, len(base)))
        for first in range(0, len(queries), QUERY_STEP):
            rows = slice(first, min(first + QUERY_STEP, len(queries)))
            limit = best[rows, -1]
            if np.isinf(limit).any():
                i, j = (x.ravel() for x in np.indices((rows.stop - rows.start, part.stop - part.start)))
            else:
                # The first block of columns for all pairs, the others for those that are left.
                partial = squared(turned[rows, :cuts[1]], turned_base[part, :cuts[1]])
                i, j = np.nonzero(partial <= bound(limit, cuts[1], length)[:, None])
                partial = partial[i, j]
                for low, high in zip(cuts[1:], cuts[2:]):
                    gap = turned[rows, low:high][i] - turned_base[part, low:high][j]
                    partial = partial + np.einsum("pc,pc->p", gap, gap)
                    left = partial <= bound(limit, high, length)[i]
                    i, j, partial = i[left], j[left], partial[left]
            gap = queries[rows][i] - base[part][j]
            exact = np.full((rows.stop - rows.start, part.stop - part.start), np.inf)
            exact[i, j] = (gap * gap).sum(1)
            both = np.concatenate([best[rows], exact], axis=1)
            numbers = np.concatenate([which[rows], np.broadcast_to(np.arange(part.start, part.stop), exact.shape)], axis=1)
            order = best_rows(both, k)
            best[rows] = np.take_along_axis(both, order, 1)
            which[rows] = np.take_along_axis(numbers, order, 1)
    return best, which


def bound(limit: np.ndarray, columns: int, length: int) -> np.ndarray:
    """The partial squared distance above which the whole one exceeds the limit, by the test."""
    if columns >= length:
        return limit * (1 + 1e-9)
    return limit * (columns / length) * (1 + EPSILON / np.sqrt(columns)) ** 2


def search(embeddings: DataFrame, every: int = 100, k: int = K, recall: float = RECALL) -> DataFrame:
    """The ``k`` nearest found of each row whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = pinned(vectors(embeddings, F.exists("vec", lambda x: x != 0)))
    made = classes(rows, k + 1)
    queries = asked(rows, every, made)
    count = made.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = int(min(MOST_LISTS, max(1, round(count**0.5))))
    sample = sampled(made, "first", lists * PER_LIST, count, seed=43).select("first", "vec").toPandas()
    if not len(sample):
        sample = made.orderBy("first").select("first", "vec").limit(1).toPandas()
    points = matrix(sample.sort_values("first", kind="stable")["vec"])
    middles = centres(points, lists)
    probed = probes(points, middles, recall)
    turn = rotation(points.shape[1])

    @F.pandas_udf("array<int>")
    def nearest(vec: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype=object)
        order = np.argsort(squared(matrix(vec), middles), axis=1, kind="stable")[:, :probed]
        return pd.Series(list(order.astype(np.int32)))

    index = made.select("class_id", "first", "vec", F.element_at(nearest("vec"), 1).alias("list"))
    probing = queries.select(F.col("class_id").alias("query_class")).distinct().join(
        made.select(F.col("class_id").alias("query_class"), F.col("vec").alias("asked")), "query_class"
    ).select("query_class", "asked", F.explode(nearest("asked")).alias("list"))
    sizes = index.groupBy("list").agg(F.count("*").alias("n")).join(
        probing.groupBy("list").agg(F.count("*").alias("queries")), "list"
    ).select("list", F.ceil(F.col("n") / BLOCK).alias("parts"), F.ceil(F.col("queries") / QUERY_BLOCK).alias("crowds"))
    sizes = F.broadcast(pinned(sizes))  # a row for each of at most MOST_LISTS lists
    base_cells = index.join(sizes, "list").select(
        "list", block("class_id", F.col("parts")).alias("part"), every_block(F.col("crowds")).alias("crowd"), "class_id", "first", "vec"
    )
    query_cells = probing.join(sizes, "list").select(
        "list", "parts", block("query_class", F.col("crowds")).alias("crowd"), "query_class", "asked"
    ).select("list", every_block(F.col("parts")).alias("part"), "crowd", "query_class", "asked")

    def compare(base: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(base) or not len(asking):
            return pd.DataFrame({"query_class": [], "class_id": [], "first": [], "value": []})
        base = base.sort_values(["first", "class_id"])
        names, own = base["class_id"].to_numpy(), asking["query_class"].to_numpy()
        best, which = scan(matrix(asking["asked"]), matrix(base["vec"]), turn, k + 1)
        i, j = np.nonzero(which >= 0)
        found = which[i, j]
        return pd.DataFrame({
            "query_class": own[i], "class_id": names[found], "first": base["first"].to_numpy()[found], "value": np.sqrt(best[i, j])
        })

    cell = ["list", "part", "crowd"]
    found = base_cells.groupBy(cell).cogroup(query_cells.groupBy(cell)).applyInPandas(
        compare, "query_class long, class_id long, first long, value double"
    )
    return answers(found, made, queries, k, F.col("value"), "score")

"""Operator 7, exact top-k search: multi-resolution segment statistics.

Vectors are cut into segments, and of each segment the mean m and the deviation s are kept. Over segments of L columns
sum(L * ((mq - mv)^2 + (sq - sv)^2)) never exceeds the squared distance of two vectors, so their inner product, which is
(|q|^2 + |v|^2 - distance) / 2, never exceeds what follows from that lower bound. Bounds are taken coarse to fine, with
ever shorter segments: pairs whose bound falls short of the query's threshold are dropped, and survivors get their exact
integer score. The threshold is the query's k-th best score so far, at first within a bounded sample of the vectors.
Nothing is approximate.

All blocks of queries meet all blocks of vectors; a task sees one block of either. Equal vectors are one entry with its
smallest ids, so a vector that many rows share costs no more than another.

Defined results: rows without an id, and vectors null, empty, of an odd length or with a null or non-finite component
take no part; rows that share id and vector are one; a query finds every row but itself; scores have to fit a long; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import pinned, sampled
from .vectors import answers, asked, best_rows, block, classes, every_block, matrix, vectors

K = 20
SCALE = 64
#: Columns of a segment, coarse to fine.
SEGMENTS = (16, 8, 4, 2)
#: Vectors that set the first thresholds.
SAMPLE = 2_048
BLOCK = 4_096
QUERY_BLOCK = 4_096
QUERY_STEP = 128
STEP = 1_024
#: Integers up to this are exact in double precision.
EXACT = 2.0**53


def widened(x: np.ndarray) -> np.ndarray:
    """Zero columns added until the longest segments fit; they change no product."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % SEGMENTS[0])))


def statistics(x: np.ndarray, columns: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the segment's length."""
    parts = x.reshape(len(x), -1, columns)
    return np.concatenate([parts.mean(2), parts.std(2)], axis=1) * np.sqrt(columns)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if largest < EXACT else a @ b.T


def kth(scores: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th largest, the smallest long where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), np.iinfo(np.int64).min)
    return -np.partition(-scores, k - 1, axis=1)[:, k - 1]


def survivors(queries: np.ndarray, base: np.ndarray, asks: list[np.ndarray], has: list[np.ndarray], least: np.ndarray):
    """Pairs (query, vector) whose bounds reach the query's threshold at every resolution.

    ``asks`` and ``has`` hold the statistics by resolution. The lower bound on the squared distance is the squared
    distance of the statistics themselves.
    """
    norms = (queries * queries).sum(1)[:, None] + (base * base).sum(1)[None, :]
    # Rounding must not drop a pair whose bound is just reached.
    slack = 1e-9 * (norms + 1)
    most = norms - 2.0 * least[:, None] + slack
    left = None
    for a, b in zip(asks, has):
        if left is None or len(left[0]) > 0.2 * norms.size:
            gap = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
            ok = gap <= most
            if left is not None:
                before = np.zeros_like(ok)
                before[left] = True
                ok &= before
            left = np.nonzero(ok)
        else:
            i, j = left
            gap = np.empty(len(i))
            for p in range(0, len(i), 100_000):
                part = slice(p, p + 100_000)
                gap[part] = ((a[i[part]] - b[j[part]]) ** 2).sum(1)
            ok = gap <= most[i, j]
            left = i[ok], j[ok]
    return left


def top(queries: np.ndarray, own: np.ndarray, base: np.ndarray, sample: np.ndarray, sampled_names: np.ndarray, k: int):
    """(query, row of the block, score) of each query's best ``k`` classes in a block, its own class beside them.

    Ties go to the row that comes first.
    """
    lowest = np.iinfo(np.int64).min
    real, asks = queries.astype(float), [statistics(queries.astype(float), c) for c in SEGMENTS]
    all_has = [statistics(base.astype(float), c) for c in SEGMENTS]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for first in range(0, len(queries), QUERY_STEP):
        rows = slice(first, min(first + QUERY_STEP, len(queries)))
        seen = products(queries[rows], sample)
        seen[own[rows][:, None] == sampled_names[None, :]] = lowest + 1
        least = kth(seen, k)
        best = np.full((rows.stop - rows.start, k + 1), lowest)
        which = np.full(best.shape, -1)
        for start in range(0, len(base), STEP):
            part = slice(start, min(start + STEP, len(base)))
            i, j = survivors(
                real[rows], base[part].astype(float), [a[rows] for a in asks], [b[part] for b in all_has], np.maximum(least, -(2.0**60))
            )
            scores = np.full((rows.stop - rows.start, part.stop - part.start), lowest)
            if len(i) > 0.1 * scores.size:
                scores[i, j] = products(queries[rows], base[part])[i, j]
            else:
                for p in range(0, len(i), 100_000):
                    a, b = i[p:p + 100_000], j[p:p + 100_000]
                    scores[a, b] = (queries[rows][a] * base[part][b]).sum(1)
            both = np.concatenate([best, scores], axis=1)
            numbers = np.concatenate([which, np.broadcast_to(np.arange(part.start, part.stop), scores.shape)], axis=1)
            numbers = np.where(both == lowest, -1, numbers)
            order = best_rows(-np.maximum(both, lowest + 1), k + 1)
            best = np.take_along_axis(both, order, 1)
            which = np.take_along_axis(numbers, order, 1)
            # One of the k + 1 may be the query's own class, so the last of them bounds the k-th of the others.
            least = np.maximum(least, best[:, -1])
        i, j = np.nonzero(which >= 0)
        out.append((own[rows][i], which[i, j], best[i, j]))
    return [np.concatenate(c) for c in zip(*out)]


def search(embeddings: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """The ``k`` highest scores of each row whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = vectors(embeddings)
    rows = pinned(rows.select("vec_id", F.transform("vec", lambda x: F.floor(x * SCALE).cast("long")).alias("vec")))
    made = classes(rows, k + 1)
    queries = asked(rows, every, made)
    count = made.count()
    asking = pinned(
        queries.select(F.col("class_id").alias("query_class")).distinct()
        .join(made.select(F.col("class_id").alias("query_class"), "vec"), "query_class")
    )
    crowds = -(-asking.count() // QUERY_BLOCK)
    if not count or not crowds:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    some = sampled(made, "first", SAMPLE, count, seed=71).select("class_id", "vec").toPandas()
    some_names = some["class_id"].to_numpy(np.int64)
    some_rows = widened(matrix(some["vec"], np.int64)) if len(some) else None
    parts = -(-count // BLOCK)
    base_cells = made.select(block("class_id", parts).alias("part"), every_block(crowds).alias("crowd"), "class_id", "first", "vec")
    query_cells = asking.select(every_block(parts).alias("part"), block("query_class", crowds).alias("crowd"), "query_class", "vec")

    def compare(base: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        if not len(base) or not len(asked_):
            return pd.DataFrame({"query_class": [], "class_id": [], "first": [], "value": []})
        base = base.sort_values(["first", "class_id"])
        q, v = widened(matrix(asked_["vec"], np.int64)), widened(matrix(base["vec"], np.int64))
        sample = v[:0] if some_rows is None else some_rows
        own, found, scores = top(
            q, asked_["query_class"].to_numpy(), v, sample, some_names, k
        )
        named = base[["class_id", "first"]].iloc[found].reset_index(drop=True)
        return pd.DataFrame({"query_class": own, "class_id": named["class_id"], "first": named["first"], "value": scores})

    cell = ["part", "crowd"]
    found = base_cells.groupBy(cell).cogroup(query_cells.groupBy(cell)).applyInPandas(
        compare, "query_class long, class_id long, first long, value long"
    )
    return answers(found, made, queries, k, -F.col("value"), "score")

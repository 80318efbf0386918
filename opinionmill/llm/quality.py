"""Operator 2, quality classifier: compression.

One zstandard dictionary is built from good text and one from bad text. A text compresses better with the dictionary of
the texts it resembles, so the normalised difference of its two compressed sizes tells them apart. The text is
compressed in blocks, as else a long text would teach the compressor more than the dictionary does; the whole text
counts. A logistic model, fitted on measurements with dictionaries that a text is not in, turns them into a calibrated
score.

Fitting uses a bounded sample, about ``PER_CLASS`` labelled rows of each class chosen by the hash of their id and, where
ids have many texts, of the text too; repeated rows are one. Each gives at most ``BLOCKS_PER_TEXT`` blocks to the dictionaries. For the calibration the sample is halved, and the whole texts of
either half are measured with dictionaries of the other; only the measurements come to the driver. Scoring is a narrow
step over all documents.

Defined results: null text counts as empty, and empty texts are scored as such; a label other than 0 and 1 is no label;
of differing labels for an id the larger counts; repeated rows teach once and are scored each; where a class has no labelled text the score is the share of label 1,
or 0.5 without any; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import DRAWS, batch, distinct_sample, draw, fresh, pinned, spaced, texts_of

#: Labelled documents of each class that the model may learn from.
PER_CLASS = 4_000
#: Characters that are compressed at a time.
BLOCK = 1_024
BLOCKS_PER_TEXT = 6
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
#: Weight of the pull of the calibration towards zero.
RIDGE = 0.01


@dataclass
class Model:
    """Dictionaries of the good and the bad texts, and the calibration of what they measure."""

    good: bytes
    bad: bytes
    weights: np.ndarray
    middle: np.ndarray
    spread: np.ndarray
    prior: float

    def calibrated(self, measured: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(measured), self.prior)
        scaled = (measured - self.middle) / self.spread
        line = self.weights[0] + scaled @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(line, -500, 500)))


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def blocks(text: str) -> list[bytes]:
    """All of a text, BLOCK characters at a time."""
    return [text[i:i + BLOCK].encode("utf-8", "replace") for i in range(0, max(len(text), 1), BLOCK)]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def meter(good: bytes, bad: bytes):
    """A function from a text to its measurements.

    These are the normalised difference of the compressed sizes over the text, the largest one of a block, and the
    compressed size per byte with the good dictionary and of the whole text with none, which repetition lowers.
    """
    plain = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}

    def compressor(content: bytes):
        if not content:
            return zstandard.ZstdCompressor(**plain)
        ready = zstandard.ZstdCompressionDict(content)
        ready.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=ready, **plain)

    with_good, with_bad, alone = compressor(good), compressor(bad), compressor(b"")

    def measure(text: str) -> list[float]:
        parts = blocks(text)
        a = np.array([len(with_good.compress(p)) for p in parts])
        b = np.array([len(with_bad.compress(p)) for p in parts])
        size = sum(map(len, parts)) + 1
        whole = len(alone.compress(text.encode("utf-8", "replace")))
        return [(b.sum() - a.sum()) / (a.sum() + b.sum()), float(((a - b) / (a + b)).max()), a.sum() / size, whole / size]

    return measure


def calibration(measured: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of a logistic model by Newton's method, and the scaling of its inputs."""
    middle, spread = measured.mean(0), measured.std(0) + 1e-9
    x = np.c_[np.ones(len(measured)), (measured - middle) / spread]
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        curve = (x.T * (p * (1 - p))) @ x + RIDGE * np.eye(len(weights))
        weights = weights + np.linalg.solve(curve, x.T @ (labels - p) - RIDGE * weights)
    return weights, middle, spread


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from labelled documents outside the held-out fold."""
    spark = documents.sparkSession
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    )
    counts = {row["quality"]: row["n"] for row in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    rate = F.lit(0)
    for quality, n in counts.items():
        rate = F.when(F.col("quality") == quality, int(min(1.0, per_class / n) * DRAWS)).otherwise(rate)
    chosen = known.where(draw("doc_id", seed=11) < rate).select(
        F.col("doc_id").alias("_id"), "quality", (draw("doc_id", seed=12) < DRAWS // 2).cast("int").alias("half")
    )
    whole = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    met = documents.select("doc_id", whole).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    some = met.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "half", "text")
    # Ids were chosen by their number, so more than twice as many rows come only from ids with many texts.
    rows = pinned(distinct_sample(some, "text", 2 * per_class, seed=13, by="quality"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("half", pa.int32()), ("part", pa.binary())])
        for rows in batches:
            columns = [rows.column(c).to_pylist() for c in ("doc_id", "quality", "half")]
            out = [
                (i, q, half, part)
                for i, q, half, t in zip(*columns, texts_of(rows.column("text")))
                for part in spaced(blocks(t), BLOCKS_PER_TEXT)
            ]
            yield batch(schema, list(zip(*out)) if out else [[]] * 4)

    parts = rows.mapInArrow(sample, "doc_id long, quality int, half int, part binary").toPandas()
    parts = parts.sort_values(["doc_id", "part"])
    if not {0, 1} <= set(parts["quality"]):
        return Model(b"", b"", np.zeros(0), np.zeros(0), np.ones(0), prior)

    def dictionaries(of: pd.DataFrame) -> list[bytes]:
        return [dictionary([bytes(p) for p in of["part"][of["quality"] == q]]) for q in (1, 0)]

    good, bad = dictionaries(parts)
    found = [
        measure_texts(rows.where(F.col("half") == half), *dictionaries(parts[parts["half"] != half])).toPandas()
        for half in (0, 1) if {0, 1} <= set(parts["quality"][parts["half"] != half])
    ]
    measured = pd.concat(found) if found else pd.DataFrame({"quality": []})
    if not {0, 1} <= set(measured["quality"]):
        return Model(good, bad, np.zeros(0), np.zeros(0), np.ones(0), prior)
    measured = measured.sort_values(["doc_id", "quality"])
    inputs = np.array(measured["measured"].tolist(), float)
    weights, middle, spread = calibration(inputs, measured["quality"].to_numpy(float))
    return Model(good, bad, weights, middle, spread, prior)


def measure_texts(rows: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """The columns of ``rows`` but its text, with the text's measurements."""
    others = [c for c in rows.columns if c != "text"]

    @F.pandas_udf("array<double>")
    def measured(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        measure = meter(good, bad)
        for texts in parts:
            yield pd.Series([measure(t or "") for t in texts])

    return rows.select(*others, measured(F.col("text").cast("string")).alias("measured"))


def with_score(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``documents`` and the score of the whole text."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        measure = meter(model.good, model.bad)
        for texts in parts:
            yield pd.Series(model.calibrated(np.array([measure(t or "") for t in texts], float).reshape(-1, 4)))

    return documents.withColumn(name, score(F.col("text").cast("string")))


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and prediction of every document."""
    scored = with_score(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def kept(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    name = fresh(documents, "_quality")
    scored = with_score(documents, fit(documents, labels), name)
    return scored.where(F.col(name) >= 0.5).drop(name)

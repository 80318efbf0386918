"""Operator 8, language identification: a bidirectional gated recurrent network over bytes.

A text is read as its words, runs of bytes without white space, cut after ``UNIT`` bytes. Two gated recurrent layers
read a word's bytes forwards and backwards, and a softmax labels every position with the two states there. A document's
probabilities are the means over all its positions, so the whole text counts. The network is trained here in numpy by
backpropagation through time. As equal words get equal labels, each distinct word of a batch is labelled once.

Learning uses a bounded sample: ``PER_LANGUAGE`` documents of each language outside the held-out fold, chosen by the
hash of their id, and at most ``BLOCKS_PER_TEXT`` blocks of each. Prediction is a narrow step over all documents.

Defined results: null texts, and texts without a letter, are ``und`` with score 0; so is everything where nothing could
be learned; rows without a language teach nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import batch, distinct_sample, fresh, spaced, texts_of

#: Documents of each language that the network may learn from.
PER_LANGUAGE = 500
BLOCKS_PER_TEXT = 6
BLOCK = 1_024
#: Bytes that the network reads at a time.
UNIT = 24
STATES = 16
STEPS = 600
WORDS_PER_STEP = 512
RATE = 0.01
UNKNOWN = "und"


@dataclass
class Network:
    """Weights of both directions (input table, recurrence, its bias), of the output layer, and the languages' names."""

    forward: tuple[np.ndarray, np.ndarray, np.ndarray]
    backward: tuple[np.ndarray, np.ndarray, np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    names: list[str]

    def parameters(self) -> list[np.ndarray]:
        return [*self.forward, *self.backward, self.out, self.bias]


def new_network(names: list[str], states: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)

    def layer():
        return (
            rng.normal(0, 0.3, (256, 3 * states)).astype(np.float32),
            rng.normal(0, 1 / np.sqrt(states), (states, 3 * states)).astype(np.float32),
            np.zeros(3 * states, np.float32),
        )

    out = rng.normal(0, 0.1, (2 * states, len(names))).astype(np.float32)
    return Network(layer(), layer(), out, np.zeros(len(names), np.float32), names)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def read(layer, bytes_: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each position, shape (positions, words, states); ``keep`` gets what the way back needs."""
    table, recur, bias = layer
    n = recur.shape[0]
    state = np.zeros((bytes_.shape[0], n), np.float32)
    states = np.empty((bytes_.shape[1], *state.shape), np.float32)
    for t in range(bytes_.shape[1]):
        x = table[bytes_[:, t]]
        u = state @ recur + bias
        gates = sigmoid(x[:, :2 * n] + u[:, :2 * n])
        z, r = gates[:, :n], gates[:, n:]
        new = np.tanh(x[:, 2 * n:] + r * u[:, 2 * n:])
        if keep is not None:
            keep.append((state, z, r, new, u[:, 2 * n:]))
        state = new + z * (state - new)
        states[t] = state
    return states


def read_back(layer, bytes_: np.ndarray, keep: list, grad_states: np.ndarray) -> list[np.ndarray]:
    """Gradients of a layer's weights, by backpropagation through time."""
    table, recur, bias = layer
    g_table, g_recur, g_bias = (np.zeros_like(w) for w in layer)
    inputs = []
    carried = np.zeros_like(grad_states[0])
    n = recur.shape[0]
    for t in range(len(keep) - 1, -1, -1):
        before, z, r, new, inner = keep[t]
        g = grad_states[t] + carried
        g_new = g * (1 - z) * (1 - new * new)
        g_z = g * (before - new) * z * (1 - z)
        g_r = g_new * inner * r * (1 - r)
        g_u = np.concatenate([g_z, g_r, g_new * r], axis=1)
        inputs.append(np.concatenate([g_z, g_r, g_new], axis=1))
        g_recur += before.T @ g_u
        g_bias += g_u.sum(0)
        carried = g * z + g_u @ recur.T
    read_ = bytes_[:, ::-1].T.ravel()
    order = np.argsort(read_, kind="stable")
    values, first = np.unique(read_[order], return_index=True)
    g_table[values] = np.add.reduceat(np.concatenate(inputs)[order], first, axis=0)
    return [g_table, g_recur, g_bias]


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words forwards and backwards, each row padded at its end, and their lengths."""
    lengths = np.array([len(w) for w in words])
    longest = int(lengths.max())
    ahead = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(-1, longest)
    back = np.frombuffer(b"".join(w[::-1].ljust(longest, b"\0") for w in words), np.uint8).reshape(-1, longest)
    return ahead, back, lengths


def turned(lengths: np.ndarray, longest: int) -> np.ndarray:
    """For each position and word the place of that position in the word read backwards."""
    return np.maximum(lengths[None, :] - 1 - np.arange(longest)[:, None], 0)


def position_probabilities(network: Network, states: np.ndarray) -> np.ndarray:
    line = states @ network.out + network.bias
    line = np.exp(line - line.max(-1, keepdims=True))
    return line / line.sum(-1, keepdims=True)


def label_words(network: Network, words: list[bytes], size: int = 2_048) -> np.ndarray:
    """For each word the probabilities summed over its positions."""
    sums = np.zeros((len(words), len(network.names)), np.float32)
    order = np.argsort([len(w) for w in words], kind="stable")
    for i in range(0, len(words), size):
        part = order[i:i + size]
        ahead, back, lengths = padded([words[j] for j in part])
        place = turned(lengths, ahead.shape[1])
        first, last = read(network.forward, ahead), read(network.backward, back)
        last = last[place, np.arange(len(part))[None, :]]
        p = position_probabilities(network, np.concatenate([first, last], -1))
        p *= (np.arange(ahead.shape[1])[:, None] < lengths[None, :])[:, :, None]
        sums[part] = p.sum(0)
    return sums


def train(words: list[bytes], labels: np.ndarray, names: list[str], steps: int = STEPS, seed: int = 5) -> Network:
    """Minimise the cross entropy of every position's label, with Adam steps over random words."""
    network = new_network(names, STATES, seed)
    rng = np.random.default_rng(seed)
    weights = network.parameters()
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    by_length = np.argsort([len(w) for w in words], kind="stable")
    strip = min(len(words), WORDS_PER_STEP // 4)
    for step in range(steps):
        # Strips of words of near equal length, so that little is padding.
        part = np.concatenate([by_length[i:i + strip] for i in rng.integers(0, len(words) - strip + 1, 4)])
        ahead, back, lengths = padded([words[j] for j in part])
        longest, columns = ahead.shape[1], np.arange(len(part))[None, :]
        place = turned(lengths, longest)
        kept_ahead: list = []
        kept_back: list = []
        first, reversed_ = read(network.forward, ahead, kept_ahead), read(network.backward, back, kept_back)
        states = np.concatenate([first, reversed_[place, columns]], -1)
        p = position_probabilities(network, states)
        there = (np.arange(longest)[:, None] < lengths[None, :])[:, :, None]
        p[:, np.arange(len(part)), labels[part]] -= 1
        g = p * there / lengths.sum()
        g_out = np.einsum("tws,twl->sl", states, g)
        g_states = g @ network.out.T
        # Turning is its own inverse inside a word; what lies beyond a word is masked.
        g_back = (g_states[:, :, STATES:] * there)[place, columns] * there
        grads = [
            *read_back(network.forward, ahead, kept_ahead, g_states[:, :, :STATES] * there),
            *read_back(network.backward, back, kept_back, g_back), g_out, g.sum((0, 1)),
        ]
        rate = RATE * min(1.0, (step + 1) / 20) * (1 - step / steps)
        for w, g_, m, s in zip(weights, grads, mean, square):
            m += 0.1 * (g_ - m)
            s += 0.01 * (g_ * g_ - s)
            w -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(s / (1 - 0.99 ** (step + 1))) + 1e-8)
    return network


def units(text: str) -> list[bytes]:
    """All of a text as words of at most UNIT bytes."""
    words = text.encode("utf-8", "replace").split()
    if max(map(len, words), default=0) <= UNIT:
        return words
    return [w[i:i + UNIT] for w in words for i in range(0, len(w), UNIT)]


def held_out(doc_id: Column) -> Column:
    """The fold that no language is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Network | None:
    """Train on a bounded sample of the documents outside the held-out fold."""
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("part", pa.string())])
        for rows in batches:
            out = [
                (i, lang, part)
                for i, lang, t in zip(rows.column("doc_id").to_pylist(), rows.column("lang").to_pylist(), texts_of(rows.column("text")))
                for part in spaced([t[j:j + BLOCK] for j in range(0, max(len(t), 1), BLOCK)], BLOCKS_PER_TEXT)
            ]
            yield batch(schema, list(zip(*out)) if out else [[]] * 3)

    rows = known.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text"))
    chosen = distinct_sample(rows, "text", per_language, seed=21, by="lang")
    parts = chosen.mapInArrow(sample, "doc_id long, lang string, part string").toPandas().sort_values(["doc_id", "part"])
    if parts.empty:
        return None
    names = sorted(set(parts["lang"]))
    words, labels = [], []
    for name in names:
        own = [w for part in parts["part"][parts["lang"] == name] for w in units(part)]
        words.append(own)
        labels.append(name)
    # Each language teaches equally: its words are repeated or thinned to the same number.
    most = max(map(len, words))
    rng = np.random.default_rng(6)
    even = [[own[j] for j in rng.integers(0, len(own), most)] if own else [] for own in words]
    flat = [w for own in even for w in own]
    if not flat:
        return None
    return train(flat, np.repeat(np.arange(len(names)), [len(own) for own in even]), names)


def identified(documents: DataFrame, network: Network | None, name: str) -> DataFrame:
    """All columns of ``documents`` and a struct (lang, score) of the whole text."""

    @F.pandas_udf("lang string, score double")
    def identify(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield label_texts(network, [t or "" for t in texts])

    return documents.withColumn(name, identify(F.col("text").cast("string")))


def label_texts(network: Network | None, texts: list[str]) -> pd.DataFrame:
    """Language and score of each text."""
    lettered = [any(c.isalpha() for c in t) for t in texts]
    found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    if network is not None:
        place: dict[bytes, int] = {}
        numbers = [
            np.array([place.setdefault(w, len(place)) for w in units(t)], np.int64) if yes else None
            for t, yes in zip(texts, lettered)
        ]
        words = list(place)
        sums = label_words(network, words) if words else np.zeros((0, len(network.names)))
        for i, own in enumerate(numbers):
            if own is not None:
                p = sums[own].sum(0, dtype=np.float64)
                best = int(p.argmax())
                found[i] = network.names[best], float(p[best] / p.sum())
    return pd.DataFrame(found, columns=["lang", "score"])


def identify(documents: DataFrame) -> DataFrame:
    """Predicted language and score of every document."""
    found = identified(documents.select("doc_id", "text"), fit(documents), "found")
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
    )


def kept(documents: DataFrame, least_score: float = 0.3) -> DataFrame:
    """The documents in a known language, with all their columns."""
    name = fresh(documents, "_language")
    found = identified(documents, fit(documents), name)
    return found.where((F.col(f"{name}.lang") != UNKNOWN) & (F.col(f"{name}.score") >= least_score)).drop(name)

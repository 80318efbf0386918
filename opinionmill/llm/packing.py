"""Operator 1, packing: Karmarkar-Karp multiway differencing.

Documents become token ids. Each is cut into full windows and a rest; rests are cut into pieces of at most ``piece``
ids, because small pieces balance better. Pieces are dealt to groups by a hash, and inside a group the differencing
method merges partial partitions so that the heavy windows of one meet the light windows of the other. The number of
windows starts at the group's ids over the capacity, rounded up, and rises while any window exceeds the capacity.

Texts never shuffle: tokenizing is a narrow step that keeps one light row per piece. A group holds some 256 windows of
ids whatever a document or a source contributes, so no task gets more than that at once.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed each for itself,
their pieces carry equal ids; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import batch, kept_in_worker, pinned, texts_of

#: Windows that a group should hold; pieces of about this many windows are balanced together.
GROUP_WINDOWS = 256
#: Runs with and without white space.
RUNS = re.compile(r"\s+|\S+")

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("task", pa.int64()), ("copy", pa.int64()),
])


def encoder(path: str):
    """A function from a text to the ids that the tokenizer file at ``path`` gives.

    Beside the file lie the same vocabulary as ranks, which a faster library reads. Texts with the string of a special
    token, and very long runs with or without white space, go to the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(path)
    special = [str(token.content) for token in whole.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        odd = any(token in text for token in special) or len(text) > 20_000 and max(map(len, RUNS.findall(text))) > 5_000
        return whole.encode(text, add_special_tokens=False).ids if odd else fast.encode_ordinary(text)

    return encode


def cuts(length: int, window: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows first, then the rest in pieces."""
    full = length - length % window
    return [(i, window) for i in range(0, full, window)] + [
        (i, min(piece, length - i)) for i in range(full, length, piece)
    ]


def difference(sizes: list[int], windows: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each size and the windows' loads, by multiway differencing over ``windows`` windows.

    Each size starts as a partition of its own. The two partitions of the widest spread are merged, the heaviest
    window of one with the lightest of the other, until one is left.
    """
    merges: list[tuple[int, int, np.ndarray] | None] = [None] * len(sizes)
    open_: list[tuple[int, int, np.ndarray]] = []
    for i, size in enumerate(sizes):
        loads = np.zeros(windows, np.int64)
        loads[-1] = size
        open_.append((-size, i, loads))
    heapq.heapify(open_)
    while len(open_) > 1:
        _, left, heavy = heapq.heappop(open_)
        _, right, light = open_[0]
        loads = heavy + light[::-1]
        order = np.argsort(loads, kind="stable")
        loads = loads[order]
        merges.append((left, right, order))
        heapq.heapreplace(open_, (int(loads[0] - loads[-1]), len(merges) - 1, loads))
    _, root, loads = open_[0]
    place = np.zeros(len(sizes), np.int64)
    down = [(root, np.arange(windows))]
    while down:
        node, names = down.pop()
        if node < len(sizes):
            place[node] = names[-1]
            continue
        left, right, order = merges[node]
        own = np.empty(windows, np.int64)
        own[order] = names
        down += [(left, own), (right, own[::-1])]
    return place, loads


def balance(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """The window of each size and the number of windows, none of which exceeds ``capacity``."""
    if not sizes:
        return np.zeros(0, np.int64), 0
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        place, loads = difference(sizes, windows)
        if loads[-1] <= capacity:
            return place, windows
        windows += 1


def piece_rows(documents: DataFrame, path: str, window: int, end_id: int, piece: int) -> DataFrame:
    """A light row for each piece of each document; ``task`` and ``copy`` tell the rows of an id apart."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept_in_worker(("encoder", path), lambda: encoder(path))
        seen: Counter = Counter()
        task = TaskContext.get().partitionId()
        for rows in batches:
            out: list[tuple] = []
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), texts_of(rows.column("text"))):
                ids = np.array([*encode(text), end_id], "<u4")
                raw = ids.tobytes()
                copy = seen[doc_id]
                seen[doc_id] += 1
                out += [
                    (doc_id, start, length, zlib.crc32(raw[4 * start:4 * (start + length)]), len(ids), task, copy)
                    for start, length in cuts(len(ids), window, piece)
                ]
            yield batch(PIECES, list(zip(*out)) if out else [[]] * len(PIECES))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, copy long"
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def pack(
    documents: DataFrame, path: str, *, window: int = 2048, end_id: int = 1, piece: int = 512,
    group_windows: int = GROUP_WINDOWS,
) -> DataFrame:
    """The pieces of all documents with their ``sequence_id`` and ``offset`` in the sequence."""
    pieces = pinned(piece_rows(documents, path, window, end_id, piece))
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, total // (window * group_windows))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        group = int(rows["group"].iloc[0])
        rows = rows.sort_values(["doc_id", "start", "ids_crc32", "task", "copy"], kind="stable").reset_index(drop=True)
        full = (rows["length"] >= window).to_numpy()
        names = np.zeros(len(rows), np.int64)
        names[~full], windows = balance(rows["length"][~full].tolist(), window)
        names[full] = windows + np.arange(full.sum())
        rows["sequence_id"] = names + (group << 32)
        lengths = rows.groupby("sequence_id")["length"]
        rows["offset"] = lengths.cumsum() - rows["length"]
        return rows.drop(columns=["group", "task", "copy"])

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "task", "copy"), F.lit(groups)))
    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return dealt.groupBy("group").applyInPandas(place, schema)

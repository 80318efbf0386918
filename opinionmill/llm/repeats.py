"""Operator 9, suffix-array dedup: a run-length index.

Every byte that a string of ``LENGTH`` bytes covers goes if that string also starts anywhere else.

1. Anchors: of each such window of a document, the run of ``GRAM`` bytes with the smallest hash is the window's anchor.
   It depends on the window's bytes alone, so equal windows have equal anchors. Consecutive windows with one anchor form
   a segment: (anchor, document, first window, number of windows, hash of the bytes). Only anchors that occur again
   matter. These rows are light, some 1/200 of the text's bytes each.
2. Where an anchor has different segments, one text of each is fetched and goes to the anchor's bucket, of about
   ``BUCKET`` bytes, with the number of its occurrences. An anchor with one segment, in all its places, is a single run
   of an index, and needs no text: all its windows repeat.
3. In a bucket the segments' suffixes are sorted into a Burrows-Wheeler transform, of which the runs are kept, with the
   text places and the common prefixes sampled at both ends of each run. Copies of a segment only lengthen its runs. Inside a run the common prefix with the
   neighbour shrinks by one from place to place, so a pass over the text from sample to sample gives the matching
   statistics: the longest match elsewhere from each place. Windows with a match of ``LENGTH`` or more are marked.
4. An anchor with more than ``FEW`` different segments, a passage in very many documents, is spread over several buckets.
   What no match was found for in a bucket may match in another. Windows are taken in ranges of ``RANGE`` by their place
   to the anchor; those of a range share a core of bytes. Each bucket reports the cores of its different ranges. Only of
   ranges whose core another bucket has too, the windows are compared, by hashes of 128 bits.
5. Marked windows, as one row of spans for each segment, go back to all occurrences, and each document drops the bytes
   that they cover.

A suffix sort holds a bucket, never a group; text shuffles once to fetch segments and is read again, by the same
shuffle where Spark can reuse it, to drop bytes.

Defined results: a null text is empty; repeated rows repeat each other; texts of less than ``LENGTH`` bytes lose
nothing; an empty table gives no rows; other columns are not read. The query cuts by bytes. The pipeline's stage cuts
whole words: passages of more than ``PASSAGE_WORDS`` words that strings of ``PASSAGE`` bytes cover.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, fresh, pinned

LENGTH = 400
#: What the pipeline takes for a passage: matches of so many bytes, with more than so many whole words.
PASSAGE = 200
PASSAGE_WORDS = 50
WHITE = b" \t\n\x0b\x0c\r"
WORD = re.compile(rb"[^ \t-\r]+")
GRAM = 32
#: Bytes of documents that are hashed together, and rows whose segments go on together.
AT_ONCE = 1 << 19
ROWS_AT_ONCE = 500
BUCKET = 1 << 20
FEW = 1_000
RANGE = 16
NO_ID = -(1 << 63)

#: Odd multipliers of the hash of a run, and the bits of its value that the place replaces.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
PLACE_BITS = 21


def run_hashes(data: bytes) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    count = len(data) - GRAM + 1
    out = np.zeros(count, np.uint64)
    for i, factor in enumerate(FACTORS):
        part = words[8 * i:8 * i + count] * factor
        part ^= part >> np.uint64(32)
        out += part
        out *= FACTORS[0]
    out ^= out >> np.uint64(29)
    out *= FACTORS[1]
    out ^= out >> np.uint64(32)
    return out


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values, by running minima of blocks from both sides."""
    count = len(values) - width + 1
    blocks = np.full((-(-len(values) // width), width), np.iinfo(np.uint64).max, np.uint64)
    blocks.ravel()[:len(values)] = values
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1:width - 1 + count])


def segments(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """(number of the text, first window, windows, anchor, hash of the bytes, anchor's place) for all segments.

    Hashes are signed; an anchor's place counts from the first window.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    part: list[tuple[int, int, bytes]] = []
    size = 0
    for number, text in enumerate(texts):
        for begin in range(0, len(text) - length + 1, AT_ONCE):
            part.append((number, begin, text[begin:begin + AT_ONCE + length - 1]))
            size += len(part[-1][2])
            if size >= AT_ONCE:
                out += _segments(part, length)
                part, size = [], 0
    return out + (_segments(part, length) if part else [])


def _segments(parts: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int, int, int, int, int]]:
    from xxhash import xxh3_64_intdigest

    data = b"".join(p for _, _, p in parts)
    lengths = np.array([len(p) for _, _, p in parts])
    begins = np.cumsum(lengths) - lengths
    hashes = run_hashes(data)
    low = np.uint64((1 << PLACE_BITS) - 1)
    # Of equal hashes the last place has the smallest value.
    marked = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))
    least = least_of(marked, length - GRAM + 1)
    inside = np.zeros(len(least) + 1, np.int64)
    np.add.at(inside, begins, 1)
    np.add.at(inside, begins + lengths - length + 1, -1)
    valid = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    owner = np.searchsorted(begins, valid, "right") - 1
    anchors = least[valid]
    first = np.flatnonzero(np.r_[True, (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])])
    count = np.diff(np.r_[first, len(valid)])
    place = (low - (anchors[first] & low)).astype(np.int64)
    starts, owners = valid[first], owner[first]
    view = memoryview(data)
    contents = np.array(
        [xxh3_64_intdigest(view[a:a + n + length - 1]) for a, n in zip(starts.tolist(), count.tolist())], np.uint64
    )
    names = np.array([(number, begin) for number, begin, _ in parts])[owners]
    return list(zip(
        names[:, 0].tolist(), (names[:, 1] + starts - begins[owners]).tolist(), count.tolist(),
        hashes[place].view(np.int64).tolist(), contents.view(np.int64).tolist(), (place - starts).tolist(),
    ))


def keyed(documents: DataFrame) -> DataFrame:
    """(doc, id, print, text): a document's id, the same but never null, and a hash of its text; the latter two name its row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).alias("print"), text.alias("text"),
    )


OCCURRENCE = pa.schema([
    ("anchor", pa.int64()), ("content", pa.int64()), ("id", pa.int64()), ("print", pa.int64()), ("start", pa.int32()),
    ("windows", pa.int32()), ("place", pa.int32()),
])


def occurrences(rows: DataFrame, length: int) -> DataFrame:
    """A light row for each segment of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for start in range(0, part.num_rows, ROWS_AT_ONCE):
                few = part.slice(start, ROWS_AT_ONCE)
                ids, prints = few.column("id").to_pylist(), few.column("print").to_pylist()
                found = segments([t.as_buffer().to_pybytes() for t in few.column("text")], length)
                yield batch(OCCURRENCE, [
                    [f[3] for f in found], [f[4] for f in found], [ids[f[0]] for f in found], [prints[f[0]] for f in found],
                    [f[1] for f in found], [f[2] for f in found], [f[5] for f in found],
                ])

    schema = "anchor long, content long, id long, print long, start int, windows int, place int"
    return rows.where(F.octet_length("text") >= length).mapInArrow(run, schema)


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of texts with samples at the ends of its runs.

    ``texts`` are followed by marks that differ from each other and from every byte, so no match crosses an end. A text
    that occurs several times, by ``copies``, is sorted once: the suffixes of its copies lie side by side with the same
    symbol before them, so they only lengthen a run.
    """

    def __init__(self, texts: list[bytes], copies: np.ndarray):
        lengths = np.array([len(t) for t in texts])
        self.lengths, self.copies = lengths, copies
        self.ends = np.cumsum(lengths + 1) - 1
        self.size = size = int(self.ends[-1]) + 1
        symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int32) + len(texts)
        symbols[self.ends] = np.arange(len(texts))
        order, self.levels = sorted_suffixes(symbols, int(lengths.max(initial=0)) + 1)
        before = symbols[order - 1]
        starts = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        last = np.r_[starts[1:], size] - 1
        # The runs with their lengths, and at each end of each run the place in the text and the common prefix with the
        # neighbour outside.
        owner = np.searchsorted(self.ends, order)
        self.runs = before[starts], np.add.reduceat(copies[owner], starts)
        self.heads = order[starts], self.common(order[starts], order[starts - 1], starts > 0)
        self.tails = order[last], self.common(order[last], order[(last + 1) % size], last + 1 < size)

    def common(self, a: np.ndarray, b: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes from ``a`` and from ``b``; 0 where there is no neighbour."""
        total = np.zeros(len(a), np.int64)
        a, b = a.copy(), b.copy()
        for step, ranks in reversed(self.levels):
            inside = np.maximum(a, b) < self.size
            same = inside & (ranks[np.minimum(a, self.size - 1)] == ranks[np.minimum(b, self.size - 1)])
            total += same * step
            a += same * step
            b += same * step
        return total * there

    def statistics(self) -> np.ndarray:
        """The longest match elsewhere from each place, streamed from sample to sample.

        A place inside a run has a neighbour that is one further on than the neighbour of the place before. Where a text
        lies in its runs several times, its copy is the neighbour, and they agree to the end.
        """
        out = np.zeros(self.size, np.int64)
        for end, length in zip(self.ends[self.copies > 1].tolist(), self.lengths[self.copies > 1].tolist()):
            out[end - length:end] = np.arange(length, 0, -1)
        for places, common in (self.heads, self.tails):
            sampled = np.full(self.size, -1, np.int64)
            sampled[places] = common
            known = np.maximum.accumulate(np.where(sampled >= 0, np.arange(self.size), 0))
            out = np.maximum(out, sampled[known] - (np.arange(self.size) - known))
        return out


def sorted_suffixes(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """All suffixes in order, and the ranks of their first 1, 2, 4, ... symbols; equal ones share a rank.

    Ranks double in length until all differ. Only suffixes whose rank is shared are sorted again.
    """
    size = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranks = np.empty(size, np.int32)
    fresh_ = np.r_[True, symbols[order][1:] != symbols[order][:-1]]
    ranks[order] = np.maximum.accumulate(np.where(fresh_, np.arange(size), 0))
    levels = [(1, ranks)]
    step = 1
    while step < longest:
        # Members of groups that share a rank, in the order of the groups.
        shared = ~fresh_ | np.r_[~fresh_[1:], False]
        at = np.flatnonzero(shared)
        if not len(at):
            break
        members = order[at]
        group = ranks[members].astype(np.int64)
        follow = np.where(members + step < size, ranks[np.minimum(members + step, size - 1)], -1)
        # A group's rank is the place of its first member, so sorting by group keeps each in its place.
        resort = np.argsort(group * (size + 1) + follow + 1, kind="stable")
        members, group, follow = members[resort], group[resort], follow[resort]
        order[at] = members
        start = np.r_[True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])]
        fresh_ = fresh_.copy()
        fresh_[at] = start
        ranks = ranks.copy()
        ranks[members] = at[np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))]
        step *= 2
        levels.append((step, ranks))
    return order, levels


def spans_of(hits: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of True."""
    edges = np.flatnonzero(np.diff(np.r_[0, hits.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def digest(data: bytes) -> tuple[int, int]:
    """A hash of 128 bits as two signed longs."""
    from xxhash import xxh3_128_intdigest

    value = xxh3_128_intdigest(data)
    return (value >> 64) - (1 << 63), (value & (1 << 64) - 1) - (1 << 63)


def ranges(windows: int, place: int, width: int) -> list[tuple[int, int, int]]:
    """(first window, last window, first byte of the core) of a segment's ranges.

    A range is set by the distance of its windows from the anchor, so it is the same wherever the anchor occurs. Its
    core is LENGTH + 1 - width bytes long.
    """
    out = []
    for number in range((place - windows + 1) // width, place // width + 1):
        low, high = max(0, place - (number + 1) * width + 1), min(windows - 1, place - number * width)
        if low <= high:
            out.append((low, high, place - number * width))
    return out


SPANS = "array<struct<low: int, high: int>>"
MARKED = f"anchor long, content long, spans {SPANS}, low int, high int, bucket long, spread boolean, first long, second long"


def indexed(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """One row with the marked windows of each of a bucket's segments that has any, and rows of the ranges that spread
    anchors have to compare across buckets."""
    rows = rows.drop_duplicates(["anchor", "content"]).sort_values(["anchor", "content"])
    texts = [bytes(t) for t in rows["bytes"]]
    index = RunLengthIndex(texts, rows["occurrences"].to_numpy(np.int64))
    found = index.statistics() >= length
    begins = index.ends - np.array([len(t) for t in texts])
    bucket = int(rows["bucket"].iloc[0])
    out: list[tuple] = []
    seen: set[bytes] = set()
    for row, text, begin in zip(rows.itertuples(), texts, begins.tolist()):
        hits = found[begin:begin + row.windows]
        if hits.any():
            spans = [{"low": a, "high": b} for a, b in spans_of(hits)]
            out.append((row.anchor, row.content, spans, 0, 0, bucket, False, 0, 0))
        if row.spread:
            for low, high, core in ranges(row.windows, row.place, RANGE):
                whole = text[low:high + length]
                # Equal ranges have equal windows; one of those that are marked already stands for all.
                if not hits[low:high + 1].all() or whole not in seen:
                    seen.add(whole)
                    out.append((row.anchor, row.content, None, low, high, bucket, True, *digest(text[core:core + length + 1 - RANGE])))
    return pd.DataFrame(out, columns=["anchor", "content", "spans", "low", "high", "bucket", "spread", "first", "second"])


WINDOW = pa.schema([
    ("anchor", pa.int64()), ("content", pa.int64()), ("low", pa.int32()), ("first", pa.int64()), ("second", pa.int64()),
])


def windows_of(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with its hash for each window of a range."""
        for part in batches:
            out = [
                (anchor, content, i, *digest(data[i - low:i - low + length]))
                for anchor, content, low, high, data in zip(*[part.column(c).to_pylist() for c in ("anchor", "content", "low", "high", "bytes")])
                for i in range(low, high + 1)
            ]
            yield batch(WINDOW, list(zip(*out)) if out else [[]] * len(WINDOW))

    return run


def across_buckets(marks: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(anchor, content, spans): the windows of spread anchors that occur in another bucket too, a row for each content."""
    reported = marks.where("spread")
    cores = pinned(reported.groupBy("first", "second").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a < b"))
    open_ = reported.join(cores.select("first", "second"), ["first", "second"], "left_semi").select("anchor", "content", "low", "high")
    # Every window of a content that occurs several times is marked already.
    pieces = open_.join(texts.where(F.col("occurrences") == 1).select("anchor", "content", "bytes"), ["anchor", "content"]).select(
        "anchor", "content", "low", "high", F.expr(f"substring(bytes, low + 1, high - low + {length})").alias("bytes")
    )
    others = open_.join(texts.where(F.col("occurrences") > 1).select("anchor", "content", "bytes"), ["anchor", "content"]).select(
        "anchor", "content", "low", "high", F.expr(f"substring(bytes, low + 1, high - low + {length})").alias("bytes")
    )
    type_ = "anchor long, content long, low int, first long, second long"
    single = pinned(pieces.mapInArrow(windows_of(length), type_))
    whole = others.mapInArrow(windows_of(length), type_)
    each = single.groupBy("first", "second").agg(F.count("*").alias("n")).union(
        whole.groupBy("first", "second").agg(F.lit(2).cast("long").alias("n")))
    several = pinned(each.groupBy("first", "second").agg(F.sum("n").alias("n")).where("n > 1").select("first", "second"))
    lows = single.join(several, ["first", "second"], "left_semi").groupBy("anchor", "content").agg(
        F.sort_array(F.collect_set("low")).alias("lows"))
    # Windows in a row are one span.
    first = F.filter("lows", lambda x, i: ~F.coalesce(F.get("lows", i - 1) == x - 1, F.lit(False)))
    last = F.filter("lows", lambda x, i: ~F.coalesce(F.get("lows", i + 1) == x + 1, F.lit(False)))
    return lows.select("anchor", "content", F.zip_with(first, last, lambda a, b: F.struct(a.alias("low"), b.alias("high"))).alias("spans"))


def repeated_windows(rows: DataFrame, few: int = FEW, bucket: int = BUCKET, length: int = LENGTH) -> DataFrame:
    """(id, print, spans): for each document the (first byte, byte after the last) that repeated windows cover."""
    # Texts are cut into segments once; the rows are light, and finding them is a large share of the work.
    every = pinned(occurrences(rows, length))
    again = pinned(every.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("anchor"))
    places = pinned(every.join(again, "anchor", "left_semi"))
    kinds = pinned(places.groupBy("anchor", "content").agg(
        F.count("*").alias("occurrences"), F.min(F.struct("id", "print", "start", "windows", "place")).alias("at")
    ))
    several = pinned(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > 1))
    wanted = pinned(kinds.join(several, "anchor").select("anchor", "content", "occurrences", "kinds", "at.*"))
    size = wanted.agg(F.coalesce(F.sum(F.col("windows") + length - 1), F.lit(0))).first()[0]
    buckets = size // bucket + 1
    block = F.pmod(F.col("content"), F.ceil(F.col("kinds") / few))
    asked = wanted.groupBy("id", "print").agg(F.collect_list(F.struct(
        "anchor", "content", "start", "windows", "place", "occurrences", (F.col("kinds") > few).alias("spread"),
        F.pmod(F.xxhash64("anchor", block), F.lit(buckets)).alias("bucket"),
    )).alias("asked"))
    # Each task keeps one of the copies of a row before the texts shuffle, so a bucket gets each segment once.
    once = rows.where(F.octet_length("text") >= length).groupBy("id", "print").agg(F.first("text").alias("text"))
    fetched = once.join(asked, ["id", "print"]).select(F.encode("text", "utf-8").alias("bytes"), F.explode("asked").alias("s")).select(
        "s.anchor", "s.content", "s.windows", "s.place", "s.occurrences", "s.spread", "s.bucket",
        F.expr("substring(bytes, s.start + 1, s.windows + " f"{length - 1})").alias("bytes"),
    )
    crowded = not several.where(F.col("kinds") > few).isEmpty()
    if crowded:
        fetched = pinned(fetched)
    marks = pinned(fetched.groupBy("bucket").applyInPandas(lambda rows_: indexed(rows_, length), MARKED))
    # A content that is alone on its anchor and occurs again is one run of the index as it is: all of its windows repeat.
    alone = kinds.where(F.col("occurrences") > 1).join(several, "anchor", "left_anti").select(
        "anchor", "content", F.array(F.struct(F.lit(0).alias("low"), (F.col("at.windows") - 1).alias("high"))).alias("spans")
    )
    found = marks.where(~F.col("spread")).select("anchor", "content", "spans")
    if crowded:
        texts = fetched.where("spread").groupBy("anchor", "content").agg(
            F.first("bytes").alias("bytes"), F.max("occurrences").alias("occurrences"))
        more = across_buckets(marks, texts, length)
        found = found.union(more).groupBy("anchor", "content").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    # One row for each content, so a place meets at most one.
    met = places.join(alone.union(found), ["anchor", "content"]).select("id", "print", F.transform(
        "spans", lambda s: F.struct((F.col("start") + s["low"]).alias("a"), (F.col("start") + s["high"] + length).alias("b"))
    ).alias("spans"))
    return met.groupBy("id", "print").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    """Spans in order; those that overlap or touch are one."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans if s is not None):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ("kept_text", pa.string()),
])


def remove_repeats(documents: DataFrame) -> DataFrame:
    """What each document loses, a digest of the bytes that are left, and those as text, without bytes of cut characters."""
    rows = keyed(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for name, text, spans in zip(part.column("doc").to_pylist(), part.column("text"), part.column("spans").to_pylist()):
                data = text.as_buffer().to_pybytes()
                cut = merged(spans or [])
                kept_ = without(data, cut)
                out.append((name, len(data), len(data) - len(kept_), len(cut), hashlib.sha256(kept_).hexdigest(), kept_.decode("utf-8", "ignore")))
            yield batch(RESULT, list(zip(*out)) if out else [[]] * len(RESULT))

    return rows.join(repeated_windows(rows), ["id", "print"], "left").select("doc", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    )


def passages(data: bytes, spans: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """The whole words of each span that has more than ``words`` of them."""
    out = []
    for a, b in spans:
        found = [m.span() for m in WORD.finditer(data, a, b)]
        # The first and the last may go on outside.
        if found and a and data[a - 1:a] not in WHITE and found[0][0] == a:
            found.pop(0)
        if found and b < len(data) and data[b:b + 1] not in WHITE and found[-1][1] == b:
            found.pop()
        if len(found) > words:
            out.append((found[0][0], found[-1][1]))
    return out


def kept(documents: DataFrame, length: int = PASSAGE, words: int = PASSAGE_WORDS) -> DataFrame:
    """The documents with all their columns, their text without repeated passages; ``n_chars`` counts what is left.

    A passage is what strings of ``length`` bytes cover that occur again anywhere, if it holds more than ``words`` whole
    words; these go, so no word is cut.
    """
    spans, key, name, out = (fresh(documents, n) for n in ("_spans", "_print", "_id", "_text"))
    found = repeated_windows(keyed(documents), length=length).select(
        F.col("id").alias(name), F.col("print").alias(key), F.col("spans").alias(spans))
    text = F.col("text").cast("string")
    rows = documents.withColumn(name, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(
        key, F.xxhash64(F.coalesce(text, F.lit("")))
    )

    def left(text_: str, spans_) -> str:
        data = text_.encode()
        return without(data, passages(data, merged(spans_), words)).decode()

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans_: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else left(t, s) for t, s in zip(texts, spans_)], dtype=object)

    met = rows.join(found, [name, key], "left").withColumn(out, cut(text, F.col(spans)))
    return met.select(*[
        F.col(out).alias("text") if c == "text" else F.length(out).cast(kind).alias(c) if c == "n_chars" else F.col(c)
        for c, kind in documents.dtypes
    ])

"""Operator 13, phrase collocation mining: SON partitioning.

ASCII letters are lower-cased, texts are cut at ``.,;:!?`` and line breaks (U+000A to U+000D) into pieces, and pieces at
spaces and tabs into words. Phrases are 2 to ``LONGEST`` words of a piece, counted per language; a null one is ``und``.

1. Documents are dealt to ``SHARDS`` shards by a hash. Each task cuts its texts into words once: a row of the pinned
   table holds some consecutive texts of a language and a shard as numbers into their words. Words are counted
   per language and shard.
2. Each shard is mined completely at proportionally lowered support: a phrase that occurs ``SUPPORT`` times in all has,
   in at least one shard, its share of that by the shard's words. A phrase of two words counts in a shard if both words
   are locally frequent there, a longer one if all its pairs are. What counts goes by keys of 56 bits, so phrases that
   share a key can only add candidates.
3. The locally frequent phrases of all shards are united, and every candidate is counted over all documents: there
   phrases are compared by their words, so counts are exact.
4. Scores, the fall-out of phrases inside longer ones and the first ``TOP`` of each language are joins and a ranking of
   the candidates.

Shards are few, as the support is a fixed number: with more than ``SUPPORT`` of them one occurrence would be frequent. A
shard isn't a task; its counts are summed in each task, then shuffled by key. What is locally frequent goes to the tasks
as a Bloom filter of ``BITS`` bits, however much it is: a fuller filter prunes less and loses nothing. Texts don't
shuffle. A group of copies or a frequent phrase is one row a task.

Defined results: a null text is empty; repeated rows count each time; an empty table gives no rows; other columns are
not read. Whole texts are counted; a text that is longer than ``AT_ONCE`` is worked on alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from opinionmill.plans.joins import lookup_join

from .common import batch, pinned

SUPPORT = 30
LONGEST = 4
#: At most 8, which is what a key has room for.
SHARDS = 5
TOP = 2000
#: A phrase falls out if a longer one around it has this share of its occurrences, in hundredths.
COVERED = 80
SCALE = 2_000_000
#: Bits of a filter, a power of two of at most 2^32.
BITS = 1 << 25
#: Bytes of text that are worked on together, and counts that a task holds before it sends them.
AT_ONCE = 1 << 22
HELD = 1 << 20

#: Bytes that Spark hands to a task's Python at once; tasks have them twice outside of their heap, in powers of two.
BATCH_BYTES = 1 << 22
#: Rows that a task decodes at once. Its default, 4,096, is a row group of tokens or more.
READ_ROWS = 16
#: Rows of tokens have some 300 KB. Tasks write and read a row group as a whole, and a large one is a single task's.
LARGE_ROWS = {"parquet.block.size": 1 << 24, "parquet.page.size.row.check.min": 2, "parquet.page.size.row.check.max": 20}

#: Odd multipliers by place.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: The low bits of a local key: the shard, and the support that is needed there.
SHARD_BIT = 5
LOW = (1 << SHARD_BIT + 3) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * FACTORS[0]
    x = (x ^ (x >> np.uint64(29))) * FACTORS[1]
    return x ^ (x >> np.uint64(32))


def keys(hashes: np.ndarray, size: int) -> np.ndarray:
    """A key for each phrase of ``size`` consecutive words from their hashes; its low bits are 0."""
    count = max(0, len(hashes) - size + 1)
    total = np.full(count, size, np.uint64)
    for j in range(size):
        total += hashes[j:j + count] * FACTORS[j]
    return mixed(total) & ~np.uint64(LOW)


def places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a key in a filter."""
    spread = mixed(key)
    return spread & np.uint64(BITS - 1), spread >> np.uint64(32) & np.uint64(BITS - 1)


def inside(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether each key may be in a filter."""
    first, second = places(key)
    out = set_at(bits, first)
    # Few keys have their first bit.
    left = np.flatnonzero(out)
    out[left] = set_at(bits, second[left])
    return out


def set_at(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def filter_of(found: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``key``; no more rows come to the driver than it has words of 64 bits."""
    schema = pa.schema([("at", pa.int32()), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            place = np.concatenate(places(rows.column("key").to_numpy().view(np.uint64)))
            yield batch(schema, [(place >> np.uint64(6)).astype(np.int32), (np.uint64(1) << (place & np.uint64(63))).view(np.int64)])

    rows = found.select("key").mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def dealt(documents: DataFrame) -> DataFrame:
    """(text, lang, shard) of documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    shard = F.pmod(F.xxhash64("doc_id", text), F.lit(SHARDS)).cast("int")
    return documents.select(text.alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), shard.alias("shard"))


def slices(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``AT_ONCE`` bytes of text, or one that is longer."""
    sizes = np.cumsum(pc.binary_length(rows.column("text")).to_numpy())
    begin = 0
    while begin < rows.num_rows:
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + AT_ONCE, "right")))
        yield rows.slice(begin, end - begin)
        begin = end


def in_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of some texts, the number of each of their words in order, and the piece of each."""
    cut = pc.replace_substring_regex(pc.ascii_lower(texts), "[.,;:!?\n-\r]", " \n ")
    lists = pc.split_pattern(pc.replace_substring(cut, "\t", " "), " ")
    encoded = lists.flatten().dictionary_encode()
    codes, words = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary
    marks = pc.equal(words, "\n").to_numpy(zero_copy_only=False)
    real = ~marks & pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    number = np.cumsum(real) - 1
    here = real[codes]
    return words.filter(pa.array(real)), number[codes[here]], (np.cumsum(marks[codes]) + text)[here]


TOKENS = pa.schema([
    ("lang", pa.string()), ("shard", pa.int32()), ("words", pa.string()), ("counts", pa.binary()), ("hashes", pa.binary()),
    ("codes", pa.binary()), ("starts", pa.binary()),
])
TOKENS_TYPE = "lang string, shard int, words string, counts binary, hashes binary, codes binary, starts binary"


def in_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for the texts of a slice that share a language and a shard.

    ``words`` are the different words between line breaks, ``counts`` how often each occurs and ``hashes`` their hashes of
    64 bits, which depend on the language too. ``codes`` are numbers into ``words``, and ``starts`` the places in them where
    a piece begins; like the counts they have 32 bits.
    """
    for part in batches:
        for rows in slices(part):
            crowds = pd.DataFrame({"lang": rows.column("lang").to_pylist(), "shard": rows.column("shard").to_numpy()})
            for (lang, shard), at in crowds.groupby(["lang", "shard"]).indices.items():
                words, codes, piece = in_words(rows.column("text").take(pa.array(at)))
                if not len(codes):
                    continue
                seed = pd.util.hash_array(np.array([lang], object), categorize=False)
                hashes = mixed(pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) ^ seed)
                starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
                counts = np.bincount(codes, minlength=len(words))
                yield batch(TOKENS, [
                    [lang], [int(shard)], in_lines(words), [counts.astype(np.int32).tobytes()], [hashes.tobytes()],
                    [codes.astype(np.int32).tobytes()], [starts.astype(np.int32).tobytes()],
                ])


def in_lines(words: pa.Array) -> pa.Array:
    """One text of words, none of which has a line break; neither Python nor Spark takes them apart."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")


class Slice:
    """A row of tokens: the hash and the code of each of its words in order."""

    def __init__(self, row: dict):
        self.lang, self.shard, self.need = row["lang"], row["shard"], row.get("need")
        self.codes = np.frombuffer(row["codes"], np.int32)
        self.hashes = np.frombuffer(row["hashes"], np.uint64)[self.codes]
        starts = np.zeros(len(self.codes), np.int32)
        starts[np.frombuffer(row["starts"], np.int32)] = 1
        self.piece = np.cumsum(starts)

    def whole(self, size: int) -> np.ndarray:
        """Where phrases of so many words lie in one piece: a flag for each word but the last ones."""
        count = max(0, len(self.piece) - size + 1)
        return self.piece[len(self.piece) - count:] == self.piece[:count]

    def local(self, size: int) -> np.ndarray:
        """Keys that tell the shard and the support needed there, in their low bits."""
        return keys(self.hashes, size) | np.uint64(self.shard << SHARD_BIT | self.need)

    def pairs(self, bits: np.ndarray) -> list[np.ndarray]:
        """Local keys of the pairs of words that are both frequent in the shard."""
        good = inside(bits, self.local(1))
        return [self.local(2)[self.whole(2) & good[:-1] & good[1:]]]

    def longer(self, bits: np.ndarray) -> list[np.ndarray]:
        """Local keys of longer phrases all of whose pairs are frequent in the shard."""
        good = pair = self.whole(2) & inside(bits, self.local(2))
        out = []
        for size in range(3, LONGEST + 1):
            good = good[:-1] & pair[size - 2:]
            out.append(self.local(size)[good])
        return out

    def candidates(self, bits: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Where phrases of each size may be locally frequent somewhere.

        The pairs of a phrase are frequent wherever it is, so they are in the filter too.
        """
        good = pair = self.whole(2) & inside(bits, keys(self.hashes, 2))
        yield 2, good
        for size in range(3, LONGEST + 1):
            good = good[:-1] & pair[size - 2:]
            left = np.flatnonzero(good)
            found = np.zeros(len(good), bool)
            found[left] = inside(bits, keys(self.hashes, size)[left])
            yield size, found


def each_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for rows in batches:
        for i in range(rows.num_rows):
            row = {name: rows.column(name)[i].as_py() for name in rows.schema.names if name != "words"}
            if "words" in rows.schema.names:
                row["words"] = pc.split_pattern(rows.column("words").slice(i, 1), "\n").flatten()
            yield row


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the sums of their counts."""
    key, n = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[start], np.add.reduceat(n, start) if len(key) else n


LOCAL = pa.schema([("local", pa.int64()), ("n", pa.int64())])


def locally_frequent(tokens: DataFrame, of: Callable[[Slice, np.ndarray], list[np.ndarray]], bits: np.ndarray) -> DataFrame:
    """(key) of the phrases that ``of`` offers and that are frequent in a shard, by their local keys."""
    shared = tokens.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for row in each_slice(batches):
            for found in of(Slice(row), shared.value):
                held.append(np.unique(found, return_counts=True))
                size += len(held[-1][0])
            if size > HELD:
                held = [added(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from sent(held.pop())
                    size = 0
        if held:
            yield from sent(added(held))

    def sent(counts: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(counts[0]), 1 << 16):
            yield batch(LOCAL, [counts[0][i:i + (1 << 16)].view(np.int64), counts[1][i:i + (1 << 16)]])

    rows = tokens.select("lang", "shard", "need", "hashes", "codes", "starts")
    counts = gathered(rows.mapInArrow(run, "local long, n long"), ["local"])
    need = F.col("local").bitwiseAND(F.lit((1 << SHARD_BIT) - 1))
    return counts.where(F.col("n") >= need).select(F.col("local").alias("key"))


def gathered(parts: DataFrame, by: list[str]) -> DataFrame:
    """The sums of the other columns.

    Tasks have added up what they hold, so a second sum before the shuffle would find next to nothing to add.
    """
    return parts.repartition(*by).groupBy(*by).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in by])


def summed(counts: Iterator[pa.Table], by: list[str], ordered: bool = False) -> Iterator[pa.RecordBatch]:
    """Counts of strings, added up while they fit.

    Strings in order share what they begin with, so they pack well in a shuffle.
    """
    held: list[pa.Table] = []

    def one() -> pa.Table:
        of = [c for c in held[0].column_names if c not in by]
        found = pa.concat_tables(held).group_by(by, use_threads=False).aggregate([(c, "sum") for c in of])
        return found.rename_columns([*by, *of])

    def sent(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from (table.sort_by(by[0]).combine_chunks() if ordered else table).to_batches(1 << 16)

    for table in counts:
        held.append(table)
        if sum(t.num_rows for t in held) > HELD:
            held = [one()]
            if held[0].num_rows > HELD // 2:
                yield from sent(held.pop())
    if held:
        yield from sent(one())


#: A column for each shard.
IN_SHARDS = [f"n{i}" for i in range(SHARDS)]


def count_words(tokens: DataFrame) -> DataFrame:
    """(lang, word, key, n0, n1, ...): how often each shard holds a word, and the word's own key.

    A word that all shards have is one row of a task.
    """
    by = ["lang", "word", "key"]

    def table(row: dict) -> pa.Table:
        own = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        none = np.zeros(len(own), np.int64)
        return pa.table({
            "lang": pa.array([row["lang"]] * len(own), pa.string()), "word": row["words"],
            "key": keys(np.frombuffer(row["hashes"], np.uint64), 1).view(np.int64),
        } | {name: own if i == row["shard"] else none for i, name in enumerate(IN_SHARDS)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return summed((table(row) for row in each_slice(batches)), by)

    schema = ", ".join(["lang string, word string, key long", *(f"{name} long" for name in IN_SHARDS)])
    return gathered(tokens.select("lang", "shard", "words", "counts", "hashes").mapInArrow(run, schema), by)


def by_shard(rows: DataFrame) -> DataFrame:
    """A row with ``shard`` and ``n`` for each shard that has any."""
    each = F.array(*[F.struct(F.lit(i).alias("shard"), F.col(name).alias("n")) for i, name in enumerate(IN_SHARDS)])
    others = [c for c in rows.columns if c not in IN_SHARDS]
    return rows.select(*others, F.inline(F.filter(each, lambda x: x["n"] > 0)))


def in_all() -> Column:
    return sum((F.col(name) for name in IN_SHARDS[1:]), F.col(IN_SHARDS[0]))


def supports(words: DataFrame) -> DataFrame:
    """(crowd, need): the least count that is frequent in a shard of a language, SUPPORT x its share of the words."""
    sizes = words.groupBy("lang").agg(*[F.sum(name).alias(name) for name in IN_SHARDS])
    # A quotient of whole numbers, rounded up.
    need = F.call_function("div", F.col("n").cast("decimal(20,0)") * SUPPORT + F.col("whole") - 1, F.col("whole"))
    return by_shard(sizes.withColumn("whole", in_all().cast("decimal(20,0)"))).select(crowd().alias("crowd"), need.cast("int").alias("need"))


def crowd() -> Column:
    """The name of a language's shard."""
    return F.concat_ws(":", "shard", "lang")


def known_words(words: DataFrame, needs: DataFrame) -> DataFrame:
    """(key) of the words that are frequent in a shard, by their local keys.

    No Python here: its workers would stand beside those of the filter in each task, and stay for the next stage.
    """
    met = lookup_join(by_shard(words).withColumn("crowd", crowd()), needs, "crowd", ["word"]).where(F.col("n") >= F.col("need"))
    low = F.shiftleft("shard", SHARD_BIT).bitwiseOR(F.col("need")).cast("long")
    return met.select(F.col("key").bitwiseOR(low).alias("key"))


def candidates_of(row: dict, bits: np.ndarray) -> pa.Table:
    """(name, n) of a slice's phrases that may be locally frequent somewhere, compared by their words.

    A name is ``lang:phrase``, one string to shuffle; no phrase has a colon.
    """
    part_, words = Slice(row), row["words"]
    out = []
    for size, good in part_.candidates(bits):
        at = np.flatnonzero(good)
        # A number for each different row of words, built up word by word.
        number = np.zeros(len(at), np.int64)
        for j in range(size):
            _, number = np.unique(number * len(words) + part_.codes[at + j], return_inverse=True)
        _, first, n = np.unique(number, return_index=True, return_counts=True)
        columns = [words.take(pa.array(part_.codes[at[first] + j])) for j in range(size)]
        phrases = pc.binary_join_element_wise(*columns, " ")
        out.append(pa.table({"name": pc.binary_join_element_wise(row["lang"], phrases, ":"), "n": n.astype(np.int64)}))
    return pa.concat_tables(out)


def count_candidates(tokens: DataFrame, bits: np.ndarray) -> DataFrame:
    """(lang, phrase, size, n) over all documents."""
    shared = tokens.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return summed((candidates_of(row, shared.value) for row in each_slice(batches)), ["name"], ordered=True)

    rows = tokens.select("lang", "shard", "words", "hashes", "codes", "starts")
    counts = gathered(rows.mapInArrow(run, "name string, n long"), ["name"])
    phrase = F.substring_index("name", ":", -1)
    lang = F.expr("left(name, length(name) - length(substring_index(name, ':', -1)) - 1)")
    return counts.select(lang.alias("lang"), phrase.alias("phrase"), F.size(F.split(phrase, " ")).alias("size"), "n")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows of tokens are large: both sides hold a batch, and Spark twice that while it grows."""
    sizes = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.parquet.columnarReaderBatchSize": READ_ROWS}
    before = {name: spark.conf.get(name) for name in sizes}
    for name, size in sizes.items():
        spark.conf.set(name, str(size))
    try:
        yield
    finally:
        for name, size in before.items():
            spark.conf.set(name, size)


def frequent(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of all phrases of 1 to ``LONGEST`` words with ``SUPPORT`` occurrences, and (lang, total) of all words."""
    with small_batches(documents.sparkSession):
        return _frequent(documents)


def _frequent(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    tokens = pinned(dealt(documents).mapInArrow(in_tokens, TOKENS_TYPE), **LARGE_ROWS)
    words = pinned(count_words(tokens))
    needs = pinned(supports(words))
    ready = lookup_join(tokens.withColumn("crowd", crowd()), needs, "crowd", ["codes"])
    pairs = pinned(locally_frequent(ready, Slice.pairs, filter_of(known_words(words, needs))))
    longer = pinned(locally_frequent(ready, Slice.longer, filter_of(pairs)))
    united = pairs.union(longer).select(F.col("key").bitwiseAND(F.lit(~LOW)).alias("key"))
    phrases = count_candidates(tokens, filter_of(united))
    single = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), in_all().alias("n"))
    totals = words.groupBy("lang").agg(F.sum(in_all()).alias("total"))
    return pinned(phrases.unionByName(single).where(F.col("n") >= SUPPORT)), pinned(totals)


def part(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of the phrases by their lowest-scoring cut."""
    named = pinned(counts.select(F.concat_ws(":", "lang", "phrase").alias("name"), "n"))
    words = F.split("phrase", " ")
    cuts = counts.where(F.col("size") > 1).select(
        "lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).select("*", F.concat_ws(":", "lang", part(words, F.lit(1), F.col("k"))).alias("first"),
             F.concat_ws(":", "lang", part(words, F.col("k") + 1, F.col("size") - F.col("k"))).alias("rest"))
    met = lookup_join(cuts, named.toDF("first", "l"), "first", ["phrase", "k"])
    met = lookup_join(met, named.toDF("rest", "r"), "rest", ["phrase", "k"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.call_function("div", wide("a") * SCALE, wide("l") + wide("r"))
    best = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return met.groupBy("lang", "phrase", "size", "a").agg(best.alias("b")).select(
        "lang", "phrase", "size", "a", "b.l", "b.r", F.col("b.score").cast("long").alias("score"))


def uncovered(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The phrases that no longer one around them makes up for."""
    words = F.split("phrase", " ")
    starts = F.explode(F.sequence(F.lit(1), F.col("size") - F.col("inner") + 1))
    inner = counts.where(F.col("size") > 2).select("*", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("inner"))
    around = inner.select("lang", "n", "inner", "phrase", starts.alias("at")).select(
        "lang", part(words, F.col("at"), F.col("inner")).alias("phrase"), "n"
    ).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    met = rows.join(around, ["lang", "phrase"], "left")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return met.where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * COVERED)).drop("longer")


def collocations(documents: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts, totals = frequent(documents)
    left = uncovered(scored(counts), counts)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return lookup_join(ranked, totals, "lang", ["phrase"]).select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")

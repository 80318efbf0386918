"""CSV files with quoted line breaks, read by many tasks a file.

Whether a line break ends a record depends on all bytes before it. Spark's text reader cuts a file into ranges of bytes
and gives each its whole lines. A line turns one of two states into another, outside or inside of a quoted value, and so
does a range of lines:

1. Each task reads its ranges and says for both states how they end. That is one light row a range.
2. Along a file the rows tell in which state each range begins.
3. Each task reads its ranges again and joins the lines of a record. What lies before a range's first record, and after
   its last line break outside of quotes, is a part of a record that goes over the border; parts meet by the range in
   which their record begins.

A value is quoted if it starts with a quote; two quotes in it stand for one. A quote inside of another value is part of
it. Lines end with a line feed, which a carriage return may precede. Empty lines are no records, and the first record of
each file is its header. Records are UTF-8.

Memory: a batch of lines, and one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# The rest of a quoted value after its quote, whole values, and a value that the line leaves open.
_REST = '[^"]*(?:""[^"]*)*'
_VALUE = f'(?:"{_REST}"(?:[^",][^,]*)?|[^",][^,]*|)'
_OPENED = f'(?:{_VALUE},)*"{_REST}'
#: Lines that end inside of a quoted value if they begin outside, and if they begin inside.
OPENS = f"^{_OPENED}$"
STAYS = f'^{_REST}(?:"(?:[^",][^,]*)?,{_OPENED})?$'

RECORD, HEAD, MIDDLE, TAIL = 0, 1, 2, 3


def _turns(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each line whether it ends inside of a quoted value, from outside and from inside."""
    # Nearly all lines have no quote, or are in one state at both ends; looking for quotes is cheap.
    plain = pc.equal(pc.count_substring(lines, '"'), 0).to_numpy(zero_copy_only=False)
    opens, stays = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    at = np.flatnonzero(~plain)
    if len(at):
        some = lines.take(pa.array(at))
        opens[at] = pc.match_substring_regex(some, f"(?s){OPENS}").to_numpy(zero_copy_only=False)
        stays[at] = pc.match_substring_regex(some, f"(?s){STAYS}").to_numpy(zero_copy_only=False)
    return opens, stays


def _states(opens: np.ndarray, stays: np.ndarray, begin: bool) -> np.ndarray:
    """The state after each line: a line either ends in one state whatever came before, or keeps it, or flips it."""
    sets = opens == stays
    flips = np.cumsum(opens & ~stays)
    last = np.maximum.accumulate(np.where(sets, np.arange(len(opens)), -1))
    base = np.where(last >= 0, opens[last], begin)
    flipped = flips - np.where(last >= 0, flips[last], 0)
    return base ^ (flipped % 2 == 1)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, value): the lines of each range of bytes, in their order within a partition."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Array, bool]]:
    """(path and start, some of its lines, whether they are the first ones) of the ranges in a partition, in order."""
    before = None
    for rows in batches:
        paths, starts = rows.column("path").to_pylist(), rows.column("start").to_numpy()
        edges = [i for i in range(1, rows.num_rows) if starts[i] != starts[i - 1] or paths[i] != paths[i - 1]]
        for a, b in zip([0, *edges], [*edges, rows.num_rows]):
            if a < b:
                name = (paths[a], int(starts[a]))
                yield name, rows.column("value").slice(a, b - a), name != before
                before = name


ENDS = pa.schema([("path", pa.string()), ("start", pa.int64()), ("opens", pa.bool_()), ("stays", pa.bool_())])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each range ends from either state."""
    name, ends = None, (False, True)
    for here, lines, first in _ranges(batches):
        if first:
            if name:
                yield pa.RecordBatch.from_pylist([dict(zip(ENDS.names, (*name, *ends)))], ENDS)
            name, ends = here, (False, True)
        turns = _turns(lines)
        ends = tuple(bool(_states(*turns, begin)[-1]) for begin in ends)
    if name:
        yield pa.RecordBatch.from_pylist([dict(zip(ENDS.names, (*name, *ends)))], ENDS)


def _begins(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, inside): in which state each range begins; a row for each range, as many as tasks read the file."""
    ends = _lines(spark, path).mapInArrow(_ends, "path string, start long, opens boolean, stays boolean")
    along = F.array_sort(F.collect_list(F.struct("start", "opens", "stays")))
    # The states before each range and after the last one; its end doesn't matter.
    before = F.aggregate(
        "along", F.array(F.lit(False)),
        lambda states, r: F.concat(states, F.array(F.when(F.element_at(states, -1), r["stays"]).otherwise(r["opens"]))),
    )
    each = F.explode(F.arrays_zip(F.col("along.start").alias("start"), F.slice(before, 1, F.size("along")).alias("inside")))
    return ends.groupBy("path").agg(along.alias("along")).select("path", each.alias("e")).select("path", "e.start", "e.inside")


PIECES = pa.schema([
    ("path", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("header", pa.bool_()), ("record", pa.string()),
])


def _pieces(inside):
    """Records and parts of records of each range; ``inside`` tells in a broadcast whether a range begins inside of a
    value, or is None where every line is a record."""

    def out(name: tuple, kind: int, header: list[bool], records) -> pa.RecordBatch:
        n = len(records)
        columns = [[name[0]] * n, [name[1]] * n, [kind] * n, header, records]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES)], schema=PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, carried, begun, seen = None, False, [], True, 0

        def rest() -> Iterator[pa.RecordBatch]:
            # Lines after the last end of a record: the head of one that goes on, or a middle.
            if carried:
                header = name[1] == 0 and begun and not seen
                yield out(name, HEAD if begun else MIDDLE, [header], ["\n".join(carried)])

        for here, lines, first in _ranges(batches):
            if first:
                yield from rest()
                # Another size of ranges than at the first reading has no answer.
                state = inside is not None and inside.value[here]
                name, carried, begun, seen = here, [], not state, 0
            after = _states(*_turns(lines), state) if inside is not None else np.zeros(len(lines), bool)
            state = bool(after[-1])
            ends = np.flatnonzero(~after)
            if not len(ends):
                carried += lines.to_pylist()
                continue
            offsets = pa.array(np.r_[0, ends + 1].astype(np.int32))
            groups = pa.ListArray.from_arrays(offsets, lines.slice(0, int(ends[-1]) + 1))
            records = pc.binary_join(groups, "\n").to_pylist()
            if carried:
                records[0] = "\n".join([*carried, records[0]])
            carried = lines.slice(int(ends[-1]) + 1).to_pylist()
            if not begun:
                yield out(name, TAIL, [False], [records[0]])
                records = records[1:]
                begun = True
            header = [name[1] == 0 and not seen and i == 0 for i in range(len(records))]
            seen += len(records)
            yield out(name, RECORD, header, records)
        yield from rest()

    return run


def records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(record, n_values) of all records but headers and empty lines. Without ``multi_line`` every line is one."""
    begins = None
    if multi_line:
        # At most as many rows as tasks that read the files.
        begins = spark.sparkContext.broadcast({(r["path"], r["start"]): r["inside"] for r in _begins(spark, path).collect()})
    pieces = _lines(spark, path).mapInArrow(_pieces(begins), "path string, start long, kind int, header boolean, record string")
    if multi_line and any(begins.value.values()):
        # Both branches read the pieces, and each range gives a few parts only.
        parts = pieces.where(F.col("kind") != RECORD)
        whole = pieces.where(F.col("kind") == RECORD).select("header", "record").unionByName(_over_borders(parts))
    else:
        # The last record of a file may lack its closing quote.
        whole = pieces.select("header", "record")
    trimmed = F.regexp_replace("record", "\r\\z", "")
    rows = whole.where(~F.col("header")).select(trimmed.alias("record")).where(F.col("record") != "")
    return rows.mapInArrow(_counted, "record string, n_values int")


def _over_borders(parts: DataFrame) -> DataFrame:
    """Records from their parts, a few for each range, in the order of the file."""
    along = Window.partitionBy("path").orderBy("start", F.col("kind") != TAIL)
    from_ = F.last(F.when(F.col("kind") == HEAD, F.col("start")), ignorenulls=True).over(along)
    together = F.array_sort(F.collect_list(F.struct("start", "record")))
    return parts.withColumn("from", from_).groupBy("path", "from").agg(
        F.bool_or("header").alias("header"), F.array_join(F.transform(together, lambda p: p["record"]), "\n").alias("record")
    ).select("header", "record")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        record = rows.column("record")
        n = pc.count_substring_regex(pc.binary_join_element_wise(pa.scalar(""), record, ","), f"(?s),{_VALUE}")
        yield pa.RecordBatch.from_arrays([record, pc.cast(n, pa.int32())], ["record", "n_values"])


def parsed(record: Column, names: list[str]) -> Column:
    """The values of a record as a struct of texts; those that it lacks are null."""
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    return F.from_csv(record, schema, {"quote": '"', "escape": '"', "multiLine": "true"})

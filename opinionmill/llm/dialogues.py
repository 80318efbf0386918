"""Operator 11, conversation structure repair: a suffix-shared word graph of role and fault signatures.

The rows of a conversation are taken by turn, nulls first; rows of one turn by role, then by the first ``HEAD`` characters
of the text, then by its MD5. A row's first fault counts: blank, duplicate (role and text seen earlier in the
conversation), truncated (the last character that isn't white space is none of ``.!?``). Edits: Keep costs 0, Rerole to
user or assistant 1, Delete 2 (a must for blank and duplicate rows), Insert of an empty user or assistant row 5; a
truncated row that stays adds 5. The cheapest edits are sought that make the initials of the roles ``(s?(ua)+)?``; of
equally cheap ones those whose initials are least in ASCII.

1. Equal rows of a conversation and turn become one light row with a count: its keys, marks and the digest of the text.
   A row is fresh if no earlier turn has its role and text, which a join of unique keys tells.
2. Light rows are range-partitioned and sorted, so one conversation may lie in many partitions. Each partition cuts its
   rows into pieces of up to ``PIECE`` rows of a conversation, with one symbol a row. A conversation within a partition
   is complete; for the others the symbols of their pieces are strung together, one byte a row, like the audit that a
   result holds in one value.
3. Different signatures are sorted from their ends and read as a stream: signatures with a common ending share its nodes,
   and each node is solved once for its grammar states, from the end on. Nodes with the same differences of cost-to-go
   between the states are one class, and a class and a symbol give the next class and the first edits of the best audit
   suffixes, also once. Cost-to-go and audits are read off the nodes.
4. The edits go back to the pieces, each piece its own share, and rows that stay meet their texts by their keys. Texts
   shuffle here alone.

Memory: a task holds one piece, or one signature with 12 bytes a row. A signature that very many conversations have is
solved once and goes back by a broadcast of a checked size or by a salted join.

Defined results: a null role or text is one space; a null conv_id is a conversation; repeated rows are duplicates; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from opinionmill.plans.joins import lookup_join

from .common import batch, pinned

#: Fixed values.
WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
RETYPE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")

HEAD = 32
PIECE = 4096
LONG = 1 << 63

#: Grammar states: at the start, after a system row, after a user row, after an assistant row.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = (2, 2, 3, 2)
ROLE = ("", "", "user", "assistant")
AT_END = (0, 2 * INSERT, INSERT, 0)

KEY = ["known", "conv", "placed", "turn", "role", "digest"]


@dataclass(frozen=True)
class Repaired:
    """``conversations``: known, conv, the faults, the cost and the audit. ``rows``: known, conv, place, role, text."""

    conversations: DataFrame
    rows: DataFrame


def keyed(rows: DataFrame) -> DataFrame:
    """The rows with keys that are never null; ``known`` and ``placed`` tell a null id or turn."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    return rows.select(
        conv.isNotNull().alias("known"), F.coalesce(conv, F.lit(0)).alias("conv"), turn.isNotNull().alias("placed"),
        F.coalesce(turn, F.lit(0)).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.unhex(F.md5(text)).alias("digest"), text.alias("text"))


def light(rows: DataFrame) -> DataFrame:
    """One row for equal rows: its keys, the head of its text, its marks, their number, and whether it is fresh."""
    words = F.rtrim("text", F.lit(WHITE))
    cut = ~F.right(words, F.lit(1)).isin(*ENDS)
    counts = pinned(rows.select(*KEY, F.left("text", F.lit(HEAD)).alias("head"), (words == "").alias("blank"), cut.alias("cut")).groupBy(
        *KEY, "head", "blank", "cut").agg(F.count("*").alias("n")))
    first = counts.where(~F.col("blank")).groupBy("known", "conv", "role", "digest").agg(
        F.min(F.struct("placed", "turn")).alias("at"))
    fresh = first.select("known", "conv", "at.placed", "at.turn", "role", "digest", F.lit(True).alias("fresh"))
    return counts.join(fresh, KEY, "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))


ROW = pa.struct([("placed", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary())])
PIECE_SCHEMA = pa.schema([
    ("known", pa.bool_()), ("conv", pa.int64()), ("part", pa.int32()), ("number", pa.int32()), ("open", pa.bool_()),
    ("symbols", pa.string()), ("lead", pa.string()), ("last", pa.string()), ("first_turn", pa.string()), ("last_turn", pa.string()),
    ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("rows", pa.list_(ROW)),
])
PIECE_TYPE = (
    "known boolean, conv long, part int, number int, open boolean, symbols string, lead string, last string, first_turn string, "
    "last_turn string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, "
    "rows array<struct<placed: boolean, turn: long, role: string, digest: binary>>"
)
COUNTERS = ("turns", "blank", "duplicate", "truncated", "illegal")


def illegal(before: str, after: str) -> bool:
    return before + after not in LEGAL


class Piece:
    """Consecutive rows of a conversation. ``before`` is the last row's turn and initial in the same partition."""

    def __init__(self, conv: tuple, part: int, number: int, before: tuple | None):
        self.conv, self.part, self.number, self.before = conv, part, number, before
        self.symbols: list[str] = []
        self.rows: list[dict] = []
        self.count = dict.fromkeys(COUNTERS, 0)
        self.low = self.high = None
        self.first: tuple | None = None

    def add(self, row: dict) -> None:
        initial, n = row["role"][:1], row["n"]
        turn = str(row["turn"]) if row["placed"] else ""
        here = (turn, initial)
        if self.first is None:
            self.first = here
        self.count["turns"] += row["placed"] and (self.before is None or self.before[0] != turn)
        self.count["illegal"] += n - 1 + (self.before is not None and illegal(self.before[1], initial))
        self.before = here
        if row["placed"]:
            self.low = row["turn"] if self.low is None else min(self.low, row["turn"])
            self.high = row["turn"] if self.high is None else max(self.high, row["turn"])
        if row["blank"] or not row["fresh"]:
            self.count["blank" if row["blank"] else "duplicate"] += n
            self.symbols.append("x" * n)
            return
        self.count["duplicate"] += n - 1
        self.count["truncated"] += row["cut"]
        symbol = initial if initial in ("s", "u", "a") else "o"
        self.symbols.append((symbol.upper() if row["cut"] else symbol) + "x" * (n - 1))
        self.rows.append({k: row[k] for k in ("placed", "turn", "role", "digest")})

    def out(self, open_: bool) -> tuple:
        return (*self.conv, self.part, self.number, open_, "".join(self.symbols), self.first[1], self.before[1], self.first[0],
                self.before[0], self.low, self.high, *self.count.values(), self.rows)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of a partition's sorted rows; those at its borders may go on in others."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    done: list[tuple] = []
    piece, at_border = None, True
    for rows in batches:
        columns = {name: rows.column(name).to_pylist() for name in rows.schema.names}
        for values in zip(*columns.values()):
            row = dict(zip(columns, values))
            conv = (row["known"], row["conv"])
            if piece and piece.conv != conv:
                done.append(piece.out(at_border or piece.number > 0))
                piece, at_border = None, False
            elif piece and len(piece.symbols) >= PIECE:
                done.append(piece.out(True))
                piece = Piece(conv, part, piece.number + 1, piece.before)
            piece = piece or Piece(conv, part, 0, None)
            piece.add(row)
            if len(done) >= 1000:
                yield batch(PIECE_SCHEMA, list(zip(*done)))
                done = []
    if piece:
        done.append(piece.out(True))
    if done:
        yield batch(PIECE_SCHEMA, list(zip(*done)))


def joined(rows: pd.DataFrame) -> pd.DataFrame:
    """One row of a conversation from its pieces, without their rows."""
    rows = rows.sort_values(["part", "number"])
    count = {c: int(rows[c].sum()) for c in COUNTERS}
    before = None
    for piece in rows.itertuples():
        if before is not None and piece.number == 0:
            count["turns"] -= piece.first_turn != "" and piece.first_turn == before.last_turn
            count["illegal"] += illegal(before.last, piece.lead)
        before = piece
    low, high = rows["low"].dropna(), rows["high"].dropna()
    spans = [{"part": p, "number": n, "length": len(s)} for p, n, s in zip(rows["part"], rows["number"], rows["symbols"])]
    return pd.DataFrame([{
        "known": rows["known"].iloc[0], "conv": rows["conv"].iloc[0], "signature": "".join(rows["symbols"]), "spans": spans,
        "low": int(low.min()) if len(low) else None, "high": int(high.max()) if len(high) else None, **count,
    }]).astype({"low": "Int64", "high": "Int64"})


SPANS = "array<struct<part: int, number: int, length: long>>"


def conversations_of(cut: DataFrame) -> DataFrame:
    """A row of each conversation: its signature, its spans over the pieces, and its faults."""
    gaps = F.when(F.col("high").isNull(), 0).otherwise(
        F.least(F.col("high").cast("decimal(20,0)") - F.col("low") + 1 - F.col("turns"), F.lit(LONG - 1).cast("decimal(20,0)"))
    ).cast("long")
    own = F.array(F.struct("part", "number", F.length("symbols").cast("long").alias("length"))).cast(SPANS)
    names = ["known", "conv", "signature", "spans", "low", "high", *COUNTERS]
    whole = cut.where(~F.col("open")).withColumn("signature", F.col("symbols")).withColumn("spans", own).select(names)
    kinds = f"known boolean, conv long, signature string, spans {SPANS}, low long, high long, " + ", ".join(f"{c} long" for c in COUNTERS)
    rest = cut.where("open").drop("rows", "open").groupBy("known", "conv").applyInPandas(joined, kinds)
    return whole.unionByName(rest).select(
        "known", "conv", "signature", "spans", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal")


class WordGraph:
    """Classes of nodes by their differences of cost-to-go between the grammar states, solved from the end."""

    def __init__(self):
        self.vectors: list[tuple] = [AT_END]
        self.numbers: dict[tuple, int] = {AT_END: 0}
        self.steps: dict[tuple[int, str], tuple[int, int, str]] = {}

    def step(self, after: int, symbol: str) -> tuple[int, int, str]:
        """The class before a symbol, the cost that it adds to all states, and the first edit of each state's best audit."""
        if (after, symbol) not in self.steps:
            costs, letters = zip(*self.solved(self.vectors[after], symbol))
            least = min(costs)
            vector = tuple(c - least for c in costs)
            if vector not in self.numbers:
                self.numbers[vector] = len(self.vectors)
                self.vectors.append(vector)
            self.steps[after, symbol] = self.numbers[vector], least, "".join(letters)
        return self.steps[after, symbol]

    @staticmethod
    def solved(after: tuple, symbol: str) -> list[tuple[int, str]]:
        best = []
        for state in range(4):
            options = [(DELETE + after[state], "D")]
            if symbol != "x":
                more = UNFINISHED if symbol.isupper() else 0
                if (state, symbol.lower()) in KEPT:
                    options.append((more + after[KEPT[state, symbol.lower()]], "K"))
                options.append((more + RETYPE + after[NEXT[state]], "R"))
            best.append(min(options))
        # No cycle of insertions is free, so as many rounds as there are states settle them.
        for _ in range(4):
            best = [min(best[state], (INSERT + best[NEXT[state]][0], "I")) for state in range(4)]
        return best

    def audit(self, signature: str, classes: array) -> str:
        """The best audit from the first symbol on; ``classes`` has those after each symbol, the last symbol's first."""
        out, state = [], 0
        for i, symbol in enumerate(signature):
            letters = self.step(classes[len(signature) - 1 - i], symbol)[2]
            while letters[state] == "I":
                out.append("I")
                state = NEXT[state]
            out.append(letters[state])
            state = after_edit(state, letters[state], symbol)
        while state in (1, 2):
            out.append("I")
            state = NEXT[state]
        return "".join(out)


def after_edit(state: int, edit: str, symbol: str) -> int:
    return state if edit == "D" else KEPT[state, symbol.lower()] if edit == "K" else NEXT[state]


SOLVED = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs and audits of signatures that come sorted by their reverse, so what they share is still there."""
    graph = WordGraph()
    classes, costs = array("l", [0]), array("q", [0])
    before = ""
    for rows in batches:
        out = []
        for turned in rows.column("turned").to_pylist():
            same = 0
            for a, b in zip(before, turned):
                if a != b:
                    break
                same += 1
            del classes[same + 1:], costs[same + 1:]
            for symbol in turned[same:]:
                number, cost, _ = graph.step(classes[-1], symbol)
                classes.append(number)
                costs.append(costs[-1] + cost)
            before = turned
            signature = turned[::-1]
            out.append((signature, costs[-1] + graph.vectors[classes[-1]][0], graph.audit(signature, classes)))
        yield batch(SOLVED, list(zip(*out)) if out else [[]] * len(SOLVED))


def audits(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of different signatures."""
    turned = signatures.distinct().select(F.reverse("signature").alias("turned"))
    # A border of a range holds a bounded part of a signature; the hash splits those that all end alike.
    ranged = turned.repartitionByRange(F.left("turned", F.lit(64)), F.xxhash64("turned")).sortWithinPartitions("turned")
    return ranged.mapInArrow(solve, "signature string, cost long, audit string")


SHARES = pa.schema([
    ("known", pa.bool_()), ("conv", pa.int64()), ("part", pa.int32()), ("number", pa.int32()), ("edits", pa.list_(pa.string())),
    ("places", pa.list_(pa.int64())), ("inserted", pa.list_(pa.struct([("place", pa.int64()), ("role", pa.string())]))),
])
SHARES_TYPE = (
    "known boolean, conv long, part int, number int, edits array<string>, places array<long>, "
    "inserted array<struct<place: long, role: string>>"
)


def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the audit says of each piece: the new role of each row that may stay, ``K`` for its own and null for none,
    its place, and the rows that are inserted before it."""
    for rows in batches:
        out = []
        names = ("known", "conv", "signature", "spans", "audit")
        for known, conv, signature, spans, audit in zip(*[rows.column(c).to_pylist() for c in names]):
            edits, at, state, place = iter(audit), 0, 0, 0
            for number, span in enumerate(spans):
                new: list[str | None] = []
                places: list[int] = []
                inserted: list[dict] = []
                end = at + span["length"]
                while at < end or number == len(spans) - 1:
                    edit = next(edits, None)
                    if edit is None:
                        break
                    if edit == "I":
                        state = NEXT[state]
                        inserted.append({"place": place, "role": ROLE[state]})
                        place += 1
                        continue
                    symbol = signature[at]
                    at += 1
                    state = after_edit(state, edit, symbol)
                    if symbol != "x":
                        new.append(None if edit == "D" else "K" if edit == "K" else ROLE[state])
                        places.append(place)
                    place += edit != "D"
                out.append((known, conv, span["part"], span["number"], new, places, inserted))
        yield batch(SHARES, list(zip(*out)) if out else [[]] * len(SHARES))


def repair(rows: DataFrame) -> Repaired:
    """The cheapest repair of each conversation in ``rows`` (conv_id, turn, role, text)."""
    each = keyed(rows)
    order = ["known", "conv", "placed", "turn", "role", "head", "digest"]
    cut = pinned(light(each).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, PIECE_TYPE))
    found = pinned(conversations_of(cut))
    solved = pinned(audits(found.select("signature")))
    whole = pinned(lookup_join(found, solved, "signature", ["conv"]))
    share = pinned(whole.select("known", "conv", "signature", "spans", "audit").mapInArrow(shares, SHARES_TYPE))
    edited = cut.select("known", "conv", "part", "number", "rows").join(share, ["known", "conv", "part", "number"]).select(
        "known", "conv", F.explode(F.arrays_zip("rows", "edits", "places")).alias("e")
    ).where(F.col("e.edits").isNotNull()).select("known", "conv", "e.rows.*", "e.edits", F.col("e.places").alias("place"))
    texts = each.groupBy(*KEY).agg(F.first("text").alias("text"))
    stay = edited.join(texts, KEY).select(
        "known", "conv", "place", F.when(F.col("edits") == "K", F.col("role")).otherwise(F.col("edits")).alias("role"), "text")
    new = share.select("known", "conv", F.explode("inserted").alias("i")).select("known", "conv", "i.*", F.lit("").alias("text"))
    return Repaired(whole.drop("signature", "spans"), stay.unionByName(new))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by a hash of their conversation and turn: dropped, emptied, cut, repeated or given to the user."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", named("conv_id"), named("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(named("text"), ENDS, "")).otherwise(named("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(named("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def digests(rows: DataFrame) -> DataFrame:
    """(known, conv, repaired_sha256) of repaired rows, read in order as a stream."""
    schema = pa.schema([("known", pa.bool_()), ("conv", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for part in batches:
            out = []
            for known, conv, role, text in zip(*[part.column(c).to_pylist() for c in ("known", "conv", "role", "text")]):
                if (known, conv) != at:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = (known, conv), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield batch(schema, list(zip(*out)) if out else [[]] * 3)
        if at is not None:
            yield batch(schema, [[at[0]], [at[1]], [state.hexdigest()]])

    dealt = rows.repartition("known", "conv").sortWithinPartitions("known", "conv", "place")
    return dealt.mapInArrow(run, "known boolean, conv long, repaired_sha256 string")


def repair_damage(conversations: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of every conversation after :func:`damaged`."""
    done = repair(damaged(conversations))
    conv = F.col("conv_id").cast("long")
    ids = conversations.select(conv.isNotNull().alias("known"), F.coalesce(conv, F.lit(0)).alias("conv")).distinct()
    met = ids.join(done.conversations, ["known", "conv"], "left").join(digests(done.rows), ["known", "conv"], "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = hashlib.sha256(b"").hexdigest()
    return met.select(
        F.when(F.col("known"), F.col("conv")).alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))

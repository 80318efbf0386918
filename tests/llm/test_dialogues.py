"""Conversation repair beside a plain search that compares whole audits."""

import hashlib
import random
import re
import zlib

import plain
import pytest
from opinionmill.llm import dialogues, queries

SCHEMA = "conv_id long, turn long, role string, text string, known int, signature string, place int"


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.md5(r[2].encode()).digest()))


def expected(rows):
    shown = lambda x: " " if x is None else str(x)
    groups = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", shown(text)) if kind == 2 else shown(text)
        role = "user" if kind == 4 else shown(role)
        groups.setdefault(conv, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = []
    for conv, group in groups.items():
        *figures, left = plain.repaired(ordered(group))
        out.append((conv, *figures, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()))
    return sorted(map(str, out))


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    assert sorted(str(tuple(r)) for r in dialogues.repair_damage(df).collect()) == expected(rows)


def test_op11(spark, sf, frame):
    rows = [tuple(r) for r in frame("conversations")[["conv_id", "turn", "role", "text"]].itertuples(index=False)]
    assert sorted(str(tuple(r)) for r in queries.op11_dialogues(spark, sf).collect()) == expected(rows)


@pytest.mark.parametrize("piece", [4096, 7])
def test_odd_rows_and_a_hot_conversation(spark, monkeypatch, piece):
    """Half of the rows are one conversation, which lies in many partitions and pieces."""
    monkeypatch.setattr(dialogues, "PIECE", piece)
    rng = random.Random(piece)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "User", "admin"]
    texts = ["Yes.", "No", "  \n", None, "", "Hm!", "a b. ", "long word " * 9 + ".", "x?\r\n\v", "Ünï. 漢字"]
    rows = [(
        rng.choice([1, 1, 1, 1, 2, 3, None, *range(10, 40)]), rng.choice([None, *range(250), -(1 << 63), (1 << 63) - 1]) if i % 50 == 0
        else rng.choice([None, *range(250)]), rng.choice(roles), rng.choice(texts)) for i in range(700)]
    extreme = [(5, -(1 << 62), "user", "a."), (5, 1 << 62, "assistant", "b.")]
    rows = [r for r in rows if r[1] is None or abs(r[1]) < 1 << 60] + extreme + [(4, 9, "user", "Same.")] * 40
    check(spark, rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dialogues.repair_damage(df).count() == 0 and dialogues.repair(df).rows.count() == 0


def test_repaired_rows_come_in_order(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "user", "Why?"), (1, 3, "assistant", "So.")]
    done = dialogues.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = [(r.place, r.role, r.text) for r in done.rows.orderBy("place").collect()]
    *_, cost, audit, left = plain.repaired([r[1:] for r in rows])
    assert [(r, t) for _, r, t in got] == left and [p for p, _, _ in got] == list(range(len(got)))
    assert [(r.cost, r.audit) for r in done.conversations.collect()] == [(cost, audit)]


def test_a_class_is_solved_once():
    graph = dialogues.WordGraph()
    for _ in range(3):
        number = 0
        for symbol in "uaUAxosu" * 50:
            number, _, _ = graph.step(number, symbol)
    assert len(graph.vectors) < 60 and len(graph.steps) < 200

"""Near-duplicates, repeated passages and components beside plain versions."""

import hashlib
import random

import numpy as np
import plain
import pytest
from opinionmill.llm import graph, queries, repeats, simhash
from pyspark.sql import functions as F


def check_near(pairs, rows):
    wanted = plain.near_components([i for i, _ in pairs], [t or "" for _, t in pairs])
    got = sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in rows.collect())
    assert got == sorted(str((i, *w)) for (i, _), w in zip(pairs, wanted))


def test_op10(spark, sf, frame):
    docs = frame("documents")
    check_near(list(zip(docs["doc_id"].tolist(), docs["text"])), queries.op10_simhash(spark, sf))


def test_near_duplicates_of_odd_texts(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check_near(rows, simhash.near_duplicates(odd))
    assert simhash.near_duplicates(empty).count() == 0
    left = simhash.kept(odd)
    assert left.columns == odd.columns
    # 1 stands for the texts without words; 4 for those that say one.
    assert sorted(r.doc_id for r in left.collect()) == [1, 4, 5, 6, 7, 8, 9, 10]


def test_each_component_keeps_one_row(made):
    a, b, c, d, e, f = ("apples grow on trees", "ships cross the sea", "nobody reads long letters", "the moon is far away",
                        "rain fell all night", "seven cats slept here")
    rows = [(3, a), (7, a), (7, b), (5, c), (None, c), (None, d), (None, d.upper()), (None, d), (8, e), (8, f), (9, f)]
    left = [(r.doc_id, r.text.lower()) for r in simhash.kept(made(rows)).collect()]
    assert sorted(left, key=str) == sorted([(3, a), (7, b), (5, c), (None, d), (8, e), (8, f)], key=str)


def test_near_copies_in_a_crowd(made):
    """Crowded anchors, cut into blocks, lose no link."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    rows = []
    for i in range(400):
        words = base.copy()
        for _ in range(i % 12):
            words[rng.randrange(400)] = f"v{rng.randrange(90)}"
        rows.append((i, " ".join(words)))
    rows += [(400 + i, " ".join(f"u{rng.randrange(300)}" for _ in range(50))) for i in range(100)]
    docs = made(rows)
    prints = simhash.fingerprints(docs).select("print").distinct()
    links = simhash.links(prints, few=2, block=7)
    found = {r["node"]: r["root"] for r in graph.components(links).collect()}
    texts = [t for _, t in rows]
    values = np.unique(np.array([plain.fingerprint(t) for t in texts], np.uint64))
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 3]
    signed = values.view(np.int64)
    roots = plain.roots(len(values), pairs)
    least = {r: min(signed[k] for k in range(len(values)) if roots[k] == r) for r in set(roots)}
    assert {int(s): found.get(int(s), int(s)) for s in signed} == {int(s): int(least[r]) for s, r in zip(signed, roots)}
    check_near(rows, simhash.near_duplicates(docs))


def test_every_link_meets_at_an_anchor():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = np.uint64(rng.integers(0, 2**63)) * np.uint64(2) + np.uint64(rng.integers(0, 2))
        b = a
        for bit in rng.permutation(64)[:rng.integers(0, 4)]:
            b ^= np.uint64(1) << np.uint64(bit)
        met = False
        for which in (0, 1):
            x, y = (np.array([(v >> np.uint64(32 * which)) & np.uint64(0xFFFFFFFF)]) for v in (a, b))
            met |= simhash.homes(x)[0] in simhash.replicas(y)[1]
            assert len(set(simhash.replicas(y)[1].tolist())) == len(simhash.replicas(y)[1])
        assert met


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1_000 + i, 999) for i in range(200)] + [(5_000, 5_000)]
    rows = graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in rows} == {**{i: 0 for i in range(1, 61)}, **{1_000 + i: 999 for i in range(200)}}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def check_repeats(pairs, rows, length=repeats.LENGTH):
    texts = [(t or "").encode() for _, t in pairs]
    wanted = []
    for (name, _), text, gone in zip(pairs, texts, plain.covered(texts, length)):
        digest = hashlib.sha256(plain.kept_bytes(text, gone)).hexdigest()
        left = plain.kept_bytes(text, gone).decode("utf-8", "ignore")
        wanted.append((name, len(text), int(gone.sum()), plain.runs(gone), digest, left))
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in rows.collect())


def test_ids_at_the_end_of_their_range(made):
    text = "".join(random.Random(2).choice("abcdefgh ") for _ in range(500))
    rows = [(-(1 << 63), text), (None, text), (None, None), (-(1 << 63), None)]
    check_repeats(rows, repeats.remove_repeats(made(rows)))


def test_near_copies_bring_one_row_of_spans_each(made, monkeypatch):
    """Places meet one row for each segment, however many of its windows repeat."""
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh ") for _ in range(1_500))
    rows = []
    for i in range(400):
        at = rng.randrange(1_500)
        rows.append((i, base[:at] + rng.choice("xyz") + base[at + 1:]))
    pinned, tables = repeats.pinned, []

    def kept(df):
        tables.append(pinned(df))
        return tables[-1]

    monkeypatch.setattr(repeats, "pinned", kept)
    found = repeats.repeated_windows(repeats.keyed(made(rows)), few=5)
    spans = {r["id"]: repeats.merged(r["spans"]) for r in found.collect()}
    texts = [t.encode() for _, t in rows]
    assert spans == {i: [(a, b + 1) for a, b in repeats.spans_of(g)] for (i, _), g in zip(rows, plain.covered(texts, 400)) if g.any()}
    [marks] = [t for t in tables if "spread" in t.columns and "spans" in t.columns]
    assert marks.where("not spread").groupBy("anchor", "content").count().where("count > 1").isEmpty()


def test_op9(spark, sf, frame):
    docs = frame("documents")
    check_repeats(list(zip(docs["doc_id"].tolist(), docs["text"])), queries.op9_repeats(spark, sf))


def test_repeats_of_odd_texts(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check_repeats(rows, repeats.remove_repeats(odd))
    assert repeats.remove_repeats(empty).count() == 0


def passages(count):
    """Texts that share passages at different places, with different neighbours, and copies."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz éü"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    common, second = text(700), text(450)
    rows = []
    for i in range(count):
        body = text(rng.randrange(0, 500)) + common[rng.randrange(0, 60):700 - rng.randrange(0, 60)] + text(rng.randrange(0, 300))
        rows.append((i, body + second if i % 4 == 0 else body))
    rows += [(count + i, rows[i][1]) for i in range(5)]
    return [*rows, (count + 9, text(390) + "q" * 900), (count + 10, "ab" * 700), (count + 11, text(399)), (count + 12, text(400))]


@pytest.mark.parametrize("few, bucket", [(1_000, 1 << 20), (3, 4_000)])
def test_passages_in_many_texts(made, few, bucket):
    """Anchors that are spread over several buckets lose no match."""
    pairs = passages(60)
    rows = repeats.keyed(made(pairs))
    spans = {r["id"]: repeats.merged(r["spans"]) for r in repeats.repeated_windows(rows, few, bucket).collect()}
    texts = [t.encode() for _, t in pairs]
    for (name, _), gone in zip(pairs, plain.covered(texts, repeats.LENGTH)):
        assert spans.get(name, []) == [(a, b + 1) for a, b in repeats.spans_of(gone)]


def test_copies_of_a_row_are_fetched_once(made, monkeypatch):
    rng = random.Random(17)
    passage, *own = ["".join(rng.choice("abcdefgh ") for _ in range(900)) for _ in range(4)]
    rows = [(1, own[0] + passage)] * 70 + [(None, own[1] + passage)] * 50 + [(2, passage + own[2])]
    pinned, tables = repeats.pinned, []

    def kept(df):
        tables.append(pinned(df))
        return tables[-1]

    monkeypatch.setattr(repeats, "pinned", kept)
    check_repeats(rows, repeats.remove_repeats(made(rows)))
    repeats.repeated_windows(repeats.keyed(made(rows)), few=1)
    [fetched] = [t for t in tables if "bytes" in t.columns and "bucket" in t.columns]
    assert 0 < fetched.count() == fetched.select("anchor", "content").distinct().count()


def test_texts_are_cut_into_segments_once(spark, made, monkeypatch):
    cut = spark.sparkContext.accumulator(0)
    find = repeats.occurrences

    def counted(rows, length):
        found = find(rows, length)

        def seen(batches):
            for part in batches:
                cut.add(part.num_rows)
                yield part

        return found.mapInArrow(seen, found.schema)

    monkeypatch.setattr(repeats, "occurrences", counted)
    words = " ".join(f"word{i}" for i in range(200))
    pairs = [(1, words), (2, "a " + words + " b"), (3, " ".join(f"other{i}" for i in range(300)))]
    docs = made(pairs)
    check_repeats(pairs, repeats.remove_repeats(docs))
    assert cut.value == find(repeats.keyed(docs), repeats.LENGTH).count() > 0


def test_whole_words_of_long_passages_go(made, odd):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 9))) for _ in range(n))
    long, short, other = words(60), words(40), words(51)
    rows = [(i, f"{words(30)} {long} {words(20)}") for i in range(6)] + [(10 + i, f"{words(30)} {short}\n{words(9)}") for i in range(4)]
    rows += [(20 + i, f"{words(25)}\n{other}") for i in range(2)] + [(30 + i, words(200)) for i in range(9)] + [(50, long), (51, "")]
    docs = made(rows)
    left = repeats.kept(docs)
    assert left.columns == docs.columns and left.schema == docs.schema
    got = {r.doc_id: r.text for r in left.collect()}
    texts = [t.encode() for _, t in rows]
    assert got == {
        i: plain.without_passages(t, g, repeats.PASSAGE_WORDS).decode() for (i, _), t, g in zip(rows, texts, plain.covered(texts, repeats.PASSAGE))}
    # Passages of over 50 words are gone, the rest is as it was.
    assert not any(long in t or other in t for t in got.values())
    assert all(got[i] == t for i, t in rows if 10 <= i < 20 or i >= 30 and i != 50)
    assert all(len(got[i].split()) == len(t.split()) - 60 for i, t in rows if i < 6)
    assert left.where(F.length("text") != F.col("n_chars")).count() == 0
    assert repeats.kept(odd).count() == 13


def test_statistics_are_the_longest_matches_elsewhere():
    rng = random.Random(4)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 50))) for _ in range(rng.randint(1, 6))]
        copies = np.array([rng.choice([1, 1, 1, 3]) for _ in texts])
        index = repeats.RunLengthIndex(texts, copies)
        assert index.runs[1].sum() == sum(c * (len(t) + 1) for c, t in zip(copies, texts))
        begins = index.ends - np.array([len(t) for t in texts])
        found = index.statistics()
        places = [(t, i) for t in range(len(texts)) for i in range(len(texts[t]))]
        for t, i in places:
            match = lambda u, j: next((n for n, (a, b) in enumerate(zip(texts[t][i:], texts[u][j:])) if a != b), min(len(texts[t]) - i, len(texts[u]) - j))  # noqa: E731, E501
            own = len(texts[t]) - i if copies[t] > 1 else 0
            assert found[begins[t] + i] == max((match(u, j) for u, j in places if (u, j) != (t, i)), default=0) or found[begins[t] + i] == own
            assert found[begins[t] + i] >= own

"""Packing, sharding, BPE and the two text classifiers beside plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from opinionmill.llm import bpe, language, packing, quality, queries, sharding
from opinionmill.llm.common import distinct_sample, pinned
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def check_packing(docs, pieces, window=2048):
    tokenizer = Tokenizer.from_file(BYTES)
    expected = {}
    for name, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected.setdefault((name is None, name or 0, len(ids)), []).append(ids)
    got = pieces.assign(none=pieces["doc_id"].isna(), name=pieces["doc_id"].fillna(0).astype(int))
    by_key = {(bool(a), int(b), int(c)): g for (a, b, c), g in got.groupby(["none", "name", "doc_tokens"])}
    assert by_key.keys() == expected.keys()
    for key, group in by_key.items():
        ids = expected[key][0]
        pieces_ = sorted(zip(group["start"], group["length"], group["ids_crc32"]))
        wanted = sorted((s, n, zlib.crc32(ids[s:s + n].tobytes())) for s, n in {(s, n) for s, n, _ in pieces_})
        assert pieces_ == sorted(wanted * len(expected[key]))
        ends = np.cumsum([n for _, n, _ in wanted])
        assert [s for s, _, _ in wanted] == [0, *ends[:-1]] and ends[-1] == len(ids)
    for _, group in pieces.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert list(group["offset"]) == list(group["length"].cumsum() - group["length"])
        assert group["length"].sum() <= window


def test_op1(spark, sf, frame):
    docs, pieces = frame("documents"), queries.op1_packing(spark, sf).toPandas()
    check_packing(zip(docs["doc_id"], docs["text"]), pieces)
    filled = pieces["length"].sum() / (2048 * pieces["sequence_id"].nunique())
    assert filled > 0.97


def test_packing_of_odd_texts(odd, empty):
    rows = [(None if r.doc_id is None else r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    check_packing(rows, packing.pack(odd, BYTES).toPandas())
    assert packing.pack(empty, BYTES).count() == 0


def test_packing_of_long_blank_texts(made):
    rows = [(1, " " * 30_000), (2, "\n" * 30_000), (3, "a" + " " * 30_000 + "b c"), (4, "one two"), (5, "\u2003\t\r\n" * 10_000)]
    check_packing(rows, packing.pack(made(rows), BYTES).toPandas())


def test_the_window_count_rises_with_the_capacity_exceeded():
    place, windows = packing.balance([6, 6, 6], 10)
    assert windows == 3 and sorted(place) == [0, 1, 2]
    rng = random.Random(1)
    sizes = [rng.randint(1, 512) for _ in range(900)]
    place, windows = packing.balance(sizes, 2048)
    loads = np.bincount(place, sizes, minlength=windows)
    assert loads.max() <= 2048 and loads.max() - loads.min() < 60 and windows <= sum(sizes) / 2048 * 1.02 + 1


def check_shards(texts, rows, shards=24):
    assert len(rows) == len(texts)
    wanted = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in texts)
    assert wanted == sorted(zip(rows["size"], rows["text_crc32"]))
    assert set(rows["law"]) <= {"bytes"} and rows["grown_shard"].isna().all() and rows["shard"].between(0, shards - 1).all()
    for _, group in rows.groupby("shard"):
        assert sorted(group["slot"]) == list(range(len(group)))
    loads = rows.groupby("shard")["size"].sum()
    share = rows["size"].sum() / shards
    assert (abs(loads - share) <= 2 * rows["size"].max() + 0.01 * share).all()


def test_op3(spark, sf, frame):
    docs, rows = frame("documents"), queries.op3_sharding(spark, sf).toPandas()
    check_shards(list(zip(docs["doc_id"], docs["text"])), rows)
    assert sorted(rows["doc_id"]) == sorted(docs["doc_id"])


def test_a_text_in_a_third_of_the_rows_is_cut_by_rows(made):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " + "x" * (i % 50)) for i in range(6_000)]
    out = sharding.shard(made(rows), least_ranges=96, rows_per_range=100).toPandas()
    check_shards(rows, out)
    assert out[out["text_crc32"] == zlib.crc32(b"same text")]["shard"].nunique() >= 4
    others = out[out["text_crc32"] != zlib.crc32(b"same text")]
    assert (others.groupby("text_crc32")["shard"].nunique() == 1).all()


def test_shards_of_odd_texts(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    check_shards(rows, sharding.shard(odd).toPandas())
    assert sharding.shard(empty).count() == 0


def check_round_trips(texts, rows):
    tokenizer = Tokenizer.from_file(WORDS)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = []
    for name, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        wanted.append((name, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in rows.collect())


def test_op5(spark, sf, frame):
    docs = frame("documents")
    check_round_trips(zip(docs["doc_id"].tolist(), docs["text"]), queries.op5_bpe(spark, sf))


def test_round_trips_of_odd_texts(odd, empty):
    check_round_trips([(r.doc_id, r.text) for r in odd.collect()], bpe.round_trips(odd, WORDS))
    assert bpe.round_trips(empty, WORDS).count() == 0


@pytest.mark.parametrize("leaf, window", [(8, 2), (16, 4), (64, 16), (300, 64)])
def test_halves_join_exactly(leaf, window):
    rng = random.Random(leaf)
    encoder = bpe.TreeEncoder(WORDS, leaf, window)
    letters = "abcdefgh' \n\t.,!?0123éß漢字😀é 'sΣİ" + "the of and" * 3
    for _ in range(150):
        some = rng.choice([letters, "".join(letters.split()), "a", "ab", "the", "'s!", "1", "漢", "é", "!'s", "<|endoftext|>a"])
        text = "".join(rng.choice(some) for _ in range(rng.choice([20, 100, 600, 2000])))
        assert encoder.encode(text) == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_parts_of_words_keep_their_ids():
    encoder = bpe.TreeEncoder(WORDS)
    words = ["The", "THE!!", "Éeau,", "it's", "ouier###", "x.", "...", "a1", "Straße;", "ŉ.", "İ.", "é.", "µ", "ÿ?!", "ſ."]
    encoder.learn([words])
    for word in words:
        assert list(encoder.known[word]) == encoder.tokenizer.encode(word, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def larger(sf):
    return sf.replace("sf0.001", "sf0.01")


def test_op2(spark, larger):
    rows = queries.op2_quality(spark, larger).toPandas()
    docs = pd.read_parquet(f"{larger}/documents.parquet")
    labels = pd.read_parquet(f"{larger}/labels.parquet")
    assert sorted(rows["doc_id"]) == sorted(docs["doc_id"]) and rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= 0.5)).all()
    assert (rows["held_out"] == rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    met = rows[rows["held_out"]].merge(labels, on="doc_id")
    ranks = met["score"].rank()
    good = met["quality"] == 1
    area = (ranks[good].mean() - ranks[~good].mean()) / len(met) + 0.5
    assert area > 0.9 and (met["predicted"] == met["quality"]).mean() > 0.95


def test_quality_of_odd_texts(spark, odd, empty, larger):
    labels = queries.table(spark, larger, "labels")
    rows = quality.classify(odd, labels).toPandas()
    assert len(rows) == 13 and rows["score"].between(0, 1).all()
    assert quality.classify(empty, labels).count() == 0
    none = spark.createDataFrame([(1, None, None), (None, 1, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    assert set(quality.classify(odd, none).toPandas()["score"]) == {0.5}
    assert quality.kept(odd, none).columns == odd.columns and quality.kept(odd, none).count() == 13


def test_one_class_gives_its_share(spark, made):
    labels = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert set(quality.classify(made([(i, f"text {i}") for i in range(9)]), labels).toPandas()["score"]) == {1.0}


def test_op8(spark, larger):
    rows, docs = queries.op8_language(spark, larger).toPandas(), pd.read_parquet(f"{larger}/documents.parquet")
    assert sorted(rows["doc_id"]) == sorted(docs["doc_id"]) and rows["score"].between(0, 1).all()
    assert (rows["held_out"] == rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    met = rows[rows["held_out"]].merge(docs, on="doc_id")
    lettered = met["text"].map(lambda t: any(c.isalpha() for c in t))
    assert (met["lang_pred"] == met["lang"])[lettered].mean() > 0.97 and (met["lang_pred"][~lettered] == "und").all()


def test_languages_of_odd_texts(odd, empty):
    rows = language.identify(odd).toPandas()
    assert len(rows) == 13 and list(rows["lang_pred"]).count("und") == 5
    assert language.identify(empty).count() == 0
    assert language.kept(odd, least_score=0).columns == odd.columns and language.kept(odd, least_score=0).count() == 8


def test_nothing_to_learn_from_is_unknown(made):
    rows = language.identify(made([(1, "some text"), (2, None)], lang=None)).toPandas()
    assert set(rows["lang_pred"]) == {"und"} and set(rows["score"]) == {0.0}


def test_gradients_of_the_bytes_network():
    """Backpropagation through time beside differences."""
    net = language.new_network(["a", "b", "c"], 3, 1)
    layer = tuple(w.astype(float) for w in net.forward)
    bytes_ = np.random.default_rng(1).integers(0, 4, (5, 4)).astype(np.uint8)
    pull = np.random.default_rng(2).normal(size=(4, 5, 3))
    keep: list = []
    language.read(layer, bytes_, keep)
    grads = language.read_back(layer, bytes_, keep, pull)
    loss = lambda: (language.read(layer, bytes_).astype(float) * pull).sum()
    for weight, grad in zip(layer, grads):
        for at in [tuple(np.random.default_rng(i).integers(0, s) for s in weight.shape) for i in range(5)]:
            at = (at[0] % 4, *at[1:]) if weight.shape[0] == 256 else at
            before = weight[at]
            weight[at] = before + 1e-2
            up = loss()
            weight[at] = before - 1e-2
            down = loss()
            weight[at] = before
            assert grad[at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_a_row_in_most_of_the_table_is_dealt_to_all_groups(spark, made):
    """Copies of a row that lie in many tasks: no group of pieces or range of rows has much over its share."""
    docs = made([(1, "one text of some words that comes again and again")] * 6_400 + [(i, f"text {i}") for i in range(2, 500)]).repartition(64)
    pieces = packing.piece_rows(docs, queries.tokenizer("byte_bpe_50k.json"), 2048, 1, 512).toPandas()
    assert not pieces.duplicated(["doc_id", "start", "task", "copy"]).any()
    rows = pinned(sharding.sized(docs))
    total = rows.agg({"size": "sum"}).first()[0]
    ranges = sharding.measured(sharding.ranged(rows, sharding.splitters(rows, total, 100, 2.0)))
    assert ranges["size"].max() <= 2 * total / 100 and ranges["n"].sum() == len(pieces) == 6_898


def test_repeated_rows_and_ids_do_not_fill_the_samples(spark, made, monkeypatch):
    """An id with thousands of rows, equal ones and different ones, brings no more to the driver than the sample allows."""
    docs = made([(1, "good words all over")] * 3_000 + [(3, f"bad {i} $$$") for i in range(3_000)] + [(None, f"x {i}") for i in range(500)])
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "held_out", lambda c: F.lit(False))
    met = []
    monkeypatch.setattr(quality, "calibration", lambda x, y: met.append(len(x)) or (np.zeros(0), np.zeros(0), np.ones(0)))
    quality.fit(docs, labels, 100)
    assert not met or max(met) < 320
    rows = docs.select("doc_id", "text", F.lit("en").alias("lang"))
    assert 60 < distinct_sample(rows, "text", 100, seed=21, by="lang").count() < 160

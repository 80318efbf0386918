"""The key index beside merges without one."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from opinionmill.operators.ingest import merge_append
from opinionmill.plans.batch import stage_to_raw
from opinionmill.plans.membership import KeyIndex


def loads(rng):
    """Batches with new, repeated, known and null keys."""
    out = []
    for n in range(4):
        rows = [(rng.choice([None, *[f"k{i}" for i in range(60 * (n + 1))]]), rng.randrange(3)) for _ in range(120)]
        out.append(rows)
    return out


@pytest.fixture
def index(spark, tmp_path):
    return KeyIndex(spark, str(tmp_path / "index"), str(tmp_path / "indexed"), "key", segments=5)


def test_loads_equal_those_without_an_index(spark, tmp_path, index):
    for rows in loads(random.Random(3)):
        batch = spark.createDataFrame(rows, "key string, value int")
        assert merge_append(spark, batch, index.table, "key", index=index) == merge_append(spark, batch, str(tmp_path / "plain"), "key")
        got, wanted = (sorted(map(str, spark.read.parquet(p).collect())) for p in (index.table, str(tmp_path / "plain")))
        assert got == wanted


def damage(folder):
    """Make the files of a table unreadable, of the same names and sizes."""
    for path in glob.glob(f"{folder}/*.parquet"):
        size = os.path.getsize(path)
        with open(path, "wb") as file:
            file.write(b"x" * size)
        crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
        if os.path.exists(crc):
            os.remove(crc)


def test_a_load_reads_nothing_of_the_stored_table(spark, index):
    keys = lambda a, b: spark.range(a, b).select(F.concat(F.lit("k"), "id").alias("key"))
    assert merge_append(spark, keys(0, 500), index.table, "key", index=index) == 500
    damage(index.table)
    # Half of them are known, and a read of any stored key would fail.
    assert merge_append(spark, keys(250, 750), index.table, "key", index=index) == 250
    damage(index.table)
    assert merge_append(spark, keys(0, 750), index.table, "key", index=index) == 0
    assert index.known(keys(700, 800)).count() == 50


def test_files_that_come_and_go_behind_its_back(spark, tmp_path, index):
    keys = lambda a, b: spark.range(a, b).select(F.concat(F.lit("k"), "id").alias("key"))
    # Rows that a load wrote before it was lost, without a part of the index.
    keys(0, 10).write.parquet(index.table)
    assert merge_append(spark, keys(5, 15), index.table, "key", index=index) == 5
    assert index.known(keys(0, 100)).count() == 15
    # A compaction into other files, and rows that are deleted.
    keys(0, 12).coalesce(1).write.mode("overwrite").parquet(index.table)
    assert sorted(r.key for r in index.known(keys(0, 100)).collect()) == sorted(f"k{i}" for i in range(12))


def test_filters_rule_out_nearly_all_new_keys(spark, index):
    keys = lambda a, b: spark.range(a, b).select(F.concat(F.lit("k"), "id").alias("key"))
    merge_append(spark, keys(0, 5_000), index.table, "key", index=index)
    rows = spark.read.parquet(f"{index.root}/parts").select("segment", "n", F.length("bits").alias("bytes"), F.length("digests").alias("all")).collect()
    assert sum(r["n"] for r in rows) == 5_000 == sum(r["all"] for r in rows) // 16
    assert all(2 * r["n"] <= r["bytes"] <= 4 * r["n"] + 128 for r in rows) and len(rows) == 5
    from opinionmill.plans import membership

    held = [bytes(r["bits"]) for r in spark.read.parquet(f"{index.root}/parts").where("segment = 0").collect()][0]
    others = [bytes(r[0]) for r in keys(10_000, 20_000).select(membership.digest(F.col("key"))).collect()]
    assert membership._may_have(held, others).mean() < 0.01


def test_one_key_in_most_rows(spark, index):
    rows = [("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(100)]
    assert merge_append(spark, spark.createDataFrame(rows, "key string, value int"), index.table, "key", index=index) == 101
    assert index.known(spark.createDataFrame(rows, "key string, value int")).count() == 101


def test_stage_to_raw_with_an_index(spark, tmp_path):
    for name in ("products", "reviews"):
        spark.createDataFrame([("1", "a"), ("2", "b")], "ID string, BODY string").write.parquet(str(tmp_path / "source" / name))
    assert stage_to_raw(spark, str(tmp_path), indexed=True) == {"products": 2, "reviews": 2}
    assert stage_to_raw(spark, str(tmp_path), indexed=True) == {"products": 0, "reviews": 0}
    assert spark.read.parquet(str(tmp_path / "raw" / "reviews")).count() == 2

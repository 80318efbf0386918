"""The sample of a store beside the sample of all its rows."""

import datetime as dt
import os
import random

import pytest

from opinionmill.operators.quality import stratified_sample
from opinionmill.plans.rollups import Rollup
from opinionmill.plans.sample import StoreSample
from opinionmill.plans.store import ReviewStore
from opinionmill.schemas import OUTCOMES, REVIEWS_FAST


@pytest.fixture
def store(spark, tmp_path):
    return ReviewStore(spark, str(tmp_path / "store"))


def facts(spark, rng, ids):
    """Half of the rows share a stratum; some have none, some have no id, and a twentieth is there twice."""
    rows = [(
        None if i % 50 == 49 else str(i), "HOT", rng.choice(["good", "", None]), rng.choice([5, 5, 5, 1, 2, None]), None, 0.5, "FAST_ONLY",
        dt.datetime(2024, 1, 1),
    ) for i in ids]
    return spark.createDataFrame(rows + rows[::20], REVIEWS_FAST)


def outcomes(spark, ids):
    return spark.createDataFrame([(str(i), ["a"] if i % 2 else None, 3, "late", dt.datetime(2024, 2, 1)) for i in ids], OUTCOMES)


def check(store, k=7):
    got, wanted = StoreSample(store, k).table(), stratified_sample(store.enriched(), k)
    assert sorted(got.columns) == sorted(wanted.columns)
    as_rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    found = as_rows(got)
    assert found == as_rows(wanted)
    return len(found)


def test_the_sample_follows_loads_outcomes_and_compactions(spark, store):
    rng = random.Random(3)
    assert check(store) == 0
    store.write_facts(facts(spark, rng, range(120)), "a")
    assert check(store) == 21
    store.write_facts(facts(spark, rng, range(120, 300)), "b")
    store.write_facts(facts(spark, rng, []), "empty")
    store.write_outcomes(outcomes(spark, range(0, 200)), "one")
    check(store)
    store.compact()
    check(store)
    store.write_facts(facts(spark, rng, range(300, 310)), "c")
    store.write_outcomes(outcomes(spark, range(150, 310, 3)), "two")
    check(store)
    assert store.compact() == 2 and store.clean() > 0
    check(store)
    # Only the sketch of the base is left to read; those of its loads can go.
    sample = StoreSample(store, 7)
    assert sample.clean() == 5 and sample.clean() == 0 and len(sample.refresh()) == 1
    # More than there is of any stratum.
    check(store, 1000)


def test_a_new_load_ranks_itself_only(spark, store):
    rng = random.Random(4)
    store.write_facts(facts(spark, rng, range(400)), "a")
    sample = StoreSample(store, 5)
    [first] = sample.refresh()
    assert spark.read.parquet(first).count() <= 15
    written = os.stat(os.path.join(first, "_SUCCESS")).st_mtime_ns
    store.write_facts(facts(spark, rng, range(400, 500)), "b")
    files = sample.table().inputFiles()
    assert len(sample.refresh()) == 2 and files and all("/sample/" in f for f in files)
    assert os.stat(os.path.join(first, "_SUCCESS")).st_mtime_ns == written


def broken_off(path):
    """What a job leaves that ends between two files."""
    os.remove(os.path.join(path, "_SUCCESS"))
    for name in sorted(f for f in os.listdir(path) if f.endswith(".parquet"))[:1]:
        os.remove(os.path.join(path, name))
        if os.path.exists(os.path.join(path, f".{name}.crc")):
            os.remove(os.path.join(path, f".{name}.crc"))


def test_half_written_sketches_and_partials_are_written_anew(spark, store):
    rng = random.Random(5)
    store.write_facts(facts(spark, rng, range(200)).repartition(4), "a")
    store.write_outcomes(outcomes(spark, range(50)).repartition(4), "a")
    rows = lambda df: sorted(map(str, df.collect()))
    sample, partials = rows(StoreSample(store, 9).table()), rows(Rollup(store).table())
    for path in StoreSample(store, 9).refresh() + Rollup(store).refresh():
        broken_off(path)
    assert rows(StoreSample(store, 9).table()) == sample and rows(Rollup(store).table()) == partials
    assert store.has_outcomes("a")
    broken_off(os.path.join(store.root, "outcomes", "load_id=a"))
    assert not store.has_outcomes("a")

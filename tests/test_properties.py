"""Expressions beside plain Python on many generated values."""

import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from opinionmill.functions.hashing import row_hash
from opinionmill.functions.text import is_missing, parse_keywords, view_name
from opinionmill.operators.enrich import split_completion
from opinionmill.plans.joins import without_known

NEAR_SENTINELS = st.text(alphabet="nNaAuUlL \t\n  x0,", max_size=8)
# One call takes many values, as every call is a Spark job.
MANY = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def missing(value):
    return value is None or value.strip().upper() in ("NAN", "NA", "NULL", "")


@MANY
@given(values=st.lists(st.none() | NEAR_SENTINELS | st.text(max_size=20), min_size=150, max_size=300))
def test_missing(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.m for r in df.select("i", is_missing(F.col("v")).alias("m")).collect()}
    assert got == {i: missing(v) for i, v in enumerate(values)}


@MANY
@given(values=st.lists(st.text(alphabet="ab, \t ", max_size=12), min_size=100, max_size=200))
def test_keywords(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.k for r in df.select("i", parse_keywords(F.col("v")).alias("k")).collect()}
    assert got == {i: split_completion(v) for i, v in enumerate(values)}


@MANY
@given(rows=st.sets(st.tuples(*[st.none() | st.text(alphabet="1-:a", max_size=3)] * 3), min_size=100, max_size=300))
def test_row_hash_is_one_to_one(spark, rows):
    df = spark.createDataFrame(list(rows), "a string, b string, c string")
    assert df.select(row_hash(df.columns)).distinct().count() == len(rows)


@MANY
@given(names=st.lists(st.text(alphabet="vVwW_tb", min_size=1, max_size=8), min_size=50, max_size=100))
def test_view_names(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(view_name(F.col("n"))).collect()]
    assert got == ["VW_" + n.upper().removeprefix("VW_") for n in names]


@pytest.mark.parametrize("limit", [0, 3, 100_000])
@settings(MANY, max_examples=2)
@given(
    batch=st.lists(st.tuples(st.integers(0, 20), st.none() | st.integers(0, 3)), max_size=60),
    target=st.sets(st.integers(0, 20), max_size=10),
)
def test_merge(spark, limit, batch, target):
    from opinionmill.plans import joins

    kept = joins.fits_broadcast.__defaults__, joins.local_copy.__defaults__
    joins.fits_broadcast.__defaults__ = joins.local_copy.__defaults__ = (limit, 1 << 26)
    try:
        got = without_known(
            spark.createDataFrame(batch, "id int, v int"), spark.createDataFrame([(t,) for t in target], "id int"), "id")
        rows = sorted((r.id, -1 if r.v is None else r.v) for r in got.collect())
    finally:
        joins.fits_broadcast.__defaults__, joins.local_copy.__defaults__ = kept
    expected = {}
    for key, v in batch:
        if key not in target:
            expected[key] = min(expected.get(key, math.inf), -1 if v is None else v)
    assert rows == sorted(expected.items())

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from opinionmill.functions.hashing import row_hash
from opinionmill.functions.typing import as_staging, typed_reviews, whole_number
from opinionmill.operators.ingest import (
    add_missing_columns, add_row_hash, clean_nulls, csv_to_array, ingest_raw, merge_append, merge_append_table, merged,
    new_rows, raw_projection, upper_columns,
)
from opinionmill.schemas import REVIEWS_STAGING


@pytest.mark.parametrize("text, kept", [
    (None, None), ("nan", None), ("NaN", None), ("NAN", None), ("na", None), ("NA", None), ("null", None),
    ("NULL", None), ("", None), ("   ", None), (" \t\n ", None), (" Null ", None), ("hello", "hello"),
    ("  hello ", "  hello "), ("nano", "nano"), ("null and void", "null and void"), ("n a", "n a"), ("0", "0"),
])
def test_clean_text(spark, text, kept):
    assert clean_nulls(spark.createDataFrame([(text,)], "v string")).first()[0] == kept


def test_clean_other_types(spark):
    df = spark.createDataFrame(
        [(0, False, 3.14, 0.0), (None, None, math.nan, None)], "i int, b boolean, d double, f float")
    first, second = clean_nulls(df).collect()
    assert (first.i, first.b, first.d, first.f) == (0, False, 3.14, 0.0)
    assert tuple(second) == (None, None, None, None)


def test_clean_with_own_sentinels(spark):
    df = spark.createDataFrame([("?",), (" none ",), ("na",), ("",)], "v string")
    assert [r[0] for r in clean_nulls(df, ("?", "NONE")).collect()] == [None, None, "na", ""]


def test_upper_columns(spark):
    assert upper_columns(spark.createDataFrame([(1, 2)], "id int, Stars int")).columns == ["ID", "STARS"]


def test_row_hash_tells_nulls_and_borders_apart(spark):
    df = spark.createDataFrame(
        [("ab", "c"), ("a", "bc"), ("-", None), (None, "-"), ("", None), (None, ""), (None, None), ("1:a", "b"), ("a", "1:b")],
        "x string, y string")
    assert df.select(row_hash(["x", "y"])).distinct().count() == df.count()


def test_row_hash_repeats(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None)], "n int, s string, t string")
    assert add_row_hash(df).select("row_hash").distinct().count() == 1


def test_raw_projection_is_text(spark):
    raw = raw_projection(spark.createDataFrame([(1, 2.5, True)], "a int, b double, c boolean"))
    assert {f.dataType.simpleString() for f in raw.schema} == {"string"}
    assert raw.first()[:3] == ("1", "2.5", "true")


@pytest.mark.parametrize("text, number", [
    ("5", 5), ("4.5", 5), ("-4.5", -5), ("5.0", 5), ("x", None), ("", None), (None, None), ("1e2", 100),
])
def test_whole_number(spark, text, number):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(whole_number(F.col("v"))).first()[0] == number


def test_staging_by_name(spark):
    df = spark.createDataFrame([("R1", "4.0", "x")], "ID string, STARS string, EXTRA string")
    staged = as_staging(df, REVIEWS_STAGING)
    assert staged.schema == REVIEWS_STAGING
    assert (staged.first().ID, staged.first().STARS, staged.first().BODY) == ("R1", 4, None)


def test_typed_reviews(spark):
    raw = spark.createDataFrame(
        [("1", "A", "b", "5", " true ", "7"), ("2", "A", "b", "many", "FALSE", None), ("3", "A", "b", None, None, "x")],
        "id string, asin string, body string, stars string, verified_purchase string, found_helpful string")
    got = [(r.stars, r.verified_purchase, r.found_helpful) for r in typed_reviews(raw).orderBy("id").collect()]
    assert got == [(5, True, 7), (None, False, None), (None, None, None)]


SCHEMA = "id string, note string"


def test_merge_takes_each_key_once(spark, rows):
    target = spark.createDataFrame([("a", "old")], SCHEMA)
    batch = spark.createDataFrame([("a", "new"), ("b", "2"), ("b", "1"), ("c", None), ("c", "x")], SCHEMA)
    assert rows(merged(batch, target, "id")) == {("a", "old"), ("b", "1"), ("c", None)}


def test_rows_without_a_key_are_all_new(spark):
    target = spark.createDataFrame([(None, "x")], SCHEMA)
    batch = spark.createDataFrame([(None, "x"), (None, "x"), ("a", "y")], SCHEMA)
    assert new_rows(batch, target, "id").count() == 3


def test_merge_append_twice(spark, tmp_path):
    path = str(tmp_path / "raw")
    batch = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2")], SCHEMA)
    assert merge_append(spark, batch, path, "id") == 2
    assert merge_append(spark, batch, path, "id") == 0
    assert merge_append(spark, spark.createDataFrame([("c", "3"), ("a", "9")], SCHEMA), path, "id") == 1
    assert spark.read.parquet(path).count() == 3


def test_ingest_raw_twice(spark, tmp_path):
    path = str(tmp_path / "raw")
    source = spark.createDataFrame([("a", 1, dt.date(2024, 1, 1)), ("a", 2, None), ("a", 2, None)], "id string, n int, d date")
    assert ingest_raw(spark, source, path) == 2
    assert ingest_raw(spark, source, path) == 0


def test_merge_into_bucketed_table(spark, plan):
    batch = spark.createDataFrame([("a", "1"), ("b", "2")], SCHEMA)
    assert merge_append_table(spark, batch, "raw_notes", "id", buckets=4) == 2
    assert merge_append_table(spark, batch.union(spark.createDataFrame([("c", "3")], SCHEMA)), "raw_notes", "id", 4) == 1
    assert spark.table("raw_notes").count() == 3


def test_bucketed_target_is_not_shuffled(spark, plan):
    spark.createDataFrame([("a", "1"), ("b", "2")], SCHEMA).write.bucketBy(4, "id").saveAsTable("bucketed_notes")
    batch = spark.createDataFrame([("a", "1"), ("c", "2")], SCHEMA).repartition(4, "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(batch.join(spark.table("bucketed_notes").select("id"), "id", "left_anti"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange") == 1


def test_add_missing_columns(spark):
    df = spark.createDataFrame([(1,)], "STARS int")
    out = add_missing_columns(df, {"stars": ("int", 0), "retry_count": ("int", 0)})
    assert out.columns == ["STARS", "retry_count"] and out.first() == (1, 0)


def test_csv_to_array(spark):
    df = spark.createDataFrame([(" a, b ,,c ",), ("",), (None,)], "keywords string")
    assert [r[0] for r in csv_to_array(df, "keywords", "keywords").collect()] == [["a", "b", "c"], [], None]

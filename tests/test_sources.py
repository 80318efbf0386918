import csv
import io
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from opinionmill.functions.text import view_name as view_name_column
from opinionmill.schemas import PIPELINE_LOGS
from opinionmill.session import shared_folder
from opinionmill.sources import quoted_csv
from opinionmill.sources.mirror import mirror_schema, view_name
from opinionmill.sources.tables import (
    append, append_log, csv_parts, exists, first_available, has_rows, read_csv, write_clustered,
)

NAMES = {
    "TB_REVIEWS": "VW_TB_REVIEWS", "VW_TB_REVIEWS": "VW_TB_REVIEWS", "tb_products": "VW_TB_PRODUCTS",
    "vw_tb_products": "VW_TB_PRODUCTS", "TB_VW_SOMETHING": "VW_TB_VW_SOMETHING", "mixed_Case": "VW_MIXED_CASE",
}


@pytest.mark.parametrize("name, view", NAMES.items())
def test_view_name(spark, name, view):
    assert view_name(name) == view
    assert spark.range(1).select(view_name_column(F.lit(name))).first()[0] == view


def test_mirror_and_mirror_of_mirror(spark):
    spark.sql("CREATE SCHEMA raw_layer")
    spark.range(3).write.saveAsTable("raw_layer.tb_reviews")
    spark.range(2).write.saveAsTable("raw_layer.tb_products")
    assert {tuple(r) for r in mirror_schema(spark, "raw_layer", "silver_layer").collect()} == {
        ("VW_TB_REVIEWS", True, None), ("VW_TB_PRODUCTS", True, None)}
    assert mirror_schema(spark, "silver_layer", "gold_layer").where("created").count() == 2
    assert spark.table("gold_layer.VW_TB_REVIEWS").count() == 3
    assert mirror_schema(spark, "raw_layer", "silver_layer").where("created").count() == 2


def test_mirror_goes_on_after_a_failure(spark):
    spark.sql("CREATE SCHEMA broken_layer")
    spark.range(1).write.saveAsTable("broken_layer.tb_gone")
    spark.range(1).write.saveAsTable("broken_layer.tb_here")
    spark.sql("CREATE VIEW broken_layer.on_gone AS SELECT * FROM broken_layer.tb_gone")
    spark.sql("DROP TABLE broken_layer.tb_gone")
    done = {r.name: r for r in mirror_schema(spark, "broken_layer", "mended_layer").collect()}
    assert done["VW_TB_HERE"].created and not done["VW_ON_GONE"].created and done["VW_ON_GONE"].error


def test_read_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        'id,Body,stars\n1,"He said ""no"",\nand left",5\n2,plain,\n3,too,many,values\n4,last,1\n', encoding="utf-8")
    path = str(tmp_path / "r.csv")
    df = read_csv(spark, path, bad_rows="skip")
    assert df.columns == ["ID", "BODY", "STARS"]
    assert [tuple(r) for r in df.orderBy("ID").collect()] == [
        ("1", 'He said "no",\nand left', "5"), ("2", "plain", None), ("4", "last", "1")]
    assert df.count() == 3
    with pytest.raises(PySparkException, match="too many values"):
        read_csv(spark, path).collect()
    with pytest.raises(PySparkException, match="too many values"):
        read_csv(spark, path).count()
    with pytest.raises(ValueError):
        read_csv(spark, path, bad_rows="drop")


@pytest.mark.parametrize("multi_line", [True, False])
def test_no_line_is_lost(spark, tmp_path, multi_line):
    lines = ["1,a,b", "2,short", "3,too,many,values", "4", '5,"a, ""quoted""",x', '6,"a, b",c,d', "7,,", "8,x,y,", "9,long,"]
    (tmp_path / "r.csv").write_text("id,body,stars\n" + "\n".join(lines) + "\n", encoding="utf-8")
    good, bad = csv_parts(spark, str(tmp_path / "r.csv"), multi_line)
    assert [tuple(r) for r in good.orderBy("ID").collect()] == [
        ("1", "a", "b"), ("2", "short", None), ("4", None, None), ("5", 'a, "quoted"', "x"), ("7", None, None), ("9", "long", None)]
    assert sorted(r.line.strip() for r in bad.collect()) == ["3,too,many,values", '6,"a, b",c,d', "8,x,y,"]
    assert good.count() + bad.count() == len(lines) and good.select("ID").count() == 6


@pytest.fixture
def ranges(spark):
    """Sets the size of the ranges of bytes that files are read in."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def resize(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 1)

    yield resize
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def random_csv(rng, end, rows=200):
    def value():
        kind = rng.random()
        if kind < 0.3:
            return rng.choice("abx") + "".join(rng.choice('ab x5é\ue000"') for _ in range(rng.randint(0, 5)))
        if kind < 0.4:
            return ""
        return '"' + "".join(rng.choice(["a", "b", ",", "\n", '""', "é", "\ue000", " "]) for _ in range(rng.randint(0, 12))) + '"'

    return "id,body,more" + end + end.join(f"{i},{value()},{value()}" for i in range(rows)) + rng.choice(["", end])


@pytest.mark.parametrize("seed", [1, 2])
def test_any_ranges_give_the_rows_of_the_whole_file(spark, tmp_path, ranges, seed):
    rng = random.Random(seed)
    text, windows = random_csv(rng, "\n"), random_csv(rng, "\r\n")
    for name, content in (("a", text), ("b", windows)):
        (tmp_path / f"{name}.csv").write_text(content, encoding="utf-8", newline="")
    whole = spark.read.csv(str(tmp_path / "a.csv"), header=True, quote='"', escape='"', multiLine=True).collect()
    rows = list(csv.reader(io.StringIO(windows, newline="")))[1:]
    for size in (40, 500):
        ranges(size)
        assert quoted_csv._lines(spark, str(tmp_path / "a.csv")).select("start").distinct().count() > 5
        assert sorted(map(tuple, read_csv(spark, str(tmp_path / "a.csv")).collect()), key=str) == sorted(map(tuple, whole), key=str)
        # Carriage returns in a value stay; an empty value is null.
        got = read_csv(spark, str(tmp_path / "b.csv")).collect()
        assert sorted(map(tuple, got), key=str) == sorted((tuple(v or None for v in r) for r in rows), key=str)


def test_a_folder_of_files_and_records_over_many_ranges(spark, tmp_path, ranges):
    long = "\n".join(f'line {i} ""quoted"", with, commas' for i in range(60))
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f'id,"the\nbody"\n{i},"{long}"\n{i + 10},x\n{i + 20},a,b\n', encoding="utf-8")
    for size in (64, 1 << 20):
        ranges(size)
        good, bad = csv_parts(spark, str(tmp_path))
        assert sorted(map(tuple, good.collect())) == sorted(
            [(str(i), long.replace('""', '"')) for i in range(3)] + [(str(i + 10), "x") for i in range(3)])
        assert sorted(r.line for r in bad.collect()) == ["20,a,b", "21,a,b", "22,a,b"]


def test_values_of_private_use_are_values(spark, tmp_path):
    (tmp_path / "r.csv").write_text("id,body\n6,\ue000,7\n8,\ue000\n", encoding="utf-8")
    good, bad = csv_parts(spark, str(tmp_path / "r.csv"))
    assert [tuple(r) for r in good.collect()] == [("8", "\ue000")] and [r.line for r in bad.collect()] == ["6,\ue000,7"]


def test_first_available(spark, tmp_path):
    logs = spark.createDataFrame([("x",)], "message string")
    logs.createOrReplaceTempView("logs_here")
    missing = [lambda: spark.table("no_such_table"), lambda: spark.read.parquet(str(tmp_path / "none"))]
    assert first_available(spark, [*missing, lambda: spark.table("logs_here")], PIPELINE_LOGS).count() == 1
    empty = first_available(spark, missing, PIPELINE_LOGS)
    assert empty.schema == PIPELINE_LOGS and empty.count() == 0
    both = [lambda: spark.table("logs_here").limit(0), lambda: spark.table("logs_here")]
    assert first_available(spark, both, PIPELINE_LOGS, has_rows).count() == 1


def test_first_available_raises_other_errors(spark):
    with pytest.raises(PySparkException):
        first_available(spark, [lambda: spark.range(1).select("no_such_column")], PIPELINE_LOGS)


def test_log_is_cut_and_never_fails(spark, tmp_path):
    path = str(tmp_path / "logs")
    assert append_log(spark, path, "m" * 5000, "WARN")
    row = spark.read.parquet(path).first()
    assert len(row.message) == 4000 and row.level == "WARN" and row.log_timestamp is not None
    (tmp_path / "file").write_text("x")
    assert not append_log(spark, str(tmp_path / "file"), "lost")


def test_append(spark, tmp_path):
    path = str(tmp_path / "t")
    append(spark.range(2), path)
    append(spark.range(3), path)
    assert exists(spark, path) and spark.read.parquet(path).count() == 5


def test_clustered_layout_splits_a_hot_product(spark, tmp_path, plan):
    path = str(tmp_path / "clustered")
    df = spark.range(4000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("P"), F.col("id") % 50)).alias("asin"),
        (F.col("id") % 5 + 1).alias("stars"))
    write_clustered(df, path, partitions=8)
    stored = spark.read.parquet(path)
    assert stored.count() == 4000
    sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 2 * 4000 / 8
    assert "EqualTo(asin,P7)" in plan(stored.where("asin = 'P7'"))


def test_shared_folder(spark, tmp_path):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

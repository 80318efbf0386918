"""Readers and writers."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from opinionmill.schemas import PIPELINE_LOGS
from opinionmill.sources.quoted_csv import parsed, records

# Raised where a source is absent, as opposed to broken.
_ABSENT = {"TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND", "PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}

Loader = Callable[[], DataFrame]


def is_absent(error: AnalysisException) -> bool:
    return (error.getCondition() or "").split(".")[0] in _ABSENT


def _csv_records(spark: SparkSession, path: str, multi_line: bool) -> tuple[DataFrame, Column, list[Column]]:
    """All records of a CSV file as ``record``, whether one has too many values, and the columns that it is read as."""
    names = spark.read.options(quote='"', escape='"', multiLine=multi_line).csv(path, header=True).columns
    rows = records(spark, path, multi_line).withColumn("values", parsed(F.col("record"), names))
    return rows, F.col("n_values") > len(names), [F.col(f"values.c{i}").alias(n.upper()) for i, n in enumerate(names)]


def csv_parts(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows of a CSV file with a header and optional quotes, and the lines that don't fit it.

    Rows are all text, with upper-case names; a line with too few values is filled with nulls. A line with too many
    doesn't fit: it comes back as it is, in a column ``line``. Many tasks read a file, also with line breaks in quotes;
    without them ``multi_line`` may be off, which saves the first of two readings.
    """
    rows, too_long, columns = _csv_records(spark, path, multi_line)
    return rows.where(~too_long).select(columns), rows.where(too_long).select(F.col("record").alias("line"))


def read_csv(spark: SparkSession, path: str, multi_line: bool = True, bad_rows: str = "fail") -> DataFrame:
    """The rows of :func:`csv_parts`; a line that doesn't fit stops the read, or is passed over with "skip"."""
    rows, too_long, columns = _csv_records(spark, path, multi_line)
    if bad_rows == "skip":
        return rows.where(~too_long).select(columns)
    if bad_rows != "fail":
        raise ValueError(f"unknown way with bad rows: {bad_rows}")
    text = F.concat(F.lit(f"a line of {path} has too many values: "), F.left("record", F.lit(200)))
    return rows.where(F.when(too_long, F.raise_error(text).cast("boolean")).otherwise(F.lit(True))).select(columns)


def upper_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def read_path(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a readable parquet folder."""
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if is_absent(error):
            return False
        raise
    return True


def complete(spark: SparkSession, path: str) -> bool:
    """Whether the job that wrote ``path`` has ended; files of a job that broke off may lie there without its mark."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, which may lie on any file system of the cluster."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    return sorted(f.getPath().getName() for f in system.listStatus(at) if f.isDirectory())


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder that holds a file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(at) and any(f.isFile() for f in system.listStatus(at))


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Append, but write no empty file where ``df`` has no rows; it should be cheap to compute."""
    if not df.isEmpty():
        append(df, path)


def write_clustered(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write sorted by product and stars, so that filters on them skip files and row groups.

    The id is part of the range key: a product with a third of the rows spreads over many ranges.
    """
    by = ["asin", "stars", "id"]
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).write.mode("errorifexists").parquet(path)


def first_available(
    spark: SparkSession, loaders: list[Loader], empty_schema: T.StructType,
    usable: Callable[[DataFrame], bool] = lambda df: True,
) -> DataFrame:
    """The first source that exists and is ``usable``, else no rows of ``empty_schema``.

    Only absence is passed over; any other error is raised.
    """
    for load in loaders:
        try:
            df = load()
            if usable(df):
                return df
        except AnalysisException as error:
            if not is_absent(error):
                raise
    return spark.createDataFrame([], empty_schema)


def has_rows(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()


Entry = tuple[dt.datetime, str, str]


def log_entry(spark: SparkSession, level: str, message: str) -> Entry:
    """A run-log entry of now; levels are cut at 10 characters and messages at 4000, as the table holds them."""
    return spark.sql("SELECT localtimestamp()").first()[0], level[:10], message[:4000]


def append_log(spark: SparkSession, path: str, message: str, level: str = "INFO") -> bool:
    """Append a run-log row. A log that cannot be written must not fail the run."""
    return append_entries(spark, path, [log_entry(spark, level, message)])


def append_entries(spark: SparkSession, path: str, entries: list[Entry]) -> bool:
    """Append entries as one file."""
    return append_log_rows(spark.createDataFrame(entries, PIPELINE_LOGS), path) if entries else True


def append_log_rows(rows: DataFrame, path: str) -> bool:
    try:
        append(rows.coalesce(1), path)
    except Exception as error:  # noqa: BLE001 - see above
        logging.getLogger(__name__).warning("log entry not written: %s", error)
        return False
    return True


@contextmanager
def logged(spark: SparkSession, path: str | None, stage: str) -> Iterator[list[str]]:
    """Log the start and the end, or the error, of a stage; what is put into the list ends the last message.

    Both entries bear their own times and are written together, when the stage has ended.
    """
    notes: list[str] = []
    if not path:
        yield notes
        return
    entries = [log_entry(spark, "INFO", f"{stage} started")]
    try:
        yield notes
    except Exception as error:
        append_entries(spark, path, [*entries, log_entry(spark, "ERROR", f"{stage} failed: {error}")])
        raise
    append_entries(spark, path, [*entries, log_entry(spark, "INFO", " ".join([f"{stage} completed", *notes]))])

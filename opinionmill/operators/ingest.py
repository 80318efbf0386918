"""Cleaning, hashing and insert-only merging of input rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from opinionmill.functions.hashing import row_hash
from opinionmill.functions.text import NULL_SENTINELS, is_missing, parse_keywords
from opinionmill.plans.joins import without_known
from opinionmill.plans.membership import KeyIndex
from opinionmill.sources.tables import exists, read_path, upper_columns  # noqa: F401 - a step of ingestion too


def clean_nulls(df: DataFrame, sentinels: tuple[str, ...] = NULL_SENTINELS) -> DataFrame:
    """NaN and the spellings of "missing" become null; every other value is kept as it is."""
    def cleaned(field: T.StructField):
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            value = F.when(~is_missing(value, sentinels), value)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        return value.alias(field.name)

    return df.select([cleaned(f) for f in df.schema.fields])


def add_row_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("row_hash", row_hash(df.columns))


def raw_projection(df: DataFrame) -> DataFrame:
    """Every column as text, plus the row hash."""
    hashed = add_row_hash(df)
    return hashed.select([F.col(f"`{c}`").cast("string").alias(c) for c in hashed.columns])


def new_rows(batch: DataFrame, target: DataFrame, key: str, copies_equal: bool = False) -> DataFrame:
    """Rows to insert: one per key that the target lacks.

    Of rows that share a key the smallest one, column by column, is taken; ``copies_equal`` says
    that they do not differ, as with a row hash. A null key equals no other, so rows without a key
    are all new.
    """
    return without_known(batch, target, key, copies_equal)


def merged(batch: DataFrame, target: DataFrame, key: str, copies_equal: bool = False) -> DataFrame:
    """The target as it is after the insert-only merge."""
    return target.unionByName(new_rows(batch, target, key, copies_equal))


def merge_append(
    spark: SparkSession, batch: DataFrame, path: str, key: str, copies_equal: bool = False, index: KeyIndex | None = None,
) -> int:
    """Append the new rows of ``batch`` to the parquet folder at ``path``; returns how many.

    With an ``index`` of the folder its key column is not read, but for files that the index doesn't cover yet.
    """
    def write(df: DataFrame) -> None:
        df.write.mode("append").parquet(path)

    if index is None:
        target = read_path(spark, path) if exists(spark, path) else batch.limit(0)
        return _counted_append(batch, target, key, copies_equal, write)
    kept = batch.persist()
    try:
        known = index.known(kept)
        added = _counted_append(kept, known, key, copies_equal, write)
        known.unpersist()
        # The rows just written are known to the index from here on; the next load would see to it too.
        index.refresh()
    finally:
        kept.unpersist()
    return added


def merge_append_table(spark: SparkSession, batch: DataFrame, table: str, key: str, buckets: int = 200) -> int:
    """The same into a catalog table bucketed on the key, created where missing.

    The table's side of the anti-join is already partitioned, so only the batch is shuffled.
    """
    def write(df: DataFrame) -> None:
        (df.repartition(buckets, key).write.mode("append").format("parquet")
         .bucketBy(buckets, key).sortBy(key).saveAsTable(table))

    if not spark.catalog.tableExists(table):
        write(batch.limit(0))
    return _counted_append(batch, spark.table(table), key, False, write)


def _counted_append(
    batch: DataFrame, target: DataFrame, key: str, copies_equal: bool, write: Callable[[DataFrame], None],
) -> int:
    """Write the new rows of ``batch``, whose source is read once: the merge looks at it several times."""
    seen = Observation()
    kept = batch.persist()
    try:
        write(new_rows(kept, target, key, copies_equal).observe(seen, F.count(F.lit(1)).alias("n")))
    finally:
        kept.unpersist()
    return seen.get["n"]


def ingest_raw(spark: SparkSession, source: DataFrame, path: str, index: KeyIndex | None = None) -> int:
    """Hash a source and merge it on the hash into the raw folder; returns the rows added."""
    return merge_append(spark, raw_projection(source), path, "row_hash", copies_equal=True, index=index)


def add_missing_columns(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Add each column that is absent, as ``name: (type, default)``."""
    present = {c.lower() for c in df.columns}
    return df.select(
        "*",
        *[F.lit(default).cast(kind).alias(name)
          for name, (kind, default) in columns.items() if name.lower() not in present],
    )


def csv_to_array(df: DataFrame, csv_column: str, array_column: str) -> DataFrame:
    """Replace a comma-list column by an array column."""
    kept = [c for c in df.columns if c not in (csv_column, array_column)]
    return df.select(*kept, parse_keywords(F.col(csv_column)).alias(array_column))

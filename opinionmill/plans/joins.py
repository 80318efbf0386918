"""Joins that hold when a key carries a third of the rows or a side outgrows a broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# A side is broadcast only when it is proven to stay under both.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024

def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is small enough to broadcast.

    Fetches the widths of no more than ``max_rows + 1`` rows; the scan stops when it has them.
    """
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    widths = [row[0] for row in df.select(width).limit(max_rows + 1).collect()]
    return len(widths) <= max_rows and sum(widths) <= max_bytes


def local_copy(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame | None:
    """``df`` as rows held by the driver, for a broadcast, or None if it is not small enough for one."""
    # Widths come first: a hundred thousand wide values would fill the driver.
    few = df.limit(max_rows + 1).persist()
    try:
        return df.sparkSession.createDataFrame(few.collect(), df.schema) if fits_broadcast(few, max_rows, max_bytes) else None
    finally:
        few.unpersist()


def lookup_join(
    facts: DataFrame, lookup: DataFrame, key: str, spread_by: list[str], *, max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join of ``facts`` to ``lookup``, which has at most one row per key.

    A lookup that is small in rows and bytes is broadcast; else see :func:`salted_join`.
    """
    if fits_broadcast(lookup, max_rows):
        added = [c for c in lookup.columns if c != key]
        return facts.join(F.broadcast(lookup), key, "left").select(*facts.columns, *added)
    return salted_join(facts, lookup, key, spread_by)


def salted_join(facts: DataFrame, lookup: DataFrame, key: str, spread_by: list[str]) -> DataFrame:
    """Left join by shuffle where no key brings more rows to a task than an even share.

    A share is rows / (16 x shuffle partitions); a key with more facts is hot. Its facts are dealt to as
    many salts as it has shares, by the hash of ``spread_by``, and its lookup row is copied to each.
    There are fewer hot keys than shares, and they are broadcast as hashes, whatever their width. Facts
    without a key are spread too; they match nothing.
    """
    parts = 16 * int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = facts.select(F.count("*"))
    salts = F.ceil(F.col("n") * parts / total.scalar()).cast("int")
    hot = counts.where(F.col("n") * parts > total.scalar()).groupBy(F.xxhash64(key).alias("_hash")).agg(
        F.max(salts).alias("_salts")
    )

    def with_salts(df: DataFrame) -> DataFrame:
        return df.withColumn("_hash", F.xxhash64(key)).join(F.broadcast(hot), "_hash", "left")

    own = F.pmod(F.xxhash64(*spread_by), F.coalesce("_salts", F.lit(1))).cast("int")
    aside = F.concat(F.lit("-"), F.xxhash64(*spread_by).cast("string"))
    named = F.concat(F.lit("+"), F.col(key).cast("string"))
    left = with_salts(facts).select(*facts.columns, F.coalesce(named, aside).alias("_key"), own.alias("_salt"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    right = with_salts(lookup.where(F.col(key).isNotNull())).select(
        named.alias("_key"), copies.alias("_salt"), F.struct(*[c for c in lookup.columns if c != key]).alias("_met")
    )
    return left.join(right, ["_key", "_salt"], "left").select(
        *facts.columns, *[F.col(f"_met.{c}").alias(c) for c in lookup.columns if c != key]
    )


def first_n(df: DataFrame, n: int, keys: list[str], order: list[Column]) -> DataFrame:
    """The first ``n`` rows per key in ``order``; Spark applies the limit before the shuffle as well."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")


def first_rows(df: DataFrame, n: int, key: Column) -> DataFrame:
    """The ``n`` rows with the smallest ``key``, a struct; of rows with the last key any, as by a limit.

    Above ``BROADCAST_ROWS`` no task takes them all: keys are counted by ranges, whole ranges are taken, and only
    the range where the ``n`` rows end is sorted.
    """
    name = "_key"
    keyed = df.withColumn(name, key)
    if n <= BROADCAST_ROWS:
        return keyed.orderBy(name).limit(n).drop(name)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = keyed.select(name).repartitionByRange(parts, name).groupBy(F.spark_partition_id().alias("part")).agg(
        F.count("*").alias("n"), F.max(name).alias("last")).orderBy("part").collect()
    fields = keyed.schema[name].dataType.fields
    bound = lambda r: F.struct(*[F.lit(r["last"][f.name]).cast(f.dataType).alias(f.name) for f in fields])
    before, taken = 0, None
    for found in ranges:
        if before + found["n"] > n:
            whole = F.lit(False) if taken is None else F.col(name) <= bound(taken)
            last = keyed.where(~whole & (F.col(name) <= bound(found))).orderBy(name).limit(n - before)
            return keyed.where(whole).unionByName(last).drop(name)
        before, taken = before + found["n"], found
    return df


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``; of a hot key each task sends one row."""
    return first_n(df, 1, keys, order)


def without_known(batch: DataFrame, target: DataFrame, key: str, copies_equal: bool = False) -> DataFrame:
    """The rows of ``batch`` whose key does not occur in ``target``, one per key, and all rows without a key.

    Of rows that share a key the smallest one, column by column, is taken; ``copies_equal`` says that
    such rows do not differ. Keys are counted first, and only keys meet the target: a small batch goes
    to it by broadcast, so the target is not shuffled. Where few keys are repeated or known already,
    the rows of the batch stay where they lie; only rows of repeated keys are shuffled.
    """
    others = [] if copies_equal else [F.asc_nulls_first(c) for c in batch.columns if c.lower() != key.lower()]
    order = others or [F.col(key).asc()]
    known = target.select(F.col(key))
    keys = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).persist()
    try:
        distinct = keys.select(key)
        if fits_broadcast(distinct):
            held = known.join(F.broadcast(distinct), key, "left_semi").distinct()
        else:
            held = distinct.join(known, key, "left_semi")
        held, repeated = local_copy(held), local_copy(keys.where(F.col("n") > 1).select(key))
    finally:
        keys.unpersist()
    if held is None or repeated is None:
        once = first_per_key(batch.where(F.col(key).isNotNull()), [key], order).join(known, key, "left_anti")
        return once.select(batch.columns).unionByName(batch.where(F.col(key).isNull()))
    fresh = batch.join(F.broadcast(held), key, "left_anti")
    single = fresh.join(F.broadcast(repeated), key, "left_anti").select(batch.columns)
    if repeated.isEmpty():
        return single
    several = fresh.join(F.broadcast(repeated), key, "left_semi")
    return single.unionByName(first_per_key(several, [key], order).select(batch.columns))

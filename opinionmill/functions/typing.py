"""Casts that never raise: what does not parse becomes null."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from opinionmill.functions.text import strip


def whole_number(text: Column) -> Column:
    """Half-up rounded whole number, as a number column of scale 0 stores it."""
    return F.round(text.cast("string").try_cast("decimal(38,6)"), 0).try_cast("bigint")


def as_staging(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, by name, each cast to its type; absent ones are null."""
    present = {c.upper() for c in df.columns}

    def typed(field: T.StructField) -> Column:
        if field.name.upper() not in present:
            value = F.lit(None).cast(field.dataType)
        elif isinstance(field.dataType, T.LongType):
            value = whole_number(F.col(field.name))
        else:
            value = F.col(field.name).try_cast(field.dataType)
        return value.alias(field.name)

    return df.select([typed(f) for f in schema.fields])


def typed_reviews(raw: DataFrame) -> DataFrame:
    """All-text raw reviews with the types the enrich steps need."""
    text = [c for c in ("id", "asin", "body", "row_hash") if c in {n.lower() for n in raw.columns}]
    return raw.select(
        *[F.col(c).alias(c) for c in text],
        whole_number(F.col("stars")).alias("stars"),
        (F.upper(strip(F.col("verified_purchase"))) == "TRUE").alias("verified_purchase"),
        whole_number(F.col("found_helpful")).alias("found_helpful"),
    )

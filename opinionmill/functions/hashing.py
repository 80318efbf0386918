"""Row hash over all columns."""

from pyspark.sql import Column, functions as F


def row_hash(columns: list[str]) -> Column:
    """MD5 of the values in column order, nulls included.

    Every value is written as ``length:value`` and a null as ``-``, so two different rows never
    give the same text.
    """
    def part(name: str) -> Column:
        value = F.col(f"`{name}`").cast("string")
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.md5(F.concat(*[part(c) for c in columns]))

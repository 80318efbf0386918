"""Rounding that does not depend on the order in which floats were added."""

from pyspark.sql import Column, functions as F

# Wide enough for any sum here; nine places drop the noise of float addition.
_EXACT = "decimal(38,9)"


def round_half_up(value: Column, digits: int) -> Column:
    return F.round(value.try_cast(_EXACT), digits).cast("double")


def percent(condition: Column, digits: int = 1) -> Column:
    """Share of the rows of the group that meet ``condition``; null for an empty group."""
    return round_half_up(F.try_divide(F.count_if(condition) * 100, F.count("*")), digits)


def round_to_tenth(value: Column) -> Column:
    """Nearest tenth of a float between 0 and 100 by its exact binary value, ties to even.

    Spark's own rounding works on the shortest decimal text of a float, in which 0.05 is a tie; the
    float itself lies above it. Scaled by 2^56 such a float is a whole number, so this is exact.
    """
    one = 2 ** 56
    tenths = (value * F.lit(float(one))).cast("bigint").cast("decimal(20,0)") * 10
    rest = tenths % F.lit(one)
    whole = ((tenths - rest) / F.lit(one)).cast("bigint")
    up = (rest * 2 > one) | ((rest * 2 == one) & (whole % 2 == 1))
    return (whole + F.when(up, 1).otherwise(0)) / F.lit(10.0)

"""Times. ``as_of`` is the end of every rolling window: a timestamp, ISO text, or None for the present."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

AsOf = dt.datetime | str | None


def moment(as_of: AsOf) -> Column:
    return F.localtimestamp() if as_of is None else F.lit(as_of).cast("timestamp_ntz")


def last_days(time: str, as_of: AsOf, days: int = 30) -> Column:
    """From ``days`` before ``as_of`` up to it."""
    end = moment(as_of)
    return F.col(time).between(end - F.expr(f"INTERVAL {int(days)} DAYS"), end)


def seconds_between(start: Column, end: Column) -> Column:
    """Whole-second marks passed between two times."""
    return F.timestamp_diff("SECOND", F.date_trunc("second", start), F.date_trunc("second", end))

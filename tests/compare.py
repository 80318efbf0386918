"""Run queries beside their SQL twins and compare rows as bags of values."""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter

import duckdb

from checks.fixtures import TABLES


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return repr(float(value))
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value


def _bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def differences(db, df, sql: str) -> str | None:
    """None where both give the same rows, else what differs."""
    cursor = db.execute(sql)
    expected_names = [c[0] for c in cursor.description]
    expected = _bag(expected_names, cursor.fetchall())
    if sorted(df.columns) != sorted(expected_names):
        return f"columns {sorted(df.columns)} != {sorted(expected_names)}"
    got = _bag(df.columns, df.collect())
    if got == expected:
        return None
    extra, lacking = got - expected, expected - got
    return f"{sum(got.values())} rows, expected {sum(expected.values())}; extra {list(extra)[:2]}; lacking {list(lacking)[:2]}"

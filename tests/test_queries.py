"""Every query beside its SQL twin."""

import pytest

from __spark_entry__ import entry
from checks.oracle import oracle_sql
from checks.queries import queries
from compare import database, differences

SQL = oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    return database(sf)


def test_every_query_has_a_twin():
    assert queries().keys() == SQL.keys()


@pytest.mark.parametrize("name", queries())
def test_query(spark, sf, db, name):
    assert differences(db, queries()[name](spark, sf), SQL[name]) is None


def test_entry(spark):
    row = entry(spark).first()
    assert row["total"] > 0 and -1 <= row["avg_sentiment"] <= 1

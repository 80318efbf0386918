import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

EXTRA = "score double, label string, id int, print string, size string, spans int, _kept int, _quality int, _first int"
DOCUMENTS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


@pytest.fixture(scope="session")
def made(spark):
    """Documents of (doc_id, text) pairs, with further columns whose names clash with inner ones."""

    def make(pairs, lang="en"):
        rows = [(i, t, lang, None, None if t is None else len(t), *[None] * 9) for i, t in pairs]
        return spark.createDataFrame(rows, DOCUMENTS).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd(made):
    """Null, empty, blank, repeated and long texts, null and repeated ids."""
    long = " ".join(f"word{i % 997} thing{i % 89}" for i in range(60_000))
    return made([
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (None, "one"), (None, None), (5, "1234 !!"),
        (6, long), (7, "x" * 30_000), (8, "Ünï çødé 漢字 😀   é"), (9, "a\x00b \x1c c"), (10, "<|endoftext|> and <|startoftext|>"),
    ])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def frame(sf):
    """A test table in memory."""
    return lambda name: pd.read_parquet(f"{sf}/{name}.parquet")

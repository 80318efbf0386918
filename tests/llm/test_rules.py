"""Quality rules beside plain counts, and what their estimates reject."""

import random

import numpy as np
import pandas as pd
import plain
from opinionmill.llm import queries, rules
from pyspark.sql import functions as F


def check_counts(pairs, rows):
    wanted = []
    for name, text in pairs:
        counts = plain.rule_counts(text or "")
        wanted.append(str((name, *counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0])))
    got = [str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows]
    assert sorted(got) == sorted(wanted) and not any(r.kept for r in rows if r.base_failed)


def test_op12(spark, sf, frame):
    docs = frame("documents")
    rows = queries.op12_rules(spark, sf).collect()
    check_counts(list(zip(docs["doc_id"].tolist(), docs["text"])), rows)
    quality = frame("labels").set_index("doc_id")["quality"]
    left = [(r.kept, quality[r.doc_id]) for r in rows if not r.base_failed and r.doc_id in quality.index]
    assert np.mean([k for k, q in left if q == 1]) > 0.99 and np.mean([k for k, q in left if q == 0] or [0]) < 0.1


def test_rules_of_odd_texts(odd, empty):
    check_counts([(r.doc_id, r.text) for r in odd.collect()], rules.judge(odd).collect())
    assert rules.judge(empty).count() == 0


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_outliers_of_a_hot_source(spark, made):
    """Two thirds of the rows are copies of one text; junk in small groups is told by their language."""
    rng = random.Random(4)
    rows = [(i, prose(rng, 120), "en", f"s{i % 3}") for i in range(240)] + [(1_000, prose(rng, 90), "en", "s1")] * 600
    rows += [(2_000 + i, prose(rng, 100).replace(" ", " $$$ "), "en", ["s1", "small", None][i % 3]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in rules.judge(docs).collect()}
    assert [got[i] for i in range(240)] == [True] * 240 and got[1_000] and not any(got[2_000 + i] for i in range(12))
    # Too few texts for any estimate: only the base rules hold.
    few = docs.where(F.col("doc_id") >= 2_000)
    assert all(r.kept for r in rules.judge(few).collect())


def test_estimates_equal_plain_linear_algebra(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) * 40).round().astype(int)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list(rules.FEATURES)).assign(crowd="a", n=1))
    found = rules._estimates(rules._moments(rules._summed(df, ["crowd"]), ["crowd"]), ["crowd"])
    got = df.join(found, "crowd").select(*rules.FEATURES, rules.distance().alias("d")).toPandas()
    scatter = np.cov(x.T, bias=True) + np.diag((np.array(rules.FLOORS) * rules.STEPS) ** 2)
    off = got[list(rules.FEATURES)].to_numpy() - x.mean(0)
    assert np.allclose(got["d"], np.einsum("ij,jk,ik->i", off, np.linalg.inv(scatter), off))
    assert np.isclose(found.first()["log_determinant"] * 2, np.linalg.slogdet(scatter)[1])
    assert "Python" not in rules.judge(spark.createDataFrame([], "doc_id long, text string, lang string, source string"))._jdf.queryExecution().toString()

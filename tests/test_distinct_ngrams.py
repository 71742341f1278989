"""Distinct n-grams of a corpus by brute force, and what their count shuffles."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import features as ft
from corpusmill.operators import corpus

TEXTS = [None, "", "  ", "one", "a b", "A b a b a b", "a b c d e", "b c d e f g", "x_y z", "x y_z", "é ü é ü", "a b c d e"]


@pytest.mark.parametrize("max_n", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("lower", [True, False])
def test_distinct_ngrams_by_brute_force(spark, max_n, lower):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3)
    found = sorted((r.n, r.total, r.distinct) for r in corpus.distinct_ngrams(rows, max_n=max_n, lower=lower).collect())
    split = [(t.lower() if lower else t).split() for t in TEXTS if t]
    want = []
    for n in range(1, max_n + 1):
        grams = [tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1)]
        want.append((n, len(grams), len(set(grams))))
    assert found == want


@pytest.mark.parametrize("text", [None, "", "word"])
def test_sizes_without_grams_have_no_row(spark, text):
    rows = spark.createDataFrame([(text,)], "text string")
    assert [r.n for r in corpus.distinct_ngrams(rows).collect()] == ([1] if text else [])


def test_longer_grams_share_one_shuffle_of_texts(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    plan = corpus._distinct_windows(rows.selectExpr("split(text, ' ') AS _w"), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange SinglePartition") == 1


def test_vocabulary_applies_its_pattern_to_distinct_words(spark):
    texts = ["a b, b b c", "B x-y 12 é\n", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    made = corpus.vocabulary(rows)
    assert (made.first().tokens, made.first().vocabulary) == (7, 5)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("Generate") and "RLIKE" not in plan[plan.index("Generate") :]


def test_coherence_of_sets(spark):
    sets = [["a", "b"], ["b", "c"], [], ["c"], ["c"]]
    row = spark.createDataFrame([(sets,)], "w array<array<string>>").select(ft.coherence(F.col("w")).alias("x")).first()
    assert row.x == pytest.approx((1 / 3 + 0 + 0 + 1) / 4)
    assert "array_union" not in ft.coherence(F.col("w"))._jc.toString()

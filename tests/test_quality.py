"""Golden scores worked out by hand, and invariants."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import quality

LONG = (
    "Rivers shape valleys in several ways.\n\nFirst, running water carries sand which wears down rock. "
    "Second, floods move boulders that widen the bed.\n\nFinally, the theory of base level demonstrates where "
    "erosion ends. Therefore valleys grow wider over time because banks collapse."
)
ROWS = [
    (0, "Write a function that doubles a number.", "def twice(n):\n    return n * 2"),
    (1, "Explain tides.", "Tides rise and fall because the moon pulls the sea. They turn about twice a day."),
    (2, "wut", "4"),
    (3, "Analyze how rivers shape valleys.", LONG),
    (4, "", ""),
    (5, None, "Only a response here."),
    (6, " ", " \n "),
]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame(ROWS, "idx int, instruction string, response string")
    rows = quality.score_pairs(df).select("idx", "score", "components.*").collect()
    return {r.idx: r for r in rows}


def test_empty_pair(scored):
    row = scored[4]
    assert (row.clarity, row.response_quality, row.diversity) == (0.0, 0.0, 0.0)
    # complexity has no empty rule: 0.5, 0.4, 0.5, 0.6 and 0.6
    assert row.complexity == pytest.approx(0.52)
    assert row.score == pytest.approx(0.2 * 0.52)


def test_trivial_pair(scored):
    row = scored[2]
    # one word, no directive, one sentence without capital; ease = 206.835 - 1.015 - 84.6 > 80
    assert row.clarity == pytest.approx((0.3 + 0.6 + 0.9 + 1.0 + 0.5) / 5)
    # one word, a digit starts the line (a list), no punctuation, no content words
    assert row.response_quality == pytest.approx((0.2 + 0.7 + 0.8 + 0.7 + 0.3) / 5)
    # "wut 4": two distinct tokens, one bigram, no trigram
    assert row.diversity == pytest.approx((1.0 + 1.0 + 1.0 + 1.0) / 4)
    assert row.complexity == pytest.approx(0.52)


def test_code_pair(scored):
    row = scored[0]
    # 6 words, lines, no list, code asked for, two "sentences" at most, no end mark
    # content words: def is kept (3 letters), twice, return -> all distinct
    assert row.response_quality == pytest.approx((0.8 + 0.9 + 0.8 + 0.7 + 1.0) / 5)


def test_essay_beats_the_rest(scored):
    row = scored[3]
    assert row.complexity == max(r.complexity for r in scored.values())
    # instruction: analyze, how; response: first, second, finally, because, therefore; theory, demonstrates
    sentences = 5
    clauses = 3  # which, that, where
    expected = (1.0 + min(1.0, 0.4 + 5 * 0.15) + 0.5 + 1.0 + (0.5 + clauses / sentences * 0.5)) / 5
    assert row.complexity == pytest.approx(expected)


def test_blank_pair(scored):
    row = scored[6]
    # blank is not empty: the rules for no words apply
    assert row.clarity == pytest.approx((0.3 + 0.6 + 0.7 + 1.0 + 0.6) / 5)
    assert row.response_quality == pytest.approx((0.2 + 0.8 + 0.8 + 0.0 + 0.3) / 5)
    assert row.diversity == 0.0


def test_missing_instruction(scored):
    assert scored[5].clarity == 0.0
    assert scored[5].response_quality > 0.0


def test_scores_are_in_range(scored):
    for row in scored.values():
        assert all(0.0 <= v <= 1.0 for v in row[1:])


def test_total_is_weighted(spark):
    df = spark.createDataFrame(ROWS[:4], "idx int, instruction string, response string")
    only = {"clarity": 1.0, "response_quality": 0.0, "diversity": 0.0, "complexity": 0.0}
    rows = quality.score_pairs(df, weights=only).select("score", F.col("components.clarity").alias("c")).collect()
    assert all(r.score == pytest.approx(r.c) for r in rows)


def test_scorer_does_not_shuffle(spark):
    df = spark.range(10).select("id", F.lit("a b").alias("instruction"), F.lit("c d").alias("response"))
    plan = quality.score_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan

"""Answer rules, task tables and run comparisons."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.operators import compare, generation, grading

CASES = [
    ("any", ["paris"], 1, "It is PARIS.", True),
    ("any", ["paris"], 1, "Rome", False),
    ("all", ["1", "2", "3"], 3, "3 2 1", True),
    ("all", ["1", "2", "3"], 3, "1 and 2", False),
    ("at_least", ["red", "blue", "green"], 2, "Red, green", True),
    ("at_least", ["red", "blue", "green"], 2, "red red", False),
    ("number", ["1200"], 1, "about 1,200 people", True),
    ("number", ["1200"], 1, "about 12,0 people", False),
    ("count", ["\n", "•"], 4, "a\nb\nc\nd\ne", True),
    ("count", ["\n", "•"], 4, "•a •b", False),
    ("all_cs", ["def", "factorial"], 2, "def factorial(n)", True),
    ("all_cs", ["def", "factorial"], 2, "DEF factorial", False),
    ("any", ["hi"], 1, "this", True),
    ("any", ["x"], 1, None, False),
]


def test_rules(spark):
    rows = [(i, rule, tokens, k, answer) for i, (rule, tokens, k, answer, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, rule string, tokens array<string>, k int, response string")
    ok = grading.is_correct(F.col("response"), F.col("rule"), F.col("tokens"), F.col("k"))
    got = [r.ok for r in df.select("id", ok.alias("ok")).orderBy("id").collect()]
    assert got == [c[-1] for c in CASES]


def test_whole_words(spark):
    df = spark.createDataFrame([("this",), ("hi there",), ("(hi)",)], "response string")
    ok = grading.is_correct(F.col("response"), F.lit("any"), F.array(F.lit("hi")), F.lit(1), whole_words=True)
    assert [r.ok for r in df.select(ok.alias("ok")).collect()] == [False, True, True]


def test_generated_tasks_are_right(spark):
    ids = spark.range(500)
    for r in grading.arithmetic_tasks(ids, "id").collect():
        a, op, b = r.prompt.removeprefix("What is ").rstrip("?").split()
        low, high = (2, 12) if op == "*" else (10, 99)
        assert low <= int(a) <= high and low <= int(b) <= high
        assert eval(f"{a}{op}{b}") == int(r.answer)
    for r in grading.number_patterns(ids, "id").collect():
        x, y, z = map(int, r.prompt.removeprefix("Complete the pattern: ").removesuffix(", __").split(", "))
        assert y - x == z - y and int(r.answer) == 2 * z - y and 2 <= y - x <= 5
    for r in grading.letter_patterns(ids, "id").collect():
        x, y, z = map(ord, r.prompt.removeprefix("Complete the pattern: ").removesuffix(", __").split(", "))
        assert y - x == z - y and ord(r.answer) == 2 * z - y and 1 <= y - x <= 3
    again = grading.arithmetic_tasks(ids, "id").exceptAll(grading.arithmetic_tasks(ids, "id"))
    assert again.count() == 0


def test_fixed_tables(spark):
    assert grading.fixed_keys(spark).count() == len(fixed.ANSWER_KEYS)
    prompts = grading.prompt_table(spark).collect()
    assert all(p.prompt.startswith("### Instruction:\n") and p.expected_elements for p in prompts)
    assert grading.sample_prompts(spark).count() == 12


def test_grid(spark):
    grid = generation.prompt_grid(grading.prompt_table(spark), 4)
    temps = sorted({round(r.temperature, 6) for r in grid.collect()})
    assert grid.count() == 24 and temps == [0.7, 0.8, 0.9, 1.0]
    assert [r.temperature for r in generation.prompt_grid(spark.range(1), 1).collect()] == [0.7]


def test_empty_output_metrics(spark):
    df = spark.createDataFrame([(0, "", ["a"]), (1, "Same. Same.", [])], "id int, generated string, expected_elements array<string>")
    got = {r.id: r for r in generation.output_metrics(df, ["id"]).collect()}
    assert got[0].flesch_reading_ease is None and got[0].vocabulary_diversity == 0.0 and not got[0].ends_properly
    assert got[1].expected_elements_ratio == 1.0 and got[1].sentence_repetition == 0.5


def test_metric_stats(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", None, False), ("b", 0.5, True)], "g string, x double, f boolean")
    from corpusmill.operators import stats

    got = {(r.g, r.metric): (r["mean"], r["std"], r.ratio) for r in stats.metric_stats(df, "g", ["x", "f"]).collect()}
    assert got == {("a", "x"): (1.0, 0.0, 1.0), ("a", "f"): (0.5, 0.5, 0.5), ("b", "x"): (0.5, 0.0, None), ("b", "f"): (1.0, 0.0, 1.0)}


def test_consistency(spark):
    df = spark.createDataFrame([("p", "x"), ("p", "x"), ("p", "y"), ("q", "z")], "prompt string, response string")
    got = {r.prompt: r.consistency for r in grading.answer_consistency(df).collect()}
    assert got == {"p": 0.5, "q": 1.0}


@pytest.mark.parametrize("u,h,m,best", [(8.0, 10.0, 11.0, "ultra_high"), (10.0, 10.0, 12.0, "high"), (10.0, 10.0, 10.0, "medium")])
def test_threshold(spark, u, h, m, best):
    rows = [("ultra_high_10k", u), ("high_100k", h), ("medium_1m", m)]
    df = spark.createDataFrame(rows, "tier string, eval_perplexity double")
    assert compare.quality_threshold(df).first()[0] == best

"""Task tables, answer keys and the grading of response tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.functions import text as tx

KEY_SCHEMA = "task_id bigint, task_type string, prompt string, rule string, tokens array<string>, k int"
RULES = ("any", "all", "all_cs", "at_least", "count", "number")


def _draw(key: Column, seed: int, name: str, low: int, high: int) -> Column:
    """An integer in [low, high] that depends on the row's id, the seed and a name only."""
    return (tx.seeded_key(seed, key, F.lit(name)) % (high - low + 1) + low).cast("int")


def arithmetic_tasks(ids: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One sum, difference or product per id, with its prompt and answer."""
    k = F.col(key)
    op = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit("*")), _draw(k, seed, "op", 1, 3))
    drawn = ids.select(key, op.alias("op")).withColumns(
        {
            side: F.when(F.col("op") == "*", _draw(k, seed, side + "m", 2, 12)).otherwise(
                _draw(k, seed, side, 10, 99)
            )
            for side in ("a", "b")
        }
    )
    a, b = F.col("a"), F.col("b")
    answer = F.when(F.col("op") == "+", a + b).when(F.col("op") == "-", a - b).otherwise(a * b)
    return drawn.select(
        F.col(key).alias("task_id"),
        F.lit("arithmetic").alias("task_type"),
        F.format_string("What is %d %s %d?", a, F.col("op"), b).alias("prompt"),
        answer.cast("string").alias("answer"),
    )


def _pattern_prompt(first: Sequence[Column]) -> Column:
    return F.concat(F.lit("Complete the pattern: "), F.concat_ws(", ", *first), F.lit(", __"))


def number_patterns(ids: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """An arithmetic sequence per id; the answer is its fourth number."""
    start, step = _draw(F.col(key), seed, "start", 1, 10), _draw(F.col(key), seed, "step", 2, 5)
    drawn = ids.select(key, start.alias("start"), step.alias("step"))
    at = [(F.col("start") + F.col("step") * i).cast("string") for i in range(4)]
    return drawn.select(
        F.col(key).alias("task_id"),
        F.lit("pattern_completion").alias("task_type"),
        _pattern_prompt(at[:3]).alias("prompt"),
        at[3].alias("answer"),
    )


def letter_patterns(ids: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Capital letters 1 to 3 apart; the answer is the fourth."""
    start, step = _draw(F.col(key), seed, "letter", 65, 85), _draw(F.col(key), seed, "gap", 1, 3)
    drawn = ids.select(key, start.alias("start"), step.alias("step"))
    at = [F.char(F.col("start") + F.col("step") * i) for i in range(4)]
    return drawn.select(
        F.col(key).alias("task_id"),
        F.lit("letter_pattern").alias("task_type"),
        _pattern_prompt(at[:3]).alias("prompt"),
        at[3].alias("answer"),
    )


def generated_keys(tasks: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Answer keys of generated tasks: the response contains the answer, commas in numbers ignored.

    ``keep`` names columns to pass through, such as a ``response`` that is already beside its task.
    """
    return tasks.select(
        *keep,
        "task_id",
        "task_type",
        "prompt",
        F.when(F.col("task_type") == "arithmetic", "number")
        .when(F.col("task_type") == "letter_pattern", "all_cs")
        .otherwise("any")
        .alias("rule"),
        F.array("answer").alias("tokens"),
        F.lit(1).alias("k"),
    )


def fixed_keys(spark: SparkSession, keys: Sequence[tuple] = fixed.ANSWER_KEYS) -> DataFrame:
    """A published answer key as a table; task ids are list positions.

    Its rows are the list's, so it is marked for broadcast: responses are graded where they are. Joined by task id
    they would all meet in as many tasks as there are keys.
    """
    return F.broadcast(spark.createDataFrame([(i, *row) for i, row in enumerate(keys)], KEY_SCHEMA))


def prompt_table(spark: SparkSession) -> DataFrame:
    """The output-analysis prompts with their expected elements."""
    rows = [
        (i, category, fixed.PROMPT_FRAME.format(prompt), elements, limit)
        for i, (category, prompt, elements, limit) in enumerate(fixed.ANALYSIS_PROMPTS)
    ]
    return spark.createDataFrame(
        rows, "prompt_id int, category string, prompt string, expected_elements array<string>, max_tokens int"
    )


def sample_prompts(spark: SparkSession) -> DataFrame:
    """The default sampling prompts."""
    rows = [(i, c, fixed.PROMPT_FRAME.format(p), n) for i, (c, p, n) in enumerate(fixed.SAMPLE_PROMPTS)]
    return spark.createDataFrame(rows, "prompt_id int, category string, prompt string, max_tokens int")


def _spaced(text: Column) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}]+", " "), F.lit(" "))


def is_correct(response: Column, rule: Column, wanted: Column, k: Column, whole_words: bool = False) -> Column:
    """Apply a row's rule to its response.

    ``any``/``all``/``at_least`` test lower-cased text, ``all_cs`` keeps the case, ``number`` drops
    commas, ``count`` asks for k occurrences of one token. ``whole_words`` matches words, not parts.
    """
    answer = F.coalesce(response, F.lit(""))
    lower = F.when(rule == "all_cs", answer).when(rule == "number", F.replace(answer, F.lit(","), F.lit(""))).otherwise(
        F.lower(answer)
    )
    if whole_words:
        spaced = _spaced(lower)
        hits = F.size(F.filter(wanted, lambda t: F.contains(spaced, _spaced(t))))
    else:
        hits = F.size(F.filter(wanted, lambda t: F.contains(lower, t)))
    often = F.exists(
        wanted,
        lambda t: (F.length(answer) - F.length(F.replace(answer, t, F.lit("")))) / F.length(t) >= k,
    )
    return (
        F.when(rule.isin("all", "all_cs"), hits == F.size(wanted))
        .when(rule == "at_least", hits >= k)
        .when(rule == "count", often)
        .otherwise(hits >= 1)
    )


def graded_rows(rows: DataFrame, whole_words: bool = False) -> DataFrame:
    """``correct`` for rows that hold a response beside its answer key: a narrow transform, no join.

    A row without a task id has no key and is not graded: NULL.
    """
    ok = is_correct(F.col("response"), F.col("rule"), F.col("tokens"), F.col("k"), whole_words)
    return rows.withColumn("correct", F.when(F.col("task_id").isNotNull(), ok))


def graded(responses: DataFrame, keys: DataFrame, whole_words: bool = False) -> DataFrame:
    """Responses joined with their answer key, with ``correct``. Spark picks the join from the sizes; a fixed key is broadcast."""
    return graded_rows(responses.join(keys, "task_id"), whole_words)


def accuracy(rows: DataFrame, by: str = "task_type") -> DataFrame:
    return rows.groupBy(by).agg(
        F.count("*").alias("total"),
        F.avg(F.col("correct").cast("int")).alias("accuracy"),
    )


def answer_consistency(responses: DataFrame, prompt: str = "prompt", response: str = "response") -> DataFrame:
    """Per prompt 1 / distinct responses; two-level, so that a hot prompt is spread by response."""
    distinct = responses.groupBy(prompt, response).agg(F.count("*").alias("_c"))
    return distinct.groupBy(prompt).agg(
        F.sum("_c").alias("n_responses"), (F.lit(1.0) / F.count("*")).alias("consistency")
    )


def word_similarity(left: Column, right: Column) -> Column:
    """Jaccard overlap of two texts' alphanumeric words without stop words."""
    left_words, right_words = (
        F.array_distinct(tx.not_stop_words(tx.alnum_words(F.lower(t)))) for t in (left, right)
    )
    return tx.jaccard(left_words, right_words)


def answer_robustness(variants: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Mean similarity of the responses to a prompt's variants with the response to the prompt itself."""
    both = variants.join(base, key)
    return both.groupBy(key).agg(
        F.count("*").alias("n_variants"),
        F.avg(word_similarity(F.col("base_response"), F.col("response"))).alias("robustness"),
    )

"""Metrics of model outputs, per row and as a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import features as ft
from corpusmill.functions import text as tx
from corpusmill.functions.hyphenation import Patterns, syllables
from corpusmill.operators.sentences import SentenceEnds
from corpusmill.operators import stats

OUTPUT_METRICS = [
    "length_chars",
    "length_words",
    "length_sentences",
    "flesch_reading_ease",
    "flesch_kincaid_grade",
    "vocabulary_diversity",
    "expected_elements_ratio",
    "has_code_block",
    "has_list",
    "has_paragraphs",
    "ends_properly",
    "incomplete_sentence",
    "sentence_repetition",
    "trigram_repetition",
]
INDICATORS = ["has_code_blocks", "has_bullet_points", "has_numbers", "ends_properly", "repetitive"]


def variant_settings(low: float, high: float, n: int) -> Column:
    """``n`` evenly spaced settings as an array."""
    step = (high - low) / (n - 1) if n > 1 else 0.0
    return F.array(*[F.lit(high if n > 1 and i == n - 1 else low + i * step) for i in range(n)])


def prompt_grid(prompts: DataFrame, n: int, low: float = 0.7, high: float = 1.0) -> DataFrame:
    """Every prompt with every setting, as ``variant`` and ``temperature``; an explode, not a join."""
    return prompts.select("*", F.posexplode(variant_settings(low, high, n)).alias("variant", "temperature"))


def output_metrics(
    df: DataFrame,
    keep: Sequence[str],
    text: str = "generated",
    elements: str | None = "expected_elements",
    patterns: Patterns | None = None,
    ends: SentenceEnds | None = None,
) -> DataFrame:
    """All row metrics of an output. Tokens and sentences are columns of an earlier projection.

    Syllables are vowel groups unless hyphenation ``patterns`` are given; ``ends`` cuts sentences as learned.
    """
    t = F.col(text)
    expected = F.col(elements) if elements else F.lit(None).cast("array<string>")
    base = df.select(*dict.fromkeys([*keep, text]), expected.alias("_expected"), tx.spaced(t).alias("_p"))
    arrays = base.withColumns(
        {
            "_n": tx.word_count(F.col("_p"), plain=True),
            "_sents": ends.sentences(t) if ends else tx.sentences(t),
            "_tokens": tx.tokens(F.lower("_p"), plain=True),
            "_syllables": syllables(t, patterns) if patterns else tx.syllables(F.col("_p"), plain=True),
        }
    )
    n, sents, toks = F.col("_n"), F.col("_sents"), F.col("_tokens")
    measures = {
        "length_chars": F.length(t),
        "length_words": n,
        "length_sentences": F.size(sents),
        "flesch_reading_ease": ft.flesch_reading_ease(n, F.size(sents), F.col("_syllables")),
        "flesch_kincaid_grade": ft.flesch_kincaid_grade(n, F.size(sents), F.col("_syllables")),
        "vocabulary_diversity": tx.distinct_ratio(toks),
        "expected_elements_ratio": ft.element_coverage(t, F.col("_expected")),
        "has_code_block": ft.has_code(t),
        "has_list": ft.has_list(t),
        "has_paragraphs": ft.has_paragraphs(t),
        "ends_properly": ft.ends_properly(t),
        "incomplete_sentence": ft.ends_open(t, with_the=False),
        "sentence_repetition": ft.sentence_repetition(sents),
        "trigram_repetition": ft.trigram_repetition(toks),
    }
    return arrays.select(*keep, *[m.alias(name) for name, m in measures.items()])


def quality_indicators(df: DataFrame, keep: Sequence[str], text: str = "generated") -> DataFrame:
    """Row flags of the sample report, with the length in words."""
    t = F.col(text)
    arrays = df.select(*dict.fromkeys([*keep, text])).withColumn("_words", tx.words(F.lower(t)))
    return arrays.select(
        *keep,
        F.size("_words").alias("length"),
        ft.has_code_or_function(t).alias("has_code_blocks"),
        ft.has_list_marks(t).alias("has_bullet_points"),
        ft.has_digit(t).alias("has_numbers"),
        ft.ends_properly(t).alias("ends_properly"),
        ft.is_repetitive(F.col("_words")).alias("repetitive"),
    )


def overall_metrics(metrics: DataFrame) -> DataFrame:
    """One row over all outputs."""
    return metrics.agg(
        F.count("*").alias("total_samples"),
        F.avg("length_words").alias("avg_length_words"),
        F.avg("vocabulary_diversity").alias("avg_vocabulary_diversity"),
        F.avg(F.col("ends_properly").cast("int")).alias("coherence_rate"),
        F.avg("expected_elements_ratio").alias("expected_elements_coverage"),
    )


def composite_scores(metrics: DataFrame, keep: Sequence[str]) -> DataFrame:
    score = ft.composite_output_score(
        F.col("vocabulary_diversity"), F.col("expected_elements_ratio"), F.col("ends_properly")
    )
    return metrics.select(*keep, score.alias("composite_score"))


def analysis_report(metrics: DataFrame, by: str = "category") -> DataFrame:
    """Mean, spread and 0/1 ratio of each metric per category."""
    return stats.metric_stats(metrics, by, OUTPUT_METRICS)


def sample_report(flags: DataFrame, by: str = "category") -> DataFrame:
    """Length statistics and indicator percentages per category in one aggregation."""
    return flags.groupBy(by).agg(
        F.count("*").alias("count"),
        F.avg("length").alias("avg_length"),
        F.stddev_pop("length").alias("std_length"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        *[(F.avg(F.col(f).cast("int")) * 100).alias(f) for f in INDICATORS],
    )


def report_block(place: Column, category: Column, temperature: Column, prompt: Column, generated: Column) -> Column:
    """The text block of one sample in a report."""
    return F.concat(
        F.lit("Sample "), place.cast("string"),
        F.lit("\nCategory: "), category,
        F.lit("\nTemperature: "), F.format_string("%.2f", temperature),
        F.lit("\nPrompt: "), prompt,
        F.lit("\nGenerated:\n"), generated,
        F.lit("\n" + "-" * 80 + "\n"),
    )

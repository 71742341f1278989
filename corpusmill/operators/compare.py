"""Comparison of runs, strategies and sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators.formats import run_labels

QUALITY_LEVELS = ["ultra_high", "high", "medium"]


def comparison_table(runs: Sequence[DataFrame], name: str = "experiment") -> DataFrame:
    """Runs with differing metric columns as one labelled table."""
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)
    return run_labels(table, name)


def size_quality_pivot(table: DataFrame, metric: str = "weighted_avg_perplexity") -> DataFrame:
    """Data size by quality level; several runs in a cell are averaged."""
    return table.groupBy("dataset_size").pivot("quality_level", QUALITY_LEVELS).agg(F.avg(metric))


def tradeoff_curve(table: DataFrame, metric: str = "weighted_avg_perplexity") -> DataFrame:
    """Per quality level the metric by data size, with the change from the next smaller size."""
    points = table.groupBy("quality_level", "dataset_size").agg(F.avg(metric).alias(metric))
    by_size = Window.partitionBy("quality_level").orderBy("dataset_size")
    return points.withColumn("delta", F.col(metric) - F.lag(metric).over(by_size))


def size_performance(runs: DataFrame) -> DataFrame:
    """Per run: performance per sample, training efficiency, time to perplexity 20 and rows per point."""
    size, ppl, time = F.col("data_size"), F.col("eval_perplexity"), F.col("train_time")
    return runs.withColumns(
        {
            "performance_per_sample": F.try_divide(F.lit(1.0), ppl * size),
            "training_efficiency": F.try_divide(time, size),
            "time_to_threshold": time * F.try_divide(F.lit(20.0), ppl),
            "samples_per_point": F.try_divide(size, 100.0 - ppl),
        }
    )


def quality_threshold(runs: DataFrame, tier: str = "tier", metric: str = "eval_perplexity") -> DataFrame:
    """One row: the best tier that is 10 % better than the next larger one, else ``medium``."""
    wide = runs.agg(
        *[F.avg(F.when(F.col(tier) == t, F.col(metric))).alias(t) for t in ("ultra_high_10k", "high_100k", "medium_1m")]
    )
    return wide.select(
        F.when(F.col("ultra_high_10k") < F.col("high_100k") * 0.9, "ultra_high")
        .when(F.col("high_100k") < F.col("medium_1m") * 0.9, "high")
        .otherwise("medium")
        .alias("quality_threshold")
    )


def best_strategies(results: DataFrame) -> DataFrame:
    """Best strategy by mean score (``overall``) and per capability; ties go to the first name.

    ``results`` holds (strategy, capability, score).
    """
    cells = results.groupBy("strategy", "capability").agg(F.avg("score").alias("score"))
    overall = cells.groupBy("strategy").agg(F.avg("score").alias("score"))
    every = overall.select(F.lit("overall").alias("capability"), "strategy", "score").unionByName(
        cells.select("capability", "strategy", "score")
    )
    top = every.groupBy("capability").agg(F.max("score").alias("score"))
    return (
        every.join(top, ["capability", "score"])
        .groupBy("capability")
        .agg(F.min("strategy").alias("strategy"), F.max("score").alias("score"))
    )


def source_contribution(baseline: DataFrame, ablations: DataFrame) -> DataFrame:
    """How much each capability loses without a source, and which one loses most.

    ``baseline`` holds (capability, score), ``ablations`` (removed, capability, score).
    """
    drops = ablations.join(baseline.withColumnRenamed("score", "_base"), "capability").select(
        "removed", "capability", (F.col("_base") - F.col("score")).alias("drop")
    )
    largest = drops.groupBy("removed").agg(
        F.min(F.struct((-F.col("drop")).alias("d"), F.col("capability").alias("c"))).alias("_m")
    )
    return drops.join(largest, "removed").select(
        "removed", "capability", "drop", F.col("_m.c").alias("main_contribution")
    )


def source_profiles(df: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Words per row (mean, spread) and rows of each source."""
    return (
        df.select(source, tx.word_count(F.col(text)).alias("_n"))
        .groupBy(source)
        .agg(
            F.avg("_n").alias("avg_length"),
            F.stddev_pop("_n").alias("std_length"),
            F.count("*").alias("sample_count"),
        )
    )

"""Writers. All are Spark writers: every task writes its own file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.ranking import first_rows


def save_splits(df: DataFrame, path: str, mode: str = "errorifexists", by: Sequence[str] = ("split",)) -> None:
    """One directory per split (or strategy and split)."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def dataset_summary(df: DataFrame, score: str | None = None) -> DataFrame:
    """One row: total, train and validation rows and, with a score, threshold, mean and maximum."""
    counts = [
        F.count("*").alias("total_samples"),
        F.count_if(F.col("split") == "train").alias("train_samples"),
        F.count_if(F.col("split") == "validation").alias("validation_samples"),
    ]
    if score:
        counts += [
            F.min(score).alias("score_threshold"),
            F.avg(score).alias("mean_score"),
            F.max(score).alias("score_max"),
        ]
    return df.agg(*counts)


def save_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def save_predictions(df: DataFrame, path: str, key: str, n: int = 100) -> None:
    """The first ``n`` predictions as JSON lines, a report-sized extract."""
    first_rows(df, n, key).write.json(path)


def score_columns(scored: DataFrame, key: str = "idx") -> DataFrame:
    return scored.select(F.col(key).alias("idx"), "score", "components.*")


def save_score_csv(scored: DataFrame, path: str, key: str = "idx") -> None:
    """The flat score table with a header."""
    score_columns(scored, key).write.csv(path, header=True)


def save_report(df: DataFrame, path: str, block: Column, key: str, n: int | None = 20) -> None:
    """Text blocks in order of ``key``: the first ``n``, or all when ``n`` is None."""
    chosen = df if n is None else first_rows(df, n, key)
    ordered = chosen.select(key, block.alias("value")).orderBy(key)
    ordered.select("value").write.text(path)

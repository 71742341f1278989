"""Stored scores, keyed by the resolved pair, so that a pair is scored once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.functions import fixed
from corpusmill.operators.quality import score_pairs


def pair_key(instruction: str = "instruction", response: str = "response") -> Column:
    """md5 over both texts; the length in front keeps (``a``, ``bc``) and (``ab``, ``c``) apart."""
    ask, answer = (F.coalesce(F.col(c), F.lit("")) for c in (instruction, response))
    return F.md5(F.concat(F.length(ask).cast("string"), F.lit(":"), ask, F.lit("|"), answer))


def stored_scores(spark: SparkSession, path: str) -> DataFrame:
    """The store, empty if it does not exist yet."""
    try:
        return spark.read.schema(schemas.SCORE_STORE).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schemas.SCORE_STORE)


def unscored_pairs(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct pairs without a stored score.

    Copies of a pair combine before the one shuffle of texts; the anti join then works on unique keys
    and keeps that partitioning.
    """
    unique = (
        pairs.withColumn("pair_key", pair_key())
        .groupBy("pair_key")
        .agg(F.first("instruction").alias("instruction"), F.first("response").alias("response"))
    )
    return unique.join(store.select("pair_key"), "pair_key", "left_anti")


def update_store(
    pairs: DataFrame,
    path: str,
    force: bool = False,
    weights: Mapping[str, float] = fixed.DIMENSION_WEIGHTS,
) -> None:
    """Score what the store lacks and append it; ``force`` replaces the store."""
    spark = pairs.sparkSession
    if force:
        store = spark.createDataFrame([], schemas.SCORE_STORE)
    else:
        store = stored_scores(spark, path)
    scored = score_pairs(unscored_pairs(pairs, store), weights=weights).select("pair_key", "score", "components")
    scored.write.mode("overwrite" if force else "append").parquet(path)


def with_stored_scores(pairs: DataFrame, path: str) -> DataFrame:
    """Pairs with their score from the store."""
    store = stored_scores(pairs.sparkSession, path)
    return pairs.withColumn("pair_key", pair_key()).join(store, "pair_key").drop("pair_key")

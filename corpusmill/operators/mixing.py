"""Splits, quotas and mixes of sources, drawn by a seeded hash of the row id.

A quota sample needs the n-th smallest (hash, id) of a source, not the order of all its rows.
``ranking.nth_rows`` finds it, and it is an exact bound that the big table is filtered by: sources of
any size cost one narrow counting pass and no shuffle of texts.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.functions.text import seeded_key
from corpusmill.operators.ranking import hash_cell, id_cell, not_after, nth_rows

def with_split(df: DataFrame, key: str, seed: int = 42, validation: float = 0.05) -> DataFrame:
    """Add ``split`` (train/validation) from the row's hash: row by row, stable when rows are added."""
    cut = int(round(validation * 10_000))
    part = seeded_key(seed, F.col(key)) % 10_000
    return df.withColumn("split", F.when(part < cut, "validation").otherwise("train"))


def exact_split(df: DataFrame, key: str, seed: int = 42, validation: float = 0.05) -> DataFrame:
    """Like ``with_split`` with exactly ``ceil(validation * rows)`` validation rows."""
    need = math.ceil(validation * df.count())
    place = seeded_key(seed, F.col(key))
    marked = df.select(key, F.lit("all").alias("_all"))
    bound = nth_rows(marked, "_all", key, place, hash_cell(place), {"all": [need]}).get(("all", need))
    if bound is None:
        return df.withColumn("split", F.lit("train"))
    return df.withColumn("split", F.when(not_after(place, F.col(key), bound), "validation").otherwise("train"))


def normalised(ratios: Mapping[str, float]) -> dict[str, float]:
    """Ratios divided by their sum when that is more than 0.01 off 1, else unchanged."""
    total = sum(ratios.values())
    return {k: v / total for k, v in ratios.items()} if abs(total - 1.0) > 0.01 else dict(ratios)


def quotas(ratios: Mapping[str, float], total: int) -> dict[str, int]:
    """Rows per source: the ratio of the total, cut to an integer."""
    return {k: int(v * total) for k, v in normalised(ratios).items()}


def quota_table(spark, strategies: Mapping[str, Mapping[str, float]], total: int) -> DataFrame:
    """(strategy, source, ratio, quota): one row per strategy and source."""
    rows = [
        (name, source, ratio, quotas(ratios, total)[source])
        for name, ratios in strategies.items()
        for source, ratio in normalised(ratios).items()
    ]
    return spark.createDataFrame(rows, "strategy string, source string, ratio double, quota bigint")


def mix(
    df: DataFrame,
    strategies: Mapping[str, Mapping[str, float]],
    total: int,
    key: str,
    source: str = "source",
    seed: int = 42,
    quota_on: str = "accepted",
    order: str = "hash",
) -> DataFrame:
    """The rows of every strategy in one pass over the sources, with ``strategy`` added.

    ``df.text`` is NULL where the formatter rejected a row. ``quota_on="accepted"`` draws from the
    remaining rows; ``"raw"`` counts rejected rows towards the quota, so that the result may fall
    short. ``order`` is ``"hash"`` (seeded sample) or ``"id"`` (first rows of the source).
    """
    if quota_on not in ("accepted", "raw") or order not in ("hash", "id"):
        raise ValueError("quota_on is 'accepted' or 'raw', order is 'hash' or 'id'")
    pool = df.where(F.col("text").isNotNull()) if quota_on == "accepted" else df
    plan = {name: quotas(ratios, total) for name, ratios in strategies.items()}
    needs: dict[str, list[int]] = {}
    for shares in plan.values():
        for name, n in shares.items():
            needs.setdefault(name, []).append(n)
    if order == "hash":
        place = seeded_key(seed, F.col(key))
        cell = hash_cell(place)
    else:
        place = F.col(key)
        cell = id_cell(pool, key)
    bounds = nth_rows(pool, source, key, place, cell, needs)
    taken = []
    for strategy, shares in plan.items():
        for name, n in shares.items():
            if n == 0:
                continue
            inside = F.col(source) == name
            bound = bounds.get((name, n))
            if bound is not None:  # without a bound the source has fewer rows than its quota
                inside = inside & not_after(place, F.col(key), bound)
            taken.append(F.when(inside, F.lit(strategy)))
    chosen = F.array_compact(F.array(*taken))
    return (
        pool.where(F.col(source).isin(list(needs)))
        .withColumn("strategy", F.explode(chosen))
        .where(F.col("text").isNotNull())
    )


def mixed_dataset(
    df: DataFrame,
    strategies: Mapping[str, Mapping[str, float]],
    total: int,
    key: str,
    seed: int = 42,
    **options,
) -> DataFrame:
    """``mix`` with ``split`` and ``shuffle_key``; sort by the latter within a strategy to shuffle."""
    rows = mix(df, strategies, total, key, seed=seed, **options)
    return with_split(rows, key, seed).withColumn(
        "shuffle_key", seeded_key(seed, F.col("strategy"), F.col(key))
    )


def contributions(rows: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """Rows that each source contributes."""
    return rows.groupBy(*by).agg(F.count("*").alias("contributed"))


def mix_metadata(rows: DataFrame, strategies: Mapping[str, Mapping[str, float]], total: int, seed: int = 42) -> DataFrame:
    """Per strategy and source the ratio, quota and contribution, with the strategy's total rows."""
    plan = quota_table(rows.sparkSession, strategies, total)
    counts = contributions(rows, ("strategy", "source"))
    joined = plan.join(counts, ["strategy", "source"], "left").fillna(0, ["contributed"])
    return joined.withColumn(
        "total_samples", F.sum("contributed").over(Window.partitionBy("strategy"))
    ).withColumn("seed", F.lit(seed))


def leave_one_out(sources: DataFrame, source: str = "source", share: float = 0.33) -> DataFrame:
    """Ablation ratios: for each removed source the share of every other one and 0 for itself.

    ``sources`` lists the sources (a handful); the grid comes from one array of them.
    """
    listed = F.array_sort(F.collect_set(source))
    names = sources.agg(listed.alias("_all"))
    removed = names.select(F.explode("_all").alias("removed"), "_all")
    return removed.select("removed", F.explode("_all").alias("source")).withColumn(
        "ratio", F.when(F.col("source") == F.col("removed"), 0.0).otherwise(share)
    )

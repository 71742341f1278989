"""The four jobs of the library, end to end."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.functions import text as tx
from corpusmill.operators import corpus, formats, grading, mixing, quality, ranking, stats
from corpusmill.session import keep
from corpusmill.sources import score_store, sinks


def prepare(rows: DataFrame, path: str, key: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """Format, optionally take the first ``n``, split and save training text; returns the summary."""
    texts = rows if n is None else ranking.first_rows(rows, n, key)
    sinks.save_splits(mixing.with_split(texts, key, seed), path)
    return sinks.dataset_summary(rows.sparkSession.read.parquet(path))


def length_profile(texts: DataFrame, key: str, n: int | None = None, counter=tx.tokens) -> tuple[DataFrame, DataFrame]:
    """Token-length summary and histogram of the first ``n`` rows (all by default)."""
    rows = texts if n is None else ranking.first_rows(texts, n, key)
    lengths = keep(rows.select(F.size(counter(F.col("text"))).alias("length")), "lengths")
    return stats.summary(lengths, ["length"]), stats.edge_histogram(lengths, "length")


def score_and_tier(
    pairs: DataFrame,
    key: str,
    path: str,
    tiers: Mapping[str, int] = fixed.TIER_SIZES,
    weights: Mapping[str, float] = fixed.DIMENSION_WEIGHTS,
    seed: int = 42,
) -> DataFrame:
    """Score once into a store, cut the tiers, save them split, and return the tier report.

    Ranking sees key and scores only; texts join the chosen rows at the end.
    """
    spark = pairs.sparkSession
    resolved = formats.resolve_pair(pairs)
    store = f"{path}/scores"
    score_store.update_store(resolved, store, weights=weights)
    narrow = keep(score_store.with_stored_scores(resolved, store).select(key, "score", "components"), "scores")
    members = ranking.nested_tiers(narrow, tiers, key=key)
    members.write.partitionBy("tier").parquet(f"{path}/members")
    members = spark.read.parquet(f"{path}/members")
    scores = members.select(
        key, "tier", F.col("score").alias("quality_score"), F.col("components").alias("quality_components")
    )
    sinks.save_splits(mixing.with_split(resolved.join(scores, key), key, seed), f"{path}/tiers", by=("tier", "split"))
    report = ranking.tier_report(members.select("tier", "rank", "score", "components.*"), quality.COMPONENTS)
    sinks.save_json(report, f"{path}/report")
    return report


def mix_corpus(
    rows: DataFrame,
    path: str,
    total: int,
    key: str,
    strategies: Mapping[str, Mapping[str, float]] = fixed.MIX_STRATEGIES,
    seed: int = 42,
    **options,
) -> DataFrame:
    """All strategies from one read of the sources, saved by strategy and split; returns the metadata."""
    mixed = mixing.mixed_dataset(rows, strategies, total, key, seed, **options)
    # Shuffled order inside each file; the range shuffle also evens out the files.
    ordered = mixed.repartitionByRange("strategy", "split", "shuffle_key").sortWithinPartitions(
        "strategy", "split", "shuffle_key", key
    )
    sinks.save_splits(ordered, f"{path}/rows", by=("strategy", "split"))
    saved = rows.sparkSession.read.parquet(f"{path}/rows").select("strategy", "source")
    metadata = mixing.mix_metadata(saved, strategies, total, seed)
    sinks.save_json(metadata, f"{path}/metadata")
    return metadata


def evaluate_corpus(
    texts: DataFrame,
    losses: DataFrame | None = None,
    graded: DataFrame | None = None,
    text: str = "text",
) -> DataFrame:
    """One row: n-gram and vocabulary diversity, quality proxies, perplexity, task accuracy, composite."""
    parts = [
        corpus.ngram_row(corpus.distinct_ngrams(texts, text)),
        corpus.vocabulary(texts, text).select("vocab_diversity", "entropy"),
        corpus.quality_proxies(texts, text),
    ]
    if losses is not None:
        parts.append(stats.token_perplexity(losses))
    if graded is not None:
        per_task = grading.accuracy(graded)
        parts.append(per_task.agg(F.avg("accuracy").alias("task_performance")))
    report = corpus.side_by_side(*parts)
    if graded is None:
        report = report.withColumn("task_performance", F.lit(None).cast("double"))
    return corpus.composite_scores(report)

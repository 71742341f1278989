"""ROUGE and BLEU counted pair by pair inside Arrow batches, self-BLEU as grouped counts of n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import features as ft
from corpusmill.functions import text as tx
from corpusmill.functions.stemming import stem_distinct
from corpusmill.operators import corpus
from corpusmill.operators.ranking import seeded_sample
from corpusmill.operators.stats import finite


#: Tokens whose overlap is counted at once inside a batch.
TOKENS_AT_ONCE = 400_000


def lcs_length(a: list[int], b: list[int]) -> int:
    """Longest common subsequence: the longer side as the bits of one integer of any length, the shorter one token by
    token; one addition carries through all machine words."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[int, int] = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & places.get(token, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _sides(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The tokens of a list column and the number of tokens of every row (0 for null)."""
    return lists.flatten(), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def count_overlap(left: pa.ListArray, right: pa.ListArray, max_n: int, stem: bool, subsequence: bool) -> list[np.ndarray]:
    """Per row, for every n up to ``max_n``: clipped n-gram matches, n-grams left, n-grams right; last the length of
    the longest common subsequence (0 unless asked for)."""
    (a, n_left), (b, n_right) = _sides(left), _sides(right)
    words = pa.concat_arrays([a, b]).dictionary_encode()
    ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if stem:
        stems = pa.array(stem_distinct(words.dictionary.to_pylist()), pa.string()).dictionary_encode()
        ids = stems.indices.to_numpy(zero_copy_only=False).astype(np.int64)[ids]
    rows, side = len(n_left), np.repeat([0, 1], [len(a), len(b)])
    row = np.concatenate([np.repeat(np.arange(rows), n_left), np.repeat(np.arange(rows), n_right)])
    sizes = np.concatenate([n_left, n_right])
    remaining = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))
    out, gram, shared = [], ids, np.zeros(len(ids), dtype=bool)
    base = int(ids.max(initial=0)) + 1
    for n in range(1, max_n + 1):
        if n > 1:  # the (n-1)-gram that starts here, renumbered, and the token that makes it one longer
            _, short = np.unique(gram, return_inverse=True)
            gram = short * base + np.append(ids[n - 1 :], np.zeros(min(n - 1, len(ids)), dtype=np.int64))
        here = np.flatnonzero(remaining >= n)
        _, dense = np.unique(gram[here], return_inverse=True)
        cells, at = np.unique(row[here] * (int(dense.max(initial=0)) + 1) + dense, return_inverse=True)
        counts = [np.bincount(at[side[here] == k], minlength=len(cells)) for k in (0, 1)]
        owner = np.zeros(len(cells), dtype=np.int64)
        owner[at] = row[here]
        out += [np.bincount(owner, weights=c, minlength=rows).astype(np.int64) for c in (np.minimum(*counts), *counts)]
        if n == 1:
            shared = ((counts[0] > 0) & (counts[1] > 0))[at]
    lengths = np.zeros(rows, dtype=np.int64)
    if subsequence:  # only tokens that both texts have can be part of it
        kept = [(ids[own], np.append(0, np.cumsum(np.bincount(row[own], minlength=rows)))) for own in (shared & (side == k) for k in (0, 1))]
        (x, at_x), (y, at_y) = kept
        for i in np.flatnonzero(out[0]).tolist():
            lengths[i] = lcs_length(x[at_x[i] : at_x[i + 1]].tolist(), y[at_y[i] : at_y[i + 1]].tolist())
    return [*out, lengths]


def overlap_counts(prediction: Column, reference: Column, max_n: int, stem: bool = False, subsequence: bool = False) -> Column:
    """Struct of ``m1``, ``p1``, ``r1``, … (matches, n-grams of the prediction and of the reference) and ``lcs``.

    Takes two arrays of tokens. A pair is a row, so nothing is shuffled; the n-grams of a batch are counted together.
    """
    names = [f"{kind}{n}" for n in range(1, max_n + 1) for kind in "mpr"] + ["lcs"]

    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in pairs:
            sizes = sum(_sides(side)[1] for side in (left, right))
            parts, start, used = [], 0, 0
            for i, size in enumerate([*sizes.tolist(), TOKENS_AT_ONCE + 1]):
                if i > start and used + size > TOKENS_AT_ONCE:
                    found = count_overlap(left.slice(start, i - start), right.slice(start, i - start), max_n, stem, subsequence)
                    parts.append(pa.StructArray.from_arrays([pa.array(c) for c in found], names=names))
                    start, used = i, 0
                used += size
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(n, pa.int64()) for n in names]))

    # Not repeatable, as far as the optimizer is told: or every field that is read would count anew.
    return F.arrow_udf(run, ", ".join(f"{n} bigint" for n in names)).asNondeterministic()(prediction, reference)


def _f_measure(matches: Column, n_prediction: Column, n_reference: Column) -> Column:
    precision = F.coalesce(F.try_divide(matches, n_prediction), F.lit(0.0))
    recall = F.coalesce(F.try_divide(matches, n_reference), F.lit(0.0))
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def _scorable(pairs: DataFrame, reference: str) -> DataFrame:
    return pairs.where(F.col(reference) != "")


def rouge(
    pairs: DataFrame, key: str, prediction: str = "prediction", reference: str = "reference", stem: bool = True
) -> DataFrame:
    """ROUGE-1, ROUGE-2 and ROUGE-L F of every pair with a reference, in one pass over the pairs.

    Words are lower-case runs of ASCII letters and digits; ``stem`` compares the stems of those of over three letters.
    Pairs without a common word score 0, as do null predictions.
    """
    tokens = _scorable(pairs, reference).select(
        key, tx.rouge_tokens(F.col(prediction)).alias("_p"), tx.rouge_tokens(F.col(reference)).alias("_r")
    )
    counted = tokens.select(key, overlap_counts(F.col("_p"), F.col("_r"), 2, stem, subsequence=True).alias("_c"))
    c = F.col("_c")
    return counted.select(
        key,
        *[_f_measure(c[f"m{n}"], c[f"p{n}"], c[f"r{n}"]).alias(f"rouge{n}") for n in (1, 2)],
        _f_measure(c["lcs"], c["p1"], c["r1"]).alias("rougeL"),
    )


def rouge_n(pairs: DataFrame, key: str, prediction: str = "prediction", reference: str = "reference", stem: bool = True) -> DataFrame:
    """ROUGE-1 and ROUGE-2 F of every pair with a reference."""
    return rouge(pairs, key, prediction, reference, stem).select(key, "rouge1", "rouge2")


def rouge_l(pairs: DataFrame, key: str, prediction: str = "prediction", reference: str = "reference", stem: bool = True) -> DataFrame:
    """ROUGE-L F of every pair with a reference."""
    return rouge(pairs, key, prediction, reference, stem).select(key, "rougeL")


def _bleu(matches: list[Column], possible: list[Column], candidate: Column, reference: Column) -> Column:
    """Geometric mean of the precisions times the brevity penalty; 0 when a precision is 0."""
    precisions = [F.coalesce(F.try_divide(m, p), F.lit(0.0)) for m, p in zip(matches, possible)]
    worst = F.least(*precisions)
    logs = sum((F.log(F.when(p > 0, p)) for p in precisions[1:]), F.log(F.when(precisions[0] > 0, precisions[0])))
    share = F.try_divide(candidate.cast("double"), reference)
    penalty = F.when(share > 1.0, 1.0).otherwise(F.exp(1 - F.try_divide(F.lit(1.0), share)))
    return F.when(worst > 0, F.exp(logs / len(precisions)) * F.coalesce(penalty, F.lit(1.0))).otherwise(0.0)


def corpus_bleu(pairs: DataFrame, key: str, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """BLEU-4 with counts pooled over all pairs: one row with the precisions, lengths and score."""
    tokens = pairs.select(tx.bleu_tokens(F.col(prediction)).alias("_p"), tx.bleu_tokens(F.col(reference)).alias("_r"))
    counted = tokens.select(overlap_counts(F.col("_p"), F.col("_r"), 4).alias("_c")).select("_c.*")

    def pooled(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    totals = counted.agg(
        *[pooled(f"m{n}").alias(f"m{n}") for n in range(1, 5)],
        *[pooled(f"p{n}").alias(f"t{n}") for n in range(1, 5)],
        pooled("r1").alias("reference_length"),
    )
    score = _bleu(
        [F.col(f"m{n}") for n in range(1, 5)],
        [F.col(f"t{n}") for n in range(1, 5)],
        F.col("t1"),
        F.col("reference_length"),
    )
    return totals.select(
        *[F.coalesce(F.try_divide(F.col(f"m{n}"), F.col(f"t{n}")), F.lit(0.0)).alias(f"precision_{n}") for n in range(1, 5)],
        F.col("t1").alias("translation_length"),
        "reference_length",
        score.alias("bleu"),
    )


def self_bleu_sample(texts: DataFrame, key: str, text: str, sample: int = 100, seed: int = 42) -> DataFrame:
    """The seeded sample (at most ``sample`` rows by definition) with its place 1, 2, … as ``place``."""
    drawn = seeded_sample(texts.select(key, text), sample, key, seed).withColumn("_h", tx.seeded_key(seed, F.col(key)))
    # The window sees the sample only, so its single task is bounded by ``sample``.
    return drawn.select(
        F.row_number().over(Window.orderBy("_h", key)).alias("place"), F.col(text).alias("text")
    )


def self_bleu_scores(
    texts: DataFrame,
    key: str,
    text: str = "text",
    sample: int = 100,
    candidates: int = 50,
    others: int = 10,
    seed: int = 42,
) -> DataFrame:
    """BLEU of each sampled candidate against the first ``others`` further texts of the sample.

    The references of place i are the first ``others + 1`` places without i. Grams are joined on
    (n, gram) with at most ``others + 1`` reference rows each and clipped by the best reference.
    """
    picked = self_bleu_sample(texts, key, text, sample, seed).where(
        F.col("place") <= max(candidates, others + 1)
    )
    tokens = picked.select("place", tx.bleu_tokens(F.col("text")).alias("_t"))
    sizes = tokens.select("place", F.size("_t").alias("length"))
    counted = (
        corpus.explode_ngrams(tokens, {"_t": 1}, 4, ["place"])
        .groupBy("place", "n", "gram")
        .agg(F.count("*").alias("c"))
    )
    cand = counted.where(F.col("place") <= candidates)
    refs = counted.where(F.col("place") <= others + 1).select(
        F.col("place").alias("ref"), "n", "gram", F.col("c").alias("ref_c")
    )

    def is_reference(ref: Column, place: Column) -> Column:
        return (ref != place) & ((ref <= others) | (place <= others))

    best = cand.join(refs, ["n", "gram"], "left").groupBy("place", "n", "gram", "c").agg(
        F.coalesce(
            F.max(F.when(is_reference(F.col("ref"), F.col("place")), F.col("ref_c"))), F.lit(0)
        ).alias("clip")
    )
    per_n = best.groupBy("place").agg(
        *[F.coalesce(F.sum(F.when(F.col("n") == n, F.least("c", "clip"))), F.lit(0)).alias(f"m{n}") for n in range(1, 5)],
        *[F.coalesce(F.sum(F.when(F.col("n") == n, F.col("c"))), F.lit(0)).alias(f"t{n}") for n in range(1, 5)],
    )
    # The shortest reference per place: each place lists its references, which are looked up by number.
    listed = sizes.where(F.col("place") <= candidates).select(
        "place", F.explode(F.sequence(F.lit(1), F.lit(others + 1))).alias("ref")
    )
    shortest = (
        listed.where(is_reference(F.col("ref"), F.col("place")))
        .join(sizes.select(F.col("place").alias("ref"), F.col("length").alias("_l")), "ref")
        .groupBy("place")
        .agg(F.min("_l").alias("_short"))
    )
    scored = (
        sizes.where(F.col("place") <= candidates).join(per_n, "place", "left").join(shortest, "place", "left")
    )
    filled = scored.fillna(0)
    score = _bleu(
        [F.col(f"m{n}") for n in range(1, 5)], [F.col(f"t{n}") for n in range(1, 5)], F.col("length"), F.col("_short")
    )
    return filled.select("place", score.alias("bleu"))


def self_bleu(texts: DataFrame, key: str, text: str = "text", **options) -> DataFrame:
    """Diversity ``1 - mean BLEU``; NULL for ten texts or fewer."""
    scores = self_bleu_scores(texts, key, text, **options)
    total = texts.agg(F.count("*")).scalar()
    return scores.agg((1 - F.avg("bleu")).alias("_d")).select(F.when(total > 10, F.col("_d")).alias("self_bleu"))


def generation_quality(pairs: DataFrame, key: str, prediction: str = "prediction", reference: str = "reference", **options) -> DataFrame:
    """One row: mean ROUGE, BLEU, length-ratio mean and spread, distinct-n and self-BLEU diversity."""
    n = rouge(pairs, key, prediction, reference).agg(*[F.avg(c).alias(c) for c in ("rouge1", "rouge2", "rougeL")])
    bleu = corpus_bleu(pairs, key, prediction, reference).select("bleu")
    ratios = pairs.select(ft.length_ratio(F.col(prediction), F.col(reference)).alias("x")).where(finite(F.col("x")))
    lengths = ratios.agg(F.avg("x").alias("avg_length_ratio"), F.stddev_pop("x").alias("std_length_ratio"))
    grams = corpus.ngram_row(corpus.distinct_ngrams(pairs, prediction, lower=False))
    return corpus.side_by_side(n, bleu, lengths, grams, self_bleu(pairs, key, prediction, **options))

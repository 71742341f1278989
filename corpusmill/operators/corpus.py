"""Statistics of a whole corpus and the composite report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import features as ft
from corpusmill.functions import fixed
from corpusmill.functions import text as tx
from corpusmill.operators.ranking import first_rows
from corpusmill.operators.sentences import SentenceEnds
from corpusmill.operators.stats import finite


def explode_ngrams(df: DataFrame, sides: Mapping[str, int], max_n: int, keep: Sequence[str] = ()) -> DataFrame:
    """One row per n-gram of the array columns ``sides``: kept columns, ``side`` (the number given for
    the array), ``n`` and ``gram``.

    Each size is built from the one before in a projection of its own; a row then becomes one short
    row per array, which is exploded.
    """
    cells = []

    def cell(number: int, n: int, items: str) -> Column:
        return F.struct(F.lit(number).alias("side"), F.lit(n).alias("n"), F.col(items).alias("_grams"))

    for items, number in sides.items():
        cells.append(cell(number, 1, items))
        last = items
        for n in range(2, max_n + 1):
            name = f"{items}_{n}"
            df = df.withColumn(name, tx.ngrams(F.col(items), n, shorter=F.col(last)))
            cells.append(cell(number, n, name))
            last = name
    sized = df.select(*keep, F.inline(F.array(*cells)))
    return sized.select(*keep, "side", "n", F.explode("_grams").alias("gram"))


def _distinct_words(words: DataFrame) -> DataFrame:
    """(n, total, distinct) of the words themselves; equal words combine before the shuffle."""
    counted = words.select(F.explode("_w").alias("_x")).groupBy("_x").agg(F.count("*").alias("_c"))
    return counted.agg(F.lit(1).alias("n"), F.sum("_c").alias("total"), F.count("*").alias("distinct"))


def _distinct_windows(words: DataFrame, max_n: int) -> DataFrame:
    """(n, total, distinct) of the n-grams of two to ``max_n`` words.

    What is shuffled is one row for every word that another follows: the hashes of that pair (128 bits) and of each word
    after it (64 bits, null after the end). All grams that begin with a pair meet in one task, where rows that agree up
    to their n-th word are one n-gram; nothing is combined or sorted before the shuffle.
    """
    names = [f"_w{i}" for i in range(max_n)]
    left = [F.slice("_w", F.lit(i + 1), F.greatest(F.size("_w") - i, F.lit(0))).alias(name) for i, name in enumerate(names)]
    windows = words.select(F.inline(F.arrays_zip(*left))).where("_w1 IS NOT NULL")
    later = [F.when(F.col(w).isNotNull(), F.xxhash64(w)).alias(f"_k{n}") for n, w in enumerate(names[2:], 3)]
    keys = ["_h", "_l", *[f"_k{n}" for n in range(3, max_n + 1)]]
    rows = windows.select(F.xxhash64("_w0", "_w1").alias("_h"), F.xxhash64(F.lit(1), "_w0", "_w1").alias("_l"), *later)
    level = rows.repartition("_h", "_l").groupBy(*keys).agg(F.count("*").alias("_c"))
    done: list[str] = []
    for n in range(max_n, 2, -1):
        carried = [F.sum(c).alias(c) for c in done]
        own = [F.sum(F.when(F.col(f"_k{n}").isNotNull(), F.col("_c"))).alias(f"_t{n}"), F.count(f"_k{n}").alias(f"_d{n}")]
        level = level.groupBy(*keys[: n - 1]).agg(F.sum("_c").alias("_c"), *own, *carried)
        done += [f"_t{n}", f"_d{n}"]
    row = level.agg(F.sum("_c").alias("_t2"), F.count("*").alias("_d2"), *[F.sum(c).alias(c) for c in done])
    cells = [F.struct(F.lit(n).alias("n"), F.col(f"_t{n}").alias("total"), F.col(f"_d{n}").alias("distinct")) for n in range(2, max_n + 1)]
    return row.select(F.inline(F.array(*cells)))


def distinct_ngrams(
    df: DataFrame, text: str = "text", max_n: int = 4, lower: bool = True, approximate: bool = False
) -> DataFrame:
    """Per n: total and distinct n-grams and their ratio.

    Words combine before their shuffle; longer grams share one shuffle of a row per word (``_distinct_windows``).
    Words are compared as they are, longer grams by at least 128 bits of hashes: of N different pairs, fewer than
    N * N / 2 ** 129 are expected to agree, and grams with the same first pair agree only if other words share a 64-bit
    hash. ``approximate`` replaces the shuffles by mergeable sketches (one row per task and n).
    """
    value = F.lower(text) if lower else F.col(text)
    words = df.select(tx.words(value).alias("_w"))
    if approximate:
        grams = explode_ngrams(words, {"_w": 1}, max_n)
        counted = grams.groupBy("n").agg(
            F.count("*").alias("total"), F.approx_count_distinct("gram", 0.01).alias("distinct")
        )
    else:
        counted = _distinct_words(words)
        counted = (counted.unionByName(_distinct_windows(words, max_n)) if max_n > 1 else counted).where("total > 0")
    return counted.withColumn("ratio", F.col("distinct") / F.col("total"))


def vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: tokens, distinct tokens, vocabulary diversity and Shannon entropy in bits."""
    counts = df.select(F.explode(tx.words(F.lower(text))).alias("_t")).groupBy("_t").agg(F.count("*").alias("_n"))
    # The pattern looks at distinct words; a filter would be moved before the count and look at all.
    counts = counts.select(F.when(F.col("_t").rlike(rf"\A{tx.ALNUM}+\z"), F.col("_n")).alias("_c"))
    c = F.col("_c").cast("double")
    total = F.sum("_c")
    # -sum(p log2 p) with p = c/N, rearranged so that one pass is enough.
    entropy = F.log2(total.cast("double")) - F.try_divide(F.sum(c * F.log2(c)), total)
    return counts.agg(
        F.coalesce(total, F.lit(0)).alias("tokens"),
        F.count("_c").alias("vocabulary"),
        F.try_divide(F.count("_c"), total).alias("vocab_diversity"),
        F.when(total > 0, entropy).alias("entropy"),
    )


def quality_proxies(
    df: DataFrame,
    text: str = "text",
    key: str | None = None,
    grammar_sample: int | None = None,
    ends: SentenceEnds | None = None,
) -> DataFrame:
    """One row of means: readability, sentence-length variation, coherence and grammar; 0 when empty.

    Grammar covers the whole table unless ``grammar_sample`` asks for the first rows by ``key``. ``ends`` cuts
    sentences as learned from a corpus.
    """
    base = df.select(F.col(text).alias("_t"), *([F.col(key).alias("_k")] if key else []))
    arrays = (
        base.withColumn("_p", tx.spaced(F.col("_t")))
        .withColumn("_m", ends.marked(F.col("_p"), plain=True) if ends else F.col("_p"))
        .withColumns(
            {
                "_words": tx.words(F.lower("_p"), plain=True),
                "_sents": tx.sentences(F.col("_m"), plain=True),
                "_y": tx.syllables(F.col("_p"), plain=True),
            }
        )
        .withColumns(
            {
                "_n": F.size("_words"),
                "_s": F.size("_sents"),
                "_lengths": ft.sentence_lengths(F.col("_sents"), plain=True),
                "_sets": ft.sentence_words(F.col("_sents"), plain=True),
            }
        )
        .withColumn("_moments", ft.length_moments(F.col("_lengths")))
    )
    n, s = F.col("_n"), F.col("_s")
    rows = arrays.select(
        ft.flesch_reading_ease(n, s, F.col("_y")).alias("ease"),
        F.when(s > 1, ft.length_std(F.col("_moments"))).alias("variation"),
        ft.coherence(F.col("_sets")).alias("coherence"),
        ft.grammar_score(F.col("_p"), n, s, F.col("_words"), plain=True, marked=F.col("_m")).alias("grammar"),
    )

    def mean(name: str) -> Column:
        return F.coalesce(F.avg(F.when(finite(F.col(name)), F.col(name))), F.lit(0.0))

    result = rows.agg(
        mean("ease").alias("avg_readability"),
        mean("variation").alias("sentence_variation"),
        mean("coherence").alias("coherence_proxy"),
        mean("grammar").alias("grammar_score"),
    )
    if grammar_sample is None:
        return result
    sample = grammar_rows(first_rows(df, grammar_sample, key), text, ends=ends).agg(
        F.coalesce(F.avg("grammar"), F.lit(0.0)).alias("g")
    )
    return result.withColumn("grammar_score", sample.scalar())


def grammar_rows(df: DataFrame, text: str = "text", keep: Sequence[str] = (), ends: SentenceEnds | None = None) -> DataFrame:
    """The grammar score of every text as ``grammar``."""
    texts = df.select(*keep, tx.spaced(F.col(text)).alias("_p"))
    arrays = texts.withColumn("_m", ends.marked(F.col("_p"), plain=True) if ends else F.col("_p")).withColumns(
        {"_words": tx.words(F.lower("_p"), plain=True), "_s": F.size(tx.sentences(F.col("_m"), plain=True))}
    )
    score = ft.grammar_score(F.col("_p"), F.size("_words"), F.col("_s"), F.col("_words"), plain=True, marked=F.col("_m"))
    return arrays.select(*keep, score.alias("grammar"))


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Join one-row tables: the columns of all but the first come in as scalar subqueries."""
    first, *others = rows
    for other in others:
        packed = other.select(F.struct(*other.columns).alias("_row")).scalar()
        first = first.withColumn("_row", packed).select(
            *first.columns, *[F.col("_row")[c].alias(c) for c in other.columns]
        )
    return first


def ngram_row(ratios: DataFrame, max_n: int = 4) -> DataFrame:
    """``distinct_1`` … as one row."""
    return ratios.agg(*[F.max(F.when(F.col("n") == n, F.col("ratio"))).alias(f"distinct_{n}") for n in range(1, max_n + 1)])


def _mean_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts) / len(parts)


def quality_part() -> Column:
    readable = F.least(F.coalesce("avg_readability", F.lit(0.0)) / 100, F.lit(1.0))
    return _mean_of(
        [F.coalesce("grammar_score", F.lit(0.0)), readable, F.coalesce("coherence_proxy", F.lit(0.0))]
    )


def diversity_part() -> Column:
    spread = F.least(F.coalesce("entropy", F.lit(0.0)) / 10, F.lit(1.0))
    return _mean_of([F.coalesce("distinct_2", F.lit(0.0)), F.coalesce("vocab_diversity", F.lit(0.0)), spread])


def overall_score(parts: Mapping[str, Column], weights: Mapping[str, float] = fixed.MODEL_WEIGHTS) -> Column:
    """Weighted mean over the parts that are present (not NULL); 0 without any."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, part in parts.items():
        total = total + F.coalesce(part * weights[name], F.lit(0.0))
        weight = weight + F.when(part.isNotNull(), weights[name]).otherwise(0.0)
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0))


def composite_scores(report: DataFrame, weights: Mapping[str, float] = fixed.MODEL_WEIGHTS) -> DataFrame:
    """Add quality, diversity and overall score to a one-row report with ``task_performance``."""
    made = report.withColumns({"quality_score": quality_part(), "diversity_score": diversity_part()})
    parts = {n: F.col(n) for n in ("quality_score", "task_performance", "diversity_score")}
    return made.withColumn("overall_score", overall_score(parts, weights))


def family_composite(
    df: DataFrame,
    families: Mapping[str, Sequence[str]],
    weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """Mean of each family of columns and their weighted sum; a family without a weight counts 0.25."""
    weights = weights or {}
    made = df.withColumns(
        {name: _mean_of([F.coalesce(F.col(c), F.lit(0.5)) for c in columns]) for name, columns in families.items()}
    )
    total = reduce(
        lambda a, b: a + b,
        [F.col(n) * float(weights.get(n, fixed.DEFAULT_FAMILY_WEIGHT)) for n in families],
    )
    return made.withColumn("overall", total)

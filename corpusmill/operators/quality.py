"""Row quality scores of instruction/response pairs.

The scorer is one DataFrame transform without a shuffle. Arrays that several scores need (words,
sentences, tokens) are columns of an earlier projection, so each text is tokenised once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import features as ft
from corpusmill.functions import fixed
from corpusmill.functions import text as tx
from corpusmill.operators.sentences import SentenceEnds

COMPONENTS = ["clarity", "response_quality", "diversity", "complexity"]


def _mean(*parts: Column) -> Column:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total / len(parts)


def _prepared(df: DataFrame, instruction: str, response: str, counter, ends: SentenceEnds | None = None) -> DataFrame:
    """Add the shared arrays as ``_``-columns, in a chain of projections so that none is recomputed."""
    texts = df.withColumns(
        {
            "_ins": F.coalesce(F.col(instruction), F.lit("")),
            "_res": F.coalesce(F.col(response), F.lit("")),
        }
    )
    cleaned = texts.withColumns(
        {
            "_ins_l": F.lower("_ins"),
            "_res_l": F.lower("_res"),
            "_ins_s": tx.spaced(F.col("_ins")),
            "_res_s": F.lower(tx.spaced(F.col("_res"))),
        }
    ).withColumns(
        {
            "_ins_m": ends.marked(F.col("_ins_s"), plain=True) if ends else F.col("_ins_s"),
            "_both": F.concat("_ins_l", F.lit(" "), "_res_l"),
            "_both_s": F.concat(F.lower("_ins_s"), F.lit(" "), "_res_s"),
        }
    )
    arrays = cleaned.withColumns(
        {
            "_ins_words": tx.word_count(F.col("_ins_s"), plain=True),
            "_ins_sents": F.size(tx.sentences(F.col("_ins_m"), plain=True)),
            "_res_sents": F.transform(ends.sentences(tx.spaced(F.col("_res")), plain=True), F.lower)
            if ends
            else tx.sentences(F.col("_res_s"), plain=True),
            "_content": ft.content_tokens(F.col("_res_s")),
            "_both_words": tx.words(F.col("_both_s"), plain=True),
            "_both_tokens": counter(F.col("_both")) if counter else tx.tokens(F.col("_both_s"), plain=True),
        }
    )
    derived = arrays.withColumns(
        {
            "_lengths": ft.sentence_lengths(F.col("_res_sents"), plain=True),
            # Grams are words joined by ``_``. Where no word holds one, a gram is its words, and their hashes are counted.
            "_joined": F.contains("_both_s", F.lit("_")),
            "_keys": F.transform("_both_words", lambda w: F.xxhash64(w)),
        }
    )
    derived = derived.withColumns(
        {
            "_bigrams": F.when(F.col("_joined"), tx.ngrams(F.col("_both_words"), 2, "_")),
            "_bigram_keys": F.when(~F.col("_joined"), tx.gram_keys(F.col("_keys"), 2)),
        }
    )
    return derived.withColumns(
        {
            "_ins_ease": ft.flesch_reading_ease(
                F.col("_ins_words"), F.col("_ins_sents"), tx.syllables(F.col("_ins_s"), plain=True)
            ),
            "_moments": ft.length_moments(F.col("_lengths")),
            "_distinct_bigrams": F.when(F.col("_joined"), F.size(F.array_distinct("_bigrams"))).otherwise(
                F.size(F.array_distinct("_bigram_keys"))
            ),
            "_distinct_trigrams": F.when(
                F.col("_joined"), F.size(F.array_distinct(tx.ngrams(F.col("_both_words"), 3, "_", shorter=F.col("_bigrams"))))
            ).otherwise(F.size(F.array_distinct(tx.gram_keys(F.col("_keys"), 3, shorter=F.col("_bigram_keys"))))),
        }
    )


def clarity() -> Column:
    ins = F.col("_ins")
    n, sents = F.col("_ins_words"), F.col("_ins_sents")
    directive = F.contains(ins, F.lit("?")) | tx.any_pattern("_ins_l", fixed.INSTRUCTION_PATTERNS)
    ease = F.col("_ins_ease")
    readable = (
        F.when(ease.isNull(), 0.7)
        .when(ease < 30, 0.6)
        .when(ease > 80, 0.9)
        .otherwise(0.7 + (ease - 30) / 200)
    )
    vague = tx.contains_count("_ins_l", fixed.VAGUE_WORDS)
    capital = ft.capital_ratio(F.col("_ins_m"), sents, plain=True)
    score = _mean(
        ft.instruction_length_score(n),
        F.when(directive, 1.0).otherwise(0.6),
        readable,
        F.greatest(F.lit(0.4), 1.0 - vague * 0.2),
        F.coalesce(0.5 + capital * 0.5, F.lit(0.6)),
    )
    return F.when(ins == "", 0.0).otherwise(score)


def response_quality() -> Column:
    res = F.col("_res")
    asks_code = F.contains("_ins_l", F.lit("code")) | F.contains("_ins_l", F.lit("function"))
    n = F.col("_moments.total")
    structure = (
        0.6
        + F.when(ft.has_paragraphs(res, blank_line=False), 0.2).otherwise(0.0)
        + F.when(ft.has_list(res, bullets=True), 0.1).otherwise(0.0)
        + F.when(ft.has_code_definition(res) & asks_code, 0.1).otherwise(0.0)
    )
    spread = ft.length_variation(F.col("_moments"))
    flow = F.when(
        F.size("_res_sents") > 2, F.when(spread.between(0.3, 0.7), 1.0).otherwise(0.7)
    ).otherwise(0.8)
    complete = (
        F.when(tx.strip(res) == "", 0.0)
        .when(ft.ends_open(res), 0.4)
        .when(ft.ends_properly(res), 1.0)
        .otherwise(0.7)
    )
    score = _mean(
        ft.response_length_score(n),
        F.least(F.lit(1.0), structure),
        flow,
        complete,
        ft.information_density(F.col("_content")),
    )
    return F.when(res == "", 0.0).otherwise(score)


def diversity() -> Column:
    words, toks = F.col("_both_words"), F.col("_both_tokens")
    n = F.size(words)
    vocab = F.least(F.lit(1.0), tx.distinct_ratio(toks) * 2)
    topics = tx.contains_count("_both", fixed.COMMON_TOPICS)
    templates = tx.pattern_hits("_res_l", fixed.TEMPLATE_PATTERNS)
    bigrams = ft.distinct_count_ratio(F.col("_distinct_bigrams"), n, 2)
    trigrams = ft.distinct_count_ratio(F.col("_distinct_trigrams"), n, 3)
    total = (
        vocab
        + bigrams
        + trigrams
        + (1.0 - F.least(topics * 0.05, F.lit(0.3)))
        + F.greatest(F.lit(0.5), 1.0 - templates * 0.1)
    )
    parts = 3 + (n >= 2).cast("int") + (n >= 3).cast("int")
    return F.when(n == 0, 0.0).otherwise(total / parts)


def complexity() -> Column:
    sents = F.col("_res_sents")
    in_sentence = tx.contains_count_sql("s", fixed.CLAUSE_WORDS)
    clauses = F.expr(f"aggregate(_res_sents, 0, (a, s) -> a + {in_sentence})")
    structure = F.when(
        F.size(sents) > 3,
        F.least(F.lit(1.0), 0.5 + F.try_divide(clauses, F.size(sents)) * 0.5),
    ).otherwise(0.6)
    return _mean(
        F.least(F.lit(1.0), 0.5 + tx.contains_count("_ins_l", fixed.COMPLEX_INDICATORS) * 0.25),
        F.least(F.lit(1.0), 0.4 + tx.contains_count("_res_l", fixed.STEP_INDICATORS) * 0.15),
        F.least(F.lit(1.0), 0.5 + tx.contains_count("_res_l", fixed.TECHNICAL_INDICATORS) * 0.1),
        F.least(F.lit(1.0), 0.6 + tx.contains_count("_res_l", fixed.KNOWLEDGE_INDICATORS) * 0.2),
        structure,
    )


_SCORERS = {
    "clarity": clarity,
    "response_quality": response_quality,
    "diversity": diversity,
    "complexity": complexity,
}


def score_components(
    df: DataFrame,
    instruction: str = "instruction",
    response: str = "response",
    only: list[str] | None = None,
    counter: Callable[[Column], Column] | None = None,
    ends: SentenceEnds | None = None,
) -> DataFrame:
    """Add one column per quality dimension.

    ``counter`` turns a text column into a token array (``text.tokens`` by default); pass a
    ``pandas_udf`` to plug in a tokenizer. ``ends`` cuts sentences as learned from a corpus.
    """
    wanted = only or COMPONENTS
    scored = _prepared(df, instruction, response, counter, ends).withColumns(
        {name: _SCORERS[name]() for name in wanted}
    )
    return scored.select(*df.columns, *wanted)


def weighted_total(weights: Mapping[str, float] = fixed.DIMENSION_WEIGHTS) -> Column:
    total = F.lit(0.0)
    for name in COMPONENTS:
        total = total + F.col(name) * float(weights[name])
    return total


def score_pairs(
    df: DataFrame,
    instruction: str = "instruction",
    response: str = "response",
    weights: Mapping[str, float] = fixed.DIMENSION_WEIGHTS,
    counter: Callable[[Column], Column] | None = None,
    ends: SentenceEnds | None = None,
) -> DataFrame:
    """Add ``score`` and the struct ``components`` to every pair; ``ends`` cuts sentences as learned from a corpus."""
    scored = score_components(df, instruction, response, counter=counter, ends=ends)
    return scored.withColumn("score", weighted_total(weights)).select(
        *df.columns, "score", F.struct(*COMPONENTS).alias("components")
    )


def attach_scores(df: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Rows with their stored score as ``quality_score`` and ``quality_components``."""
    meta = scores.select(
        key, F.col("score").alias("quality_score"), F.col("components").alias("quality_components")
    )
    return df.join(meta, key)

"""Scores, flags and ratios of one text, each a Column built from built-in functions.

Functions that take ``words``, ``sents`` or ``toks`` expect the arrays of ``functions.text``; pass
columns that are already computed so that a text is tokenised once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import text as tx

# Flags that make Java read a pattern as Python does: Unicode classes, only \n ends a line.
PYTHON_FLAGS = "(?dmU)"
LIST_MARK = PYTHON_FLAGS + r"^\s*[\d\-*]"
LIST_MARK_BULLET = PYTHON_FLAGS + r"^\s*[\d•\-*]"


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(empty))


# --- readability ----------------------------------------------------------------------------------
def flesch_reading_ease(n_words: Column, n_sents: Column, n_syllables: Column) -> Column:
    """Flesch reading ease; NULL for a text without words."""
    return (
        F.lit(206.835)
        - F.lit(1.015) * F.try_divide(n_words, n_sents)
        - F.lit(84.6) * F.try_divide(n_syllables, n_words)
    )


def flesch_kincaid_grade(n_words: Column, n_sents: Column, n_syllables: Column) -> Column:
    return (
        F.lit(0.39) * F.try_divide(n_words, n_sents)
        + F.lit(11.8) * F.try_divide(n_syllables, n_words)
        - F.lit(15.59)
    )


# --- sentences ------------------------------------------------------------------------------------
def capital_ratio(text: Column, n_sents: Column, plain: bool = False) -> Column:
    """Share of sentences that start with an upper-case letter; NULL without sentences."""
    return F.try_divide(tx.capital_sentences(text, plain), n_sents)


def sentence_lengths(sents: Column, plain: bool = False) -> Column:
    return F.transform(sents, lambda s: tx.word_count(s, plain))


def length_moments(lengths: Column) -> Column:
    """Struct of count, sum and sum of squares of an integer array; make it a column of its own."""
    zero = F.lit(0).cast("bigint")
    return F.struct(
        F.size(lengths).cast("bigint").alias("n"),
        F.aggregate(lengths, zero, lambda a, x: a + x).alias("total"),
        F.aggregate(lengths, zero, lambda a, x: a + x.cast("bigint") * x).alias("squares"),
    )


def length_std(moments: Column) -> Column:
    """Population standard deviation; 0 for an empty array."""
    n, total, squares = moments["n"], moments["total"], moments["squares"]
    # n * sum(x^2) - sum(x)^2 is an exact integer, so equal lengths give exactly 0.
    return F.coalesce(F.sqrt(F.try_divide(n * squares - total * total, n * n)), F.lit(0.0))


def length_variation(moments: Column) -> Column:
    """Spread of the lengths relative to their mean plus one."""
    return length_std(moments) / (ratio(moments["total"], moments["n"]) + 1)


def sentence_words(sents: Column, plain: bool = False) -> Column:
    """Per sentence its set of alphanumeric lower-case words that are not stop words."""
    return F.transform(
        sents, lambda s: F.array_distinct(tx.not_stop_words(tx.alnum_words(F.lower(s), plain)))
    )


def coherence(word_sets: Column) -> Column:
    """Mean Jaccard overlap of neighbouring sentences (arrays without repeats); NULL with fewer than two sentences."""
    n = F.size(word_sets)
    heads = F.slice(word_sets, F.lit(1), F.greatest(n - 1, F.lit(0)))
    tails = F.slice(word_sets, F.lit(2), F.greatest(n - 1, F.lit(0)))
    # The union of two sets follows from their sizes and what they share, which is found once.
    cells = F.zip_with(
        heads, tails, lambda a, b: F.struct(F.size(F.array_intersect(a, b)).alias("both"), (F.size(a) + F.size(b)).alias("sum"))
    )
    pairs = F.transform(cells, lambda c: F.when(c["both"] > 0, c["both"] / (c["sum"] - c["both"])).otherwise(F.lit(0.0)))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 1, total / F.when(n > 1, n - 1))


def sentence_repetition(sents: Column) -> Column:
    return F.when(F.size(sents) > 1, 1 - tx.distinct_ratio(sents)).otherwise(F.lit(0.0))


def distinct_gram_ratio(grams: Column, n_items: Column, n: int) -> Column:
    """Distinct n-grams over all; the total follows from the number of items, so ``grams`` is built once."""
    return distinct_count_ratio(F.size(F.array_distinct(grams)), n_items, n)


def distinct_count_ratio(distinct: Column, n_items: Column, n: int) -> Column:
    """The same from the number of distinct n-grams."""
    total = F.when(n_items >= n, n_items - (n - 1))
    return F.coalesce(F.try_divide(distinct, total), F.lit(0.0))


def trigram_repetition(toks: Column) -> Column:
    ratio_of_three = distinct_gram_ratio(tx.ngrams(toks, 3), F.size(toks), 3)
    return F.when(F.size(toks) > 3, 1 - ratio_of_three).otherwise(F.lit(0.0))


# --- endings and structure ------------------------------------------------------------------------
def ends_properly(text: Column) -> Column:
    """The last character is ``.``, ``!`` or ``?``; looks at the end only."""
    return F.substring(tx.rstrip(text), -1, 1).isin(".", "!", "?")


def ends_open(text: Column, with_the: bool = True) -> Column:
    """Stops on a comma, a semicolon or a conjunction."""
    end = tx.rstrip(text)
    open_ends = [",", ";", "and", "or", *(["the"] if with_the else [])]
    found = F.lit(False)
    for piece in open_ends:
        found = found | F.endswith(end, F.lit(piece))
    return found


def has_paragraphs(text: Column, blank_line: bool = True) -> Column:
    return F.contains(text, F.lit("\n\n" if blank_line else "\n"))


def has_list(text: Column, bullets: bool = False) -> Column:
    return text.rlike(LIST_MARK_BULLET if bullets else LIST_MARK)


def has_list_marks(text: Column) -> Column:
    """The loose variant: a marker anywhere in the text."""
    return F.contains(text, F.lit("•")) | F.contains(text, F.lit("- ")) | F.contains(
        text, F.lit("* ")
    ) | F.contains(text, F.lit("\n1."))


def has_code(text: Column) -> Column:
    return F.contains(text, F.lit("```")) | F.contains(text, F.lit("def "))


def has_code_or_function(text: Column) -> Column:
    return has_code(text) | F.contains(text, F.lit("function "))


def has_code_definition(text: Column) -> Column:
    """A fence, or ``def``/``function`` followed by a name."""
    return F.contains(text, F.lit("```")) | text.rlike(PYTHON_FLAGS + r"def\s+\w+|function\s+\w+")


def has_digit(text: Column) -> Column:
    return text.rlike(r"\p{Nd}")


def is_repetitive(lower_words: Column) -> Column:
    """More than ten words of which fewer than half are distinct."""
    return (F.size(lower_words) > 10) & (tx.distinct_ratio(lower_words) < 0.5)


# --- composites -----------------------------------------------------------------------------------
def content_tokens(lower_text: Column) -> Column:
    """Alphanumeric tokens of at least three characters that are not stop words."""
    return tx.not_stop_words(F.regexp_extract_all(lower_text, F.lit(rf"{tx.ALNUM}{{3,}}"), F.lit(0)))


def information_density(content: Column) -> Column:
    """Distinct share of the content tokens, scaled by 1.5 and capped at 1; 0.3 without any."""
    scaled = F.least(F.lit(1.0), tx.distinct_ratio(content) * 1.5)
    return F.when(F.size(content) > 0, scaled).otherwise(F.lit(0.3))


def element_coverage(text: Column, elements: Column) -> Column:
    """Share of the expected strings found in the text, ignoring case; 1 when none is expected."""
    found = F.filter(elements, lambda e: F.contains(F.lower(text), F.lower(e)))
    return F.coalesce(F.try_divide(F.size(found), F.size(elements)), F.lit(1.0))


def length_ratio(generated: Column, reference: Column) -> Column:
    """Words generated per reference word; NULL for an empty reference."""
    return F.when(
        reference != "", tx.word_count(generated) / F.greatest(tx.word_count(reference), F.lit(1))
    )


def punctuation_ratio(text: Column) -> Column:
    marks = F.length(text) - F.length(F.translate(text, ".!?;:,", ""))
    return ratio(marks, F.length(text))


def grammar_score(
    text: Column,
    n_words: Column,
    n_sents: Column,
    lower_words: Column,
    plain: bool = False,
    marked: Column | None = None,
) -> Column:
    """Capitals, punctuation, sentence length near 17.5 words and varied vocabulary, at most 1.

    ``marked`` is the text in which periods that end no sentence are marked, where sentence ends are learned.
    """
    starts = text if marked is None else marked
    mean_length = F.try_divide(n_words, n_sents)
    length_part = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(mean_length - 17.5) / 17.5)
    return F.least(
        F.lit(0.3) * F.coalesce(capital_ratio(starts, n_sents, plain), F.lit(0.0))
        + F.lit(0.2) * F.least(punctuation_ratio(text) * 20, F.lit(1.0))
        + F.lit(0.3) * F.when(n_sents > 0, length_part).otherwise(F.lit(0.0))
        + F.lit(0.2) * tx.distinct_ratio(lower_words),
        F.lit(1.0),
    )


def instruction_length_score(n: Column) -> Column:
    return (
        F.when(n < 3, 0.3).when(n > 100, 0.7).when(n.between(5, 50), 1.0).otherwise(0.85)
    )


def response_length_score(n: Column) -> Column:
    return F.when(n < 5, 0.2).when(n > 1000, 0.7).when(n.between(20, 500), 1.0).otherwise(0.8)


def composite_output_score(diversity: Column, coverage: Column, properly: Column) -> Column:
    return diversity * 0.3 + coverage * 0.4 + properly.cast("double") * 0.3


def generation_coherence(text: Column) -> Column:
    """1 for a proper ending, 0.5 otherwise, NULL for a blank text."""
    return F.when(tx.strip(text) != "", F.when(ends_properly(text), 1.0).otherwise(0.5))


def generation_diversity(text_words: Column) -> Column:
    """Distinct share of the words; NULL for a blank text."""
    return F.try_divide(F.size(F.array_distinct(text_words)), F.size(text_words))

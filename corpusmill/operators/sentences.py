"""Sentence ends learned from the corpus: abbreviations and words that begin sentences, without labels.

An abbreviation is a word that is followed by a period much more often than chance has it, is short, and seldom stands
without one. A sentence starter follows sentence ends much more often than other words. Both are counted over the whole
corpus with map-side combination; what is learned is a list of words, which becomes part of a regular expression, so that
texts are cut without Python and without a join. It grows with the vocabulary and is never cut.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.session import keep

#: Put after a period that ends no sentence; it is not a character and is taken out again.
MARK = "\ufdd0"
#: A word is an abbreviation, or a sentence starter, from this score on.
ABBREVIATION, STARTER = 0.3, 30.0

WORD = r"^\p{L}(?:[\p{L}.]*\p{L})?$"
FIRST_WORD = r"^\p{L}+"


def _pattern(words: Iterable[str]) -> str:
    """One pattern for all words, common beginnings written once; nothing matches an empty list."""

    def grouped(rest: list[str]) -> str:
        common = os.path.commonprefix([rest[0], rest[-1]]) if rest else ""  # they are sorted
        branches: dict[str, list[str]] = {}
        for word in rest:
            if word != common:
                branches.setdefault(word[len(common)], []).append(word[len(common) :])
        parts = [grouped(tails) for _, tails in sorted(branches.items())]
        tail = "(?:" + "|".join(parts) + ")" + ("?" if common in rest else "") if parts else ""
        return common.replace(".", "\\.") + tail

    return grouped(sorted(set(words))) or "(?!)"


@dataclass(frozen=True)
class SentenceEnds:
    """Where sentences end. A period ends none after an abbreviation or an initial, unless a capitalised starter
    follows; nor after a number before a small letter; nor do three periods before anything but a capital."""

    abbreviations: tuple[str, ...] = ()
    starters: tuple[str, ...] = ()

    def marked(self, text: Column, plain: bool = False) -> Column:
        """The text with ``MARK`` after every period before white space that ends no sentence."""
        gap, other = (" ", "[^ ]") if plain else (tx.SPACE, f"(?!{tx.SPACE}).")
        inner = r"[^\p{L}\p{N} ]" if plain else rf"(?!{tx.SPACE})[^\p{{L}}\p{{N}}]"
        begin = rf"(?<=\A|{gap})(?:{inner})*+"
        starter = rf"{gap}+(?=\p{{Lu}})(?iu:{_pattern(self.starters)})(?!\p{{L}})"
        short = rf"(?:(?iu:{_pattern(self.abbreviations)})|\p{{L}}(?=\.{gap}+\p{{Lu}}))\.(?={gap})(?!{starter})"
        number = rf"\p{{Nd}}++\.(?={gap}+\p{{Ll}})"
        dots = rf"(?<=\.\.\.)(?={gap}+(?!\p{{Lu}}){other})"
        return F.regexp_replace(text, rf"(?s){begin}(?:{short}|{number})|{dots}", "$0" + MARK)

    def sentences(self, text: Column, plain: bool = False) -> Column:
        """The sentences of a text."""
        pieces = tx.sentences(self.marked(text, plain), plain)
        return F.transform(pieces, lambda s: F.replace(s, F.lit(MARK), F.lit("")))


def _words(df: DataFrame, text: str) -> DataFrame:
    """(_w): the white-space words of every text."""
    return df.select(tx.words(F.coalesce(F.col(text), F.lit(""))).alias("_w"))


def _core(word: Column) -> Column:
    """A word without what is neither letter nor digit before it."""
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+", "")


def _sum_log(hits: Column, misses: Column, share: Column) -> Column:
    return hits * F.log(share) + misses * F.log(1 - share)


def abbreviation_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, with_period, without, score) of every word that ever ends in a period.

    The score is the log-likelihood ratio of 'nearly always a period' against 'as often as any word', times the number
    of periods in it, falling with its letters and with the times it stands without.
    """
    # Patterns are applied to distinct words only; what they give is small and kept, so that the texts are read once.
    seen = _words(df, text).select(F.explode("_w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("times"))
    words = seen.select(F.regexp_replace(_core(F.col("word")), r"[^\p{L}\p{N}.]+$", "").alias("c"), "times")
    ends = F.endswith("c", F.lit(".")) & ~F.endswith("c", F.lit(".."))
    types = words.select(F.lower(F.when(ends, F.expr("left(c, length(c) - 1)")).otherwise(F.col("c"))).alias("word"), ends.alias("e"), "times")

    def times(wanted: Column) -> Column:
        return F.sum(F.when(wanted, F.col("times")).otherwise(0))

    counted = keep(types.groupBy("word").agg(times(F.col("e")).alias("with_period"), times(~F.col("e")).alias("without")), "words")
    total = counted.agg((F.sum("with_period") / F.sum(F.col("with_period") + F.col("without"))).alias("s")).scalar()
    cells = counted.where(F.col("word").rlike(WORD) & (F.col("with_period") > 0)).withColumn("_p", total)
    hits, misses, periods = F.col("with_period"), F.col("without"), F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = F.length("word") - periods + 1
    gain = 2 * (_sum_log(hits, misses, F.lit(0.99)) - _sum_log(hits, misses, F.col("_p")))
    score = gain * F.exp(-letters) * (periods + 1) * F.pow(letters.cast("double"), -misses)
    return cells.select("word", "with_period", "without", score.alias("score")).where("score IS NOT NULL AND NOT isnan(score)")


def starter_scores(df: DataFrame, abbreviations: Iterable[str], text: str = "text") -> DataFrame:
    """(word, after_end, times, score): how much more often than by chance words follow a sentence end."""
    before = F.col("before")
    core = F.lower(_core(before))
    short = F.rlike("core", F.lit(rf"\A(?:{_pattern(abbreviations)})\.\z"))
    # Only the few words that end in a period are looked at by patterns row by row, the others as distinct words.
    dotted = F.when(F.endswith(before, F.lit(".")), core)
    pairs = _words(df, text).select(F.inline(F.arrays_zip(F.col("_w").alias("word"), F.concat(F.array(F.lit("")), "_w").alias("before"))))
    rows = pairs.where("word IS NOT NULL").select("word", dotted.alias("core"), F.substring(before, -1, 1).isin(".", "!", "?").alias("e"))
    rows = rows.select("word", (F.col("e") & ~F.coalesce(F.endswith("core", F.lit(".")) & short, F.lit(False))).alias("e"))
    seen = rows.groupBy("word").agg(F.count_if("e").alias("after_end"), F.count(F.lit(1)).alias("times"))
    first = F.lower(F.regexp_extract("word", FIRST_WORD, 0)).alias("word")
    counted = keep(seen.select(first, "after_end", "times").groupBy("word").agg(F.sum("after_end").alias("after_end"), F.sum("times").alias("times")), "starters")
    totals = counted.agg(F.sum("after_end").alias("a"), F.sum("times").alias("n")).select(F.struct("a", "n").alias("t")).scalar()
    cells = counted.where("word <> ''").withColumn("_t", totals).select("*", "_t.*")
    a, n, b, ab = (F.col(c).cast("double") for c in ("a", "n", "times", "after_end"))
    together, apart = ab / a, F.try_divide(b - ab, n - a)

    def own(hits: Column, misses: Column, share: Column) -> Column:
        return F.when((share > 0) & (share < 1), _sum_log(hits, misses, share)).otherwise(0.0)

    gain = own(ab, a - ab, together) + own(b - ab, n - a - b + ab, apart) - own(ab, a - ab, b / n) - own(b - ab, n - a - b + ab, b / n)
    more = ab * n > a * b
    scored = cells.where("a > 0").select("word", "after_end", "times", F.when(more, 2 * gain).otherwise(0.0).alias("score"))
    return scored.where("score IS NOT NULL")


def _strongest(scores: DataFrame, least: float, most: int | None) -> tuple[str, ...]:
    """All words from a score on, the strongest first, or only ``most`` of them if the caller wants no more."""
    rows = scores.where(F.col("score") >= least).select("word", "score")
    rows = rows if most is None else rows.orderBy(F.desc("score"), "word").limit(most)
    return tuple(r.word for r in sorted(rows.collect(), key=lambda r: (-r.score, r.word)))


def abbreviations(df: DataFrame, text: str = "text", most: int | None = None) -> tuple[str, ...]:
    """The abbreviations of a corpus; they reach the driver."""
    return _strongest(abbreviation_scores(df, text), ABBREVIATION, most)


def learn(df: DataFrame, text: str = "text", most: int | None = None) -> SentenceEnds:
    """Abbreviations and sentence starters of a corpus. Null and empty texts teach nothing; an empty table gives the
    plain rule."""
    short = abbreviations(df, text, most)
    return SentenceEnds(short, _strongest(starter_scores(df, short, text), STARTER, most))

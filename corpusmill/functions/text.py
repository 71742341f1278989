"""Text, token and n-gram expressions. All of them are built-in Spark SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.fixed import SPACE_CHARS, STOP_WORDS

# The same set, nested so that a letter fails after three tests instead of a dozen.
SPACE = (
    r"[\t-\r\x1c-\x20[\x{80}-\x{3000}&&[\x{85}\x{a0}\x{1680}"
    r"[\x{2000}-\x{3000}&&[\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]]]"
)
ALNUM = r"[\p{L}\p{N}]"


def _all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def strip(text: Column) -> Column:
    """Without leading and trailing Unicode white space (``trim`` alone drops blanks only)."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE_CHARS))


def spaced(text: Column) -> Column:
    """Every white-space character as a blank.

    The functions below take ``plain=True`` for a text that went through this: make it a column of its
    own where several of them read the same text, and they need no Unicode class any more.
    """
    return F.translate(text, SPACE_CHARS, " " * len(SPACE_CHARS))


def _plain(text: Column, plain: bool) -> Column:
    return text if plain else spaced(text)


def words(text: Column, plain: bool = False) -> Column:
    """Runs of non-space characters.

    Splitting at single blanks needs no regular expression; the empty pieces between neighbouring
    blanks are removed.
    """
    return F.array_remove(F.split(_plain(text, plain), " "), "")


def word_count(text: Column, plain: bool = False) -> Column:
    return F.size(words(text, plain))


def sentences(text: Column, plain: bool = False) -> Column:
    """Pieces that end in ``.``, ``!`` or ``?`` before white space; empty for a blank text."""
    trimmed = F.trim(text) if plain else strip(text)
    return F.array_remove(F.split(trimmed, f"(?<=[.!?]){' ' if plain else SPACE}+"), "")


def capital_sentences(text: Column, plain: bool = False) -> Column:
    """How many sentences start with an upper-case letter, counted in one scan of the text."""
    gap = " " if plain else SPACE
    trimmed = F.trim(text) if plain else strip(text)
    return F.size(_all_matches(trimmed, rf"(?:\A|[.!?]{gap}+)\p{{Lu}}"))


def tokens(text: Column, plain: bool = False) -> Column:
    """Alphanumeric runs and single punctuation marks."""
    mark = r"[^ \p{L}\p{N}]" if plain else rf"(?!{SPACE})[^\p{{L}}\p{{N}}]"
    return _all_matches(text, f"{ALNUM}++|{mark}")


def alnum_words(text: Column, plain: bool = False) -> Column:
    """White-space words that are alphanumeric throughout."""
    return _all_matches(_plain(text, plain), rf"(?<![^ ]){ALNUM}+(?![^ ])")


def not_stop_words(items: Column) -> Column:
    return F.filter(items, lambda w: ~w.isin(STOP_WORDS))


def rouge_tokens(text: Column) -> Column:
    """Lower-case ASCII letter and digit runs, as overlap scoring without a stemmer uses."""
    return _all_matches(F.lower(text), "[a-z0-9]+")


def bleu_tokens(text: Column) -> Column:
    """The public mteval-13a rules: split punctuation off, but not inside numbers."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.replace(text, F.lit("-\n"), F.lit("")), "\n", " "), F.lit(" "))
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        spaced = F.replace(spaced, F.lit(entity), F.lit(char))
    for pattern, to in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
        (r"([^0-9])([\.,])", "$1 $2 "),
        (r"([\.,])([^0-9])", " $1 $2"),
        (r"([0-9])(-)", "$1 $2 "),
    ):
        spaced = F.regexp_replace(spaced, pattern, to)
    return words(spaced)


def syllables(text: Column, plain: bool = False) -> Column:
    """Vowel groups, and one for each word without a vowel."""
    lowered = F.lower(_plain(text, plain))
    return F.size(_all_matches(lowered, "[aeiouy]+|(?<![^ ])[^ aeiouy]+(?![^ ])"))


def ngrams(items: Column, n: int, sep: str = " ", shorter: Column | None = None) -> Column:
    """The n-grams of an array, joined; empty when the array is shorter than ``n``.

    Built by zipping the (n-1)-grams (``shorter``, if they are a column already) with the shifted
    items, so no slice is copied per position.
    """
    if n == 1:
        return items
    shorter = ngrams(items, n - 1, sep) if shorter is None else shorter
    length = F.greatest(F.size(items) - (n - 1), F.lit(0))
    return F.zip_with(
        F.slice(shorter, F.lit(1), length),
        F.slice(items, F.lit(n), length),
        lambda head, last: F.concat(head, F.lit(sep), last),
    )


def gram_keys(keys: Column, n: int, shorter: Column | None = None) -> Column:
    """64-bit hashes of the n-grams of an array that is given as hashes of its items (``keys``).

    ``shorter`` are those of the (n-1)-grams. They are for counting the distinct grams of one text: of N different
    grams, fewer than N * N / 2 ** 65 pairs are expected to share a hash, 3e-10 in a text of 100,000 words.
    """
    shorter = keys if shorter is None else shorter
    length = F.greatest(F.size(keys) - (n - 1), F.lit(0))
    return F.zip_with(F.slice(shorter, F.lit(1), length), F.slice(keys, F.lit(n), length), lambda head, last: F.xxhash64(head, last))


def distinct_ratio(items: Column) -> Column:
    """Distinct items over all items, 0 for an empty array."""
    return F.coalesce(F.try_divide(F.size(F.array_distinct(items)), F.size(items)), F.lit(0.0))


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains_count_sql(text: str, needles: list[str]) -> str:
    return " + ".join(f"cast(contains({text}, {_literal(n)}) as int)" for n in needles)


def contains_count(text: str, needles: list[str]) -> Column:
    """How many of the fixed strings occur in the named column, each counted once.

    One parsed expression: building long lists call by call is slow on the driver.
    """
    return F.expr(contains_count_sql(text, needles))


def pattern_hits(text: str, patterns: list[str]) -> Column:
    """How many of the patterns match somewhere (``^`` at any line), each counted once."""
    return F.expr(" + ".join(f"cast({text} rlike {_literal('(?dmU)' + p)} as int)" for p in patterns))


def any_pattern(text: str, patterns: list[str]) -> Column:
    """Whether one of the patterns matches (``^`` at the start of the text only)."""
    return F.col(text).rlike("(?dU)" + "|".join(f"(?:{p})" for p in patterns))


def jaccard(left: Column, right: Column) -> Column:
    """Shared over all distinct items, 0 if either side is empty."""
    return F.when(
        (F.size(left) > 0) & (F.size(right) > 0),
        F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right)),
    ).otherwise(F.lit(0.0))


def preview(text: Column, limit: int = 500) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def seeded_key(seed: int, *ids: Column) -> Column:
    """A 32-bit pseudo-random number per row from a seed and the row's id; the same on every run."""
    key = F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")

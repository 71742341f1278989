"""Suffix stripping of English words in five steps, with the usual extensions for short and irregular words.

Stems are found once per distinct word of an Arrow batch; ``stemmed`` is the column function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import fixed

IRREGULAR = {form: stem for stem, forms in fixed.STEM_IRREGULAR.items() for form in forms.split()}


def _kinds(part: str) -> str:
    """``v`` or ``c`` per letter; y is a vowel after a consonant."""
    out = ""
    for letter in part:
        vowel = letter in "aeiou" or (letter == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(part: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _kinds(part).count("vc")


def _short_end(part: str) -> bool:
    """Ends consonant, vowel, consonant (the last one not w, x or y), or is a vowel and a consonant."""
    kinds = _kinds(part)
    return kinds == "vc" or (kinds.endswith("cvc") and part[-1] not in "wxy")


def _replaced(word: str, rules, allowed: Callable[[str, str], bool]) -> str:
    """The first rule whose suffix fits decides, whether its condition holds or not."""
    for suffix, to in rules:
        if word.endswith(suffix):
            rest = word[: len(word) - len(suffix)]
            return rest + to if allowed(rest, suffix) else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ies") and len(word) == 4:
        return word[:-1]
    return _replaced(word, fixed.STEM_PLURALS, lambda rest, suffix: True)


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        rest = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in _kinds(rest):
            break
    else:
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if len(rest) > 1 and rest[-1] == rest[-2] and _kinds(rest)[-1] == "c":
        return rest if rest[-1] in "lsz" else rest[:-1]
    return rest + "e" if _measure(rest) == 1 and _short_end(rest) else rest


def _final_y(word: str) -> str:
    rest = word[:-1]
    return rest + "i" if word.endswith("y") and len(rest) > 1 and _kinds(rest)[-1] == "c" else word


def _long_suffix(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        word = word[:-2]
    # What is left of -logi keeps its l when it is measured.
    return _replaced(word, fixed.STEM_DOUBLE_SUFFIXES, lambda rest, suffix: _measure(rest + "l" * (suffix == "logi")) > 0)


def _suffix(word: str) -> str:
    return _replaced(word, fixed.STEM_SUFFIXES, lambda rest, suffix: _measure(rest) > 0)


def _last_suffix(word: str) -> str:
    return _replaced(
        word,
        [(s, "") for s in fixed.STEM_LAST_SUFFIXES.split()],
        lambda rest, suffix: _measure(rest) > 1 and (suffix != "ion" or rest[-1] in "st"),
    )


def _final_e(word: str) -> str:
    if word.endswith("e"):
        size = _measure(word[:-1])
        if size > 1 or (size == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are their own."""
    if word in IRREGULAR or len(word) <= 2:
        return IRREGULAR.get(word, word)
    for step in (_plural, _past, _final_y, _long_suffix, _suffix, _last_suffix, _final_e):
        word = step(word)
    return word


def stem_distinct(words: list[str], longer_than: int = 3) -> list[str]:
    """Stems of words of over ``longer_than`` letters, others unchanged."""
    return [stem(w) if len(w) > longer_than else w for w in words]


def stemmed(tokens: Column, longer_than: int = 3) -> Column:
    """An array of lower-case words as their stems; nulls stay."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in arrays:
            words = lists.flatten().dictionary_encode()
            stems = pa.array(stem_distinct(words.dictionary.to_pylist(), longer_than), pa.string())
            flat = stems.take(words.indices)
            sizes = lists.value_lengths()
            offsets = pa.compute.cumulative_sum(pa.concat_arrays([pa.array([0], pa.int32()), sizes.fill_null(0)]))
            yield pa.ListArray.from_arrays(offsets, flat, mask=lists.is_null())

    return F.arrow_udf(run, "array<string>")(tokens)

"""Syllables by hyphenation patterns.

A pattern is letters with levels between them, such as ``1b2la``. Every pattern that fits somewhere in a word, whose ends
are written as periods, raises the levels at its places to its own; where the level is odd in the end, a syllable
begins. Patterns are kept in a trie of their letters and applied once to every distinct word of an Arrow batch.

``english_patterns`` builds a set by rule. ``read_patterns`` takes the published pattern files (one pattern a line).
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS, CONSONANTS = "aeiouy", "bcdfghjklmnpqrstvwxz"
#: Consonants that begin a syllable together.
ONSETS = "bl br ch cl cr dr fl fr gh gl gr kn ph pl pr sc sh sk sl sm sn sp st sw th tr tw wh wr scr shr spl spr str thr".split()
#: Vowels that meet and are two syllables, and where they are one nevertheless.
APART = "i3a i3o i3u u3a u3e u3o e3o i3e. i3en i3et de3a. re3a. e3ing e3ate. o3em o3et".split()
TOGETHER = "tio sio cio gio tia cia sia tie. tien cien qua que qui quo gua gue gui guo ue. ues. ued. geou ceou ies. ied. eau".split()


def english_patterns() -> list[str]:
    """Patterns for English, made from the rules above and those on silent endings."""
    out = [f"1{c}{v}" for c, v in itertools.product(CONSONANTS, VOWELS)]
    for onset in ONSETS:
        out += [f"1{'2'.join(onset)}{v}" for v in VOWELS]
    for start in [*CONSONANTS, *ONSETS]:
        out.append(f"4{'2'.join(start)}e.")  # make, bathe
        if start not in ("t", "d", "st", "tr", "dr"):
            out.append(f"4{'2'.join(start)}ed.")  # liked, but wanted
        if start not in ("s", "z", "x", "c", "g", "ch", "sh"):
            out.append(f"4{'2'.join(start)}es.")  # makes, but boxes
    out += [f"5{c}4l{end}." for c in "bcdfgkpstz" for end in ("e", "ed", "es")]  # table
    out += APART
    for group in TOGETHER:
        out.append("".join(a + ("6" if a in VOWELS and b in VOWELS else "") for a, b in zip(group, group[1:] + " ")).strip())
    return out


def read_patterns(lines: Iterable[str]) -> list[str]:
    """The patterns of a file, one a line; comments, commands and options are left out."""
    words = (line.split("%")[0].strip() for line in lines)
    return [w for w in words if re.fullmatch(r"[^\W_]*[.\d\w]*[^\W\d_][.\d\w]*|\.[.\d\w]+", w) and any(x.isdigit() for x in w)]


def parsed(pattern: str) -> tuple[str, list[int]]:
    """The letters of a pattern and the level before each of them and at the end."""
    letters, levels = "", [0]
    for x in pattern:
        if x.isdigit():
            levels[-1] = int(x)
        else:
            letters, levels = letters + x, [*levels, 0]
    return letters, levels


class Patterns:
    """A trie of patterns. ``left`` and ``right`` are the fewest letters before the first and after the last break."""

    def __init__(self, patterns: Iterable[str], left: int = 1, right: int = 1):
        self.left, self.right, self.root = left, right, {}
        for pattern in patterns:
            letters, levels = parsed(pattern)
            node = self.root
            for letter in letters:
                node = node.setdefault(letter, {})
            node[""] = np.maximum(node[""], levels).tolist() if "" in node else levels

    def breaks(self, word: str) -> list[int]:
        """Places at which a syllable begins, after the first one."""
        framed = f".{word.lower()}."
        levels = [0] * (len(framed) + 1)
        for start in range(len(framed)):
            node = self.root
            for letter in framed[start:]:
                node = node.get(letter)
                if node is None:
                    break
                for k, level in enumerate(node.get("", ())):
                    levels[start + k] = max(levels[start + k], level)
        return [i for i in range(self.left, len(word) - self.right + 1) if levels[i + 1] % 2]

    def syllables(self, word: str) -> int:
        return len(self.breaks(word)) + 1


def word_syllables(words: Column, patterns: Patterns) -> Column:
    """The sum of the syllables of an array of words; each has at least one. Null gives null."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in arrays:
            coded = lists.flatten().dictionary_encode()
            sizes = pa.compute.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
            counts = np.array([patterns.syllables(w) for w in coded.dictionary.to_pylist()] + [0])
            row = np.repeat(np.arange(len(lists)), sizes)
            codes = coded.indices.to_numpy(zero_copy_only=False)
            sums = np.bincount(row, weights=counts[codes], minlength=len(lists)).astype(np.int64)
            yield pa.array(sums, mask=lists.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, "bigint")(words)


def syllables(text: Column, patterns: Patterns) -> Column:
    """The syllables of a text: of its runs of letters, lower-cased."""
    return word_syllables(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)), patterns)

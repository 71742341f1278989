"""Byte-pair encoding with word ends, and decoding, for tokenizer files that drop white space.

A word is a contiguous array of parts with the ranks of adjacent pairs beside it. The lowest rank is found by a scan,
the boundary there is deleted and the ranks next to it are looked up again, until no pair can be merged. All
different words of a run that have as many bytes are one matrix, so a scan step serves them all.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import append_columns, ragged, slices, small_batches, split_words, starts_of

#: Words of more bytes are merged one by one with a heap, in time n log n.
LONGEST_SCANNED = 48
SLICE_BYTES = 8 << 20
NEVER = np.iinfo(np.int32).max


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by id; the pairs that merge and their ranks in a table with linear probing; the results by rank; ids of
    bytes inside and at the end of words."""

    tokens: list[str]
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    inner: np.ndarray
    final: np.ndarray
    specials: dict[str, int]
    pattern: str


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in printable else extra))
        extra += b not in printable
    return out


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def load(path: str) -> Vocabulary:
    """Read a ``tokenizers`` file. Only lower-casing byte-level BPE with word ends and dropped white space is known."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
    suffix = model["end_of_word_suffix"]
    steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or not suffix or steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed":
        raise ValueError(f"not a lower-casing byte-level BPE file with word ends: {path}")
    vocab, specials = model["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (1 + max([*vocab.values(), *specials.values()]))
    for token, i in [*vocab.items(), *specials.items()]:
        tokens[i] = token
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    keys = np.array([vocab[a] * len(tokens) + vocab[b] for a, b in pairs], dtype=np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
    slots = 1 << max(4, (4 * len(keys)).bit_length())
    table, ranks = np.full(slots, -1), np.full(slots, NEVER, dtype=np.int32)
    place, left = slot_of(keys, slots), np.arange(len(keys))
    while len(left):  # the first of the pairs that want a free slot gets it, the others look at the next slot
        free = left[table[place[left]] < 0][::-1]
        table[place[free]], ranks[place[free]] = keys[free], free
        left = left[table[place[left]] != keys[left]]
        place[left] = (place[left] + 1) % slots
    letters = byte_letters()
    return Vocabulary(
        tokens,
        table,
        ranks,
        merged,
        np.array([vocab[x] for x in letters], dtype=np.int32),
        np.array([vocab[x + suffix] for x in letters], dtype=np.int32),
        specials,
        split["pattern"]["Regex"],
    )


def _joined(words: pa.Array, rows: np.ndarray) -> str:
    """The chosen words with line feeds between them."""
    chosen = words.take(pa.array(rows))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chosen)], pa.int32()), chosen), "\n")[0].as_py()


class Encoder:
    """Encodes words inside a task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = v = vocabulary
        self.size = len(v.tokens)
        # White space as the file's library sees it: the other separators are letters of words here.
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        pattern = v.pattern.replace(r"[^\s", "[^" + space)
        self.pieces = regex.compile(pattern).findall
        self.lines = regex.compile("\n|" + pattern).findall
        self.special = re.compile("(" + "|".join(map(re.escape, v.specials)) + ")")

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs; ``NEVER`` where they do not merge."""
        v = self.vocabulary
        key = (left.astype(np.int64) * self.size + right).ravel()
        at = slot_of(key, len(v.keys))
        other = np.flatnonzero((v.keys[at] != key) & (v.keys[at] >= 0))
        while len(other):
            at[other] = (at[other] + 1) % len(v.keys)
            other = other[(v.keys[at[other]] != key[other]) & (v.keys[at[other]] >= 0)]
        return v.ranks[at].reshape(left.shape)

    def _scan(self, parts: np.ndarray):
        """Merge the words of a matrix (words x parts); yields (row numbers, ids) of finished words."""
        rows = np.arange(len(parts))
        ranks = self._lookup(parts[:, :-1], parts[:, 1:])
        while len(rows):
            if parts.shape[1] == 1:
                yield rows, parts
                return
            at = ranks.argmin(axis=1)
            line = np.arange(len(rows))
            lowest = ranks[line, at]
            done = lowest == NEVER
            if done.any():
                yield rows[done], parts[done]
                live = ~done
                rows, parts, ranks, at, lowest = rows[live], parts[live], ranks[live], at[live], lowest[live]
                line = np.arange(len(rows))
                if not len(rows):
                    return
            width = parts.shape[1]
            parts[line, at] = self.vocabulary.merged[lowest]
            keep = np.arange(width - 1)
            parts = np.take_along_axis(parts, keep[None] + (keep[None] > at[:, None]), axis=1)
            near = np.arange(width - 2)
            shift = near[None] + (near[None] >= at[:, None])
            ranks = np.take_along_axis(ranks, shift, axis=1)
            for side in (at - 1, at):  # the pairs before and after the merged part
                ok = (side >= 0) & (side < width - 2)
                r, s = line[ok], side[ok]
                ranks[r, s] = self._lookup(parts[r, s], parts[r, s + 1])

    def _long(self, data: np.ndarray) -> np.ndarray:
        """One long word: the same merges in the same order, the next one taken from a heap."""
        part = self.vocabulary.inner[data].astype(np.int64)
        part[-1] = self.vocabulary.final[data[-1]]
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self._lookup(part[:-1], part[1:])
        found = np.flatnonzero(rank != NEVER)
        heap = [(int(rank[i]), int(i), int(part[i]), int(part[i + 1])) for i in found]
        heapq.heapify(heap)
        parts, live = part.tolist(), [True] * n
        while heap:
            lowest, i, a, b = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i] = int(self.vocabulary.merged[lowest])
            live[j], after[i] = False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    r = int(self._lookup(np.array([parts[x]]), np.array([parts[y]]))[0])
                    if r != NEVER:
                        heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return np.array([p for p, ok in zip(parts, live) if ok], dtype=np.int32)

    def merge(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids) of the short words that are these runs of bytes, none empty."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            if size > LONGEST_SCANNED:
                found.extend((np.array([i]), self._long(data[starts[i] : starts[i] + size])[None]) for i in own.tolist())
                continue
            raw = data[starts[own][:, None] + np.arange(size)]
            parts = self.vocabulary.inner[raw]
            parts[:, -1] = self.vocabulary.final[raw[:, -1]]
            found.extend((own[r], ids) for r, ids in self._scan(parts))
        counts = np.zeros(len(sizes), dtype=np.int64)
        for rows, ids in found:
            counts[rows] = ids.shape[1]
        at = starts_of(counts)
        out = np.empty(int(at[-1]), dtype=np.int32)
        for rows, ids in found:
            out[at[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, counts

    def _merge_text(self, word: str) -> np.ndarray:
        data = np.frombuffer(word.encode(), dtype=np.uint8)
        return self.merge(data, np.array([0]), np.array([len(data)]))[0]

    @staticmethod
    def _fold(text: str) -> str:
        """Composed and lower-cased; the form of a letter never depends on its place in a word, so sigma has one."""
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def _cut(self, raw: str) -> list:
        """A run of letters that holds specials, as the pieces that are merged on their own and the ids of specials."""
        out: list = []
        for part in self.special.split(raw):
            if part in self.vocabulary.specials:
                out.append(self.vocabulary.specials[part])
            elif part:
                out.extend(self.pieces(self._fold(part)))
        return out

    def words(self, dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids) of different runs of letters between white space."""
        special = np.zeros(len(dictionary), dtype=bool)
        for name in self.vocabulary.specials:
            special |= pc.match_substring(dictionary, name).to_numpy(zero_copy_only=False)
        # The one letter whose lower case is a letter and a mark, and so two pieces, is no simple one.
        simple = pc.and_not(pc.utf8_is_alpha(dictionary), pc.match_substring(dictionary, "\u0130"))
        simple = simple.to_numpy(zero_copy_only=False)
        parts = []  # (word numbers, ids, number of ids of each)
        own = np.flatnonzero(simple & ~special)
        if len(own):  # letters only: one piece each
            data = np.frombuffer((self._fold(_joined(dictionary, own)) + "\n").encode(), dtype=np.uint8)
            ends = np.flatnonzero(data == ord("\n"))
            starts = np.append(0, ends[:-1] + 1)
            parts.append((own, *self.merge(data, starts, ends - starts)))
        own = np.flatnonzero(~simple & ~special)
        if len(own):
            pieces = pa.array(self.lines(self._fold(_joined(dictionary, own)) + "\n"), pa.string()).dictionary_encode()
            code, different = pieces.indices.to_numpy(), pieces.dictionary
            ends = code == pc.index(different, "\n").as_py()
            word, code = (np.cumsum(ends) - ends)[~ends], code[~ends]
            starts = different.buffers()[1]
            starts = np.frombuffer(starts, dtype=np.int32)[different.offset :][: len(different) + 1].astype(np.int64)
            data = np.frombuffer(different.buffers()[2], dtype=np.uint8)
            merged, lengths = self.merge(data, starts[:-1], np.diff(starts))
            ids = merged[ragged(starts_of(lengths)[code], lengths[code])]
            parts.append((own, ids, np.bincount(word, weights=lengths[code], minlength=len(own)).astype(np.int64)))
        for i in np.flatnonzero(special).tolist():
            cut = [[x] if isinstance(x, int) else self._merge_text(x) for x in self._cut(dictionary[i].as_py())]
            ids = np.concatenate(cut).astype(np.int32)
            parts.append((np.array([i]), ids, np.array([len(ids)])))
        counts = np.zeros(len(dictionary), dtype=np.int64)
        for own, _, sizes in parts:
            counts[own] = sizes
        at, out = starts_of(counts), np.empty(int(counts.sum()), dtype=np.int32)
        for own, ids, sizes in parts:
            out[ragged(at[own], sizes)] = ids
        return out, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids per text)."""
        codes, dictionary, counts = split_words(texts, lower=False)
        if not len(codes):
            return np.zeros(0, dtype=np.int32), counts
        ids, sizes = self.words(dictionary)
        lengths = sizes[codes]
        totals = np.diff(starts_of(lengths)[starts_of(counts)])
        return ids[ragged(starts_of(sizes)[codes], lengths)], totals


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text, as little-endian unsigned 32-bit integers in one binary value.

    Equal to ``encode(text, add_special_tokens=False).ids`` of the ``tokenizers`` library for the file at ``path``,
    which the driver reads. Strings of special tokens in a text become their ids. Null, empty and white texts have
    no ids. A column named like ``ids_col`` is replaced, all others are kept.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load(path))  # one tokenizer file
    made: list[Encoder] = []

    def run(texts: pa.Array):
        if not made:
            made.append(Encoder(sent.value))
        out = []
        for part in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], limit=SLICE_BYTES):
            ids, counts = made[0].encode(part.column(0))
            offsets = pa.py_buffer((starts_of(counts) * 4).astype(np.int32))
            out.append(pa.Array.from_buffers(pa.binary(), len(counts), [None, offsets, pa.py_buffer(ids.astype("<u4"))]))
        return [pa.concat_arrays(out)] if out else [pa.array([], pa.binary())]

    return append_columns(docs, run, f"`{ids_col}` binary", text_col)


def decode(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text that the library's ``decode(ids, skip_special_tokens=False)`` gives for ``ids_col``.

    The file names no decoder, so that is the tokens with single spaces between them. Null counts as no ids.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load(path).tokens)
    kept = [c for c in docs.columns if c != text_col]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    place = kept.index(ids_col)

    def run(batches):
        tokens = pa.array(sent.value)
        for part in slices(batches, ids_col, 4 * SLICE_BYTES):
            data = pc.fill_null(part.column(place), b"")
            ids = np.frombuffer(b"".join(data.to_pylist()), dtype="<u4").astype(np.int32)
            offsets = starts_of(pc.binary_length(data).to_numpy().astype(np.int64) // 4).astype(np.int32)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), tokens.take(pa.array(ids))), " ")
            yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*kept, text_col])

    schema = rows.withColumn(text_col, F.lit("")).schema
    return small_batches(rows).mapInArrow(run, schema)

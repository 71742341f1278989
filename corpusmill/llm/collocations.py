"""Collocations: phrases of two to five words that occur more often than their parts would by chance.

Every word position gives one window, the word and its next four, padded where the piece of text ends. Only these
longest windows are counted; Spark's ROLLUP over their columns then sums ever shorter prefixes, which gives the count of
every phrase, every word and the total at once. Before that, windows are cut where they can no longer begin a phrase
that is frequent enough: a first pass counts pairs of neighbouring words in hashed cells, a second one those triples whose
pairs may be frequent, and what is in a cell that stays below the limit is not frequent. Cells only ever count too much,
so nothing is lost; were all of them full, the windows would be whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import slices, small_batches, split_words
from corpusmill.operators import ranking
from corpusmill.session import keep

LONGEST = 5
WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]
KEYS = ["lang", *WORDS]
#: Rows of counts that a task holds, some 30 bytes each.
HELD = 1 << 20
#: Cells for phrases of one size: 2 MB as bits. More cells tell more phrases apart, the result is the same.
CELL_BITS = 24
CHUNK_BITS = 16
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SEPARATORS = ".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUTS = np.zeros(256, dtype=bool)
_CUTS[[ord(c) for c in SEPARATORS]] = True
_LOWER[_CUTS] = 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 32]] = True


def words_of(texts: pa.Array):
    """(codes, dictionary, row of each word, piece of each word) of texts, A to Z lower-cased."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets - offsets[0]
    plain = _LOWER[raw]
    lowered = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(starts.tobytes()), pa.py_buffer(plain)])
    codes, dictionary, counts = split_words(lowered, lower=False)
    row = np.repeat(np.arange(len(texts)), counts)
    letter = ~_BLANK[plain]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    begins = starts[:-1][starts[:-1] < starts[1:]]
    first[begins] = letter[begins]
    cuts = np.cumsum(_CUTS[raw])[np.flatnonzero(first)]
    piece = np.zeros(len(codes), dtype=np.int64)
    np.cumsum((cuts[1:] != cuts[:-1]) | (row[1:] != row[:-1]), out=piece[1:])
    return codes.astype(np.int64), dictionary, row, piece


class Slice:
    """Some megabytes of words: codes, dictionary, pieces, languages, and cells of the phrases that start at each word."""

    def __init__(self, part: pa.RecordBatch):
        self.codes, self.dictionary, row, self.piece = words_of(part.column("text"))
        named = part.column("lang").dictionary_encode()
        self.language = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        self.names = named.dictionary.to_pylist()
        tongue = np.array([xxhash.xxh64_intdigest(n) for n in self.names], dtype=np.uint64)
        hashed = np.array([xxhash.xxh64_intdigest(w) for w in self.dictionary.to_pylist()], dtype=np.uint64)
        self.hashed = hashed[self.codes] if len(self.codes) else np.zeros(0, dtype=np.uint64)
        self.fits: dict[int, np.ndarray] = {}
        self.mixed = [_mixed(self.hashed ^ tongue[self.language])] if len(self.codes) else [self.hashed]

    def cells(self, size: int) -> np.ndarray:
        """The cell of the phrase of ``size`` words at each place; places too near the end have none."""
        while len(self.mixed) < size:
            last, k = self.mixed[-1], len(self.mixed)
            self.mixed.append(_mixed(last[: len(self.hashed) - k] * MULTIPLIER + self.hashed[k:]))
        return (self.mixed[size - 1] >> np.uint64(64 - CELL_BITS)).astype(np.int64)

    def possible(self, size: int, bits: dict[int, np.ndarray]) -> np.ndarray:
        """Whether a phrase of ``size`` words starts here and may be frequent enough, by the cells that are known."""
        n = len(self.codes)
        if size in self.fits:
            return self.fits[size]
        if size == 1 or not n:
            fits = np.ones(n, dtype=bool)
        else:
            shorter = self.possible(size - 1, bits)
            fits = np.append(shorter[:-1] & shorter[1:] & (self.piece[1:] == self.piece[:-1]), False)
        if size in bits:
            cell = self.cells(size)
            fits[len(cell) :] = False
            fits[: len(cell)] &= ((bits[size][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).astype(bool)
        self.fits[size] = fits
        return fits


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sliced(batches):
    for part in slices(batches):
        yield Slice(part)


def possible_phrases(rows: DataFrame, least: int, sizes: list[int], bits: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """``bits`` and, for phrases of the given sizes, one bit per cell: whether all in it together occur ``least`` times.

    Only phrases whose parts are possible by ``bits`` are counted. A task sends its counts of the cells that it has
    seen, a part of the cells at a time; what a task that adds them up holds is bounded by the number of cells. The
    driver gets a bit per cell.
    """
    most = min(least, 65535)
    known = rows.sparkSession.sparkContext.broadcast(bits)  # a bit per cell, whatever the input

    def count(batches):
        seen = {size: np.zeros(1 << CELL_BITS, dtype=np.uint16) for size in sizes}
        for part in _sliced(batches):
            for size in sizes:
                cell, fits = part.cells(size), part.possible(size, known.value)
                at, n = np.unique(cell[fits[: len(cell)]], return_counts=True)
                seen[size][at] = np.minimum(seen[size][at] + n, most)
        wide = 1 << CHUNK_BITS
        for size, cells in seen.items():
            for chunk in range(len(cells) // wide):
                part = cells[chunk * wide : (chunk + 1) * wide]
                at = np.flatnonzero(part)
                if len(at):
                    columns = [pa.array([x], pa.int32()) for x in (size, chunk)]
                    columns += [pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.uint16), part[at])]
                    yield pa.RecordBatch.from_arrays(columns, names=["size", "chunk", "at", "n"])

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for size, chunk, at, n in zip(*(batch.column(c).to_pylist() for c in ("size", "chunk", "at", "n"))):
                cells = sums.setdefault((size, chunk), np.zeros(1 << CHUNK_BITS, dtype=np.int32))
                where = np.frombuffer(at, dtype=np.uint16)
                cells[where] = np.minimum(cells[where] + np.frombuffer(n, dtype=np.uint16), most)
        if sums:
            columns = [pa.array([key[k] for key in sums], pa.int32()) for k in (0, 1)]
            columns.append(pa.array([np.packbits(cells >= most).tobytes() for cells in sums.values()], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["size", "chunk", "bits"])

    counted = rows.mapInArrow(count, "size int, chunk int, at binary, n binary").repartition("size", "chunk")
    found = counted.mapInArrow(add, "size int, chunk int, bits binary").toArrow()
    out = dict(bits)
    for size in sizes:
        out[size] = np.zeros(1 << CELL_BITS - 3, dtype=np.uint8)
    wide = 1 << CHUNK_BITS - 3
    for size, chunk, part in zip(*(found.column(c).to_pylist() for c in ("size", "chunk", "bits"))):
        out[size][chunk * wide : (chunk + 1) * wide] = np.frombuffer(part, dtype=np.uint8)
    return out


class Counter:
    """Counts of windows over the slices of a task, put together before they leave it; bounded by its caller."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.names: dict[str, int] = {}
        self.tables: list[pa.Table] = []

    def add(self, part: Slice, bits: dict[int, np.ndarray]) -> None:
        n = len(part.codes)
        columns, inside = {"lang": part.language.astype(np.int32)}, np.ones(n, dtype=bool)
        for k in range(LONGEST):
            inside = inside & part.possible(k + 1, bits)
            column, ends = np.full(n, -1, dtype=np.int32), max(0, n - k)
            column[:ends] = np.where(inside[:ends], part.codes[k:], -1)
            columns[WORDS[k]] = column
        found = pa.table(columns).group_by(KEYS).aggregate([([], "count_all")])
        used = np.unique(np.concatenate([found[w].to_numpy() for w in WORDS]))
        used = used[used >= 0]
        own = np.full(len(part.dictionary) + 1, -1, dtype=np.int32)  # the last one stands for no word
        for code, word in zip(used.tolist(), part.dictionary.take(pa.array(used)).to_pylist()):
            own[code] = self.words.setdefault(word, len(self.words))
        tongue = np.array([self.names.setdefault(name, len(self.names)) for name in part.names], dtype=np.int32)
        coded = [tongue[found["lang"].to_numpy()], *[own[found[w].to_numpy()] for w in WORDS], found["count_all"].to_numpy()]
        self.tables.append(pa.table(dict(zip([*KEYS, "n"], coded))))

    def rows(self) -> int:
        return sum(t.num_rows for t in self.tables)

    def merge(self) -> None:
        summed = pa.concat_tables(self.tables).group_by(KEYS).aggregate([("n", "sum")])
        self.tables = [summed.rename_columns([*KEYS, "n"])]

    def batches(self) -> Iterator[pa.RecordBatch]:
        """All counts, with their words; nothing is held afterwards."""
        if self.tables:
            self.merge()
            words, names = pa.array(self.words, pa.string()), pa.array(self.names, pa.string())
            for batch in self.tables[0].to_batches(max_chunksize=20000):
                texts = [words.take(pc.if_else(pc.less(batch[w], 0), None, batch[w])) for w in WORDS]
                yield pa.RecordBatch.from_arrays([names.take(batch["lang"]), *texts, batch["n"]], names=[*KEYS, "n"])
        self.__init__()


def windows(rows: DataFrame, bits: dict[int, np.ndarray], most: int) -> DataFrame:
    """(lang, w1 to w5, n): the windows of all word positions, each cut to the longest phrase that may be frequent.

    A task puts together up to ``most`` different ones before it sends them.
    """
    sent = rows.sparkSession.sparkContext.broadcast(bits)  # 2 MB for each size of phrase, whatever the input

    def run(batches):
        held = Counter()
        for part in _sliced(batches):
            if len(part.codes):
                held.add(part, sent.value)
            if held.rows() > most:
                held.merge()
                if held.rows() > most // 2:
                    yield from held.batches()
        yield from held.batches()

    return rows.mapInArrow(run, f"lang string, {', '.join(f'{w} string' for w in WORDS)}, n bigint")


def phrase_counts(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, size, phrase, f): phrases of one to five words with ``least`` or more occurrences; size 0 has all words."""
    rows = small_batches(
        docs.select(
            F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
            F.col(f"`{text_col}`").cast("string").alias("text"),
        )
    )
    bits = possible_phrases(rows, least, [3], possible_phrases(rows, least, [2], {}))
    counted = windows(rows, bits, HELD).groupBy("lang", *WORDS).agg(F.sum("n").alias("n"))
    # grouping_id has a bit for every column that is summed over: 0 for whole windows, 31 for a language.
    rolled = counted.rollup("lang", *WORDS).agg(F.sum("n").alias("f"), F.grouping_id().alias("_g"))
    size = LONGEST - F.length(F.regexp_replace(F.bin("_g"), "0", ""))
    rolled = rolled.where(f"_g < {1 << LONGEST}").withColumn("size", size)
    padded = F.get(F.array(F.lit(""), *WORDS), F.col("size")).isNull()  # windows shorter than the prefix
    enough = (F.col("f") >= least) | (F.col("size") == 0)
    return rolled.where(~padded & enough).select("lang", "size", F.concat_ws(" ", *WORDS).alias("phrase"), "f")


def collocations(
    docs: DataFrame, least: int = 100, first: int = 2000, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` collocations of every language.

    A, the occurrences of a phrase, is at least ``least``; overlapping ones count. Of all cuts into two parts with l and
    r occurrences, that with the lowest score floor(1000 a n / (l r)) counts, then the earliest; n is the number of
    words of the language. A phrase inside a longer one that is as frequent is left out. Order: score and a descending,
    phrase ascending by bytes. Products are exact to 38 digits.

    Null languages are ``und``, null texts empty. Equal texts and repeated rows all count. Other columns are not read.
    An empty table, or one without a frequent phrase, gives no rows.
    """
    counts = keep(phrase_counts(docs, least, text_col, lang_col), "phrases")
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    longer = counts.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    def part(begin, length):
        return F.array_join(F.slice("w", begin, length), " ")

    cut = longer.select("lang", "size", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    known = counts.where("size > 0").select("lang", "phrase", "f")
    lefts = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    # One row per language; written, so that Spark knows how small that is.
    sized = cut.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).join(ranking.small_side(totals, None, "totals"), "lang")
    score = F.expr("(1000 * cast(a AS decimal(20)) * cast(n AS decimal(20))) div (cast(l AS decimal(19)) * cast(r AS decimal(19)))")
    best = sized.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.cast("bigint").alias("score"), "k", "l", "r")).alias("cut"))

    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda length: F.transform(F.sequence(F.lit(1), F.col("size") - length + 1), lambda at: part(at, length)),
        )
    )
    held = longer.where("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("outer"))
    held = held.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    left = best.join(held, ["lang", "phrase"], "left").where("outer IS NULL OR outer < a")
    flat = left.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    ranked = ranking.rank_rows(flat, [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], ["lang"])
    return ranked.where(F.col("rank") <= first).select("lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", "n", "score")

"""Texts to words inside tasks: Arrow columns in, NumPy arrays out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
#: Bytes and rows that Spark hands to a Python worker at once.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4000


def small_batches(df):
    """``df``, whose session from now on hands at most ``BATCH_BYTES`` at a time to Python.

    Rows of texts are large and batches are counted in rows by default: this is what bounds the memory of a worker.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        now = conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return df


def slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """The rows of Arrow batches in runs of at most ``limit`` bytes of text (a longer text is a run of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, used = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and used + size > limit:
                yield batch.slice(start, i - start)
                start, used = i, 0
            used += size
        yield batch.slice(start)


def split_words(texts: pa.Array, lower: bool = True):
    """Words between ASCII white space, as (codes, dictionary, words per row).

    ``dictionary`` holds the distinct words and ``codes`` one position in it per word, row after row. Nulls count
    as empty texts. ``lower`` lower-cases A to Z only.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    counts = np.diff(lists.offsets.to_numpy())
    encoded = lists.flatten().dictionary_encode()
    codes, dictionary = encoded.indices.to_numpy(), encoded.dictionary
    empty = pc.equal(pc.binary_length(dictionary), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # white space at either end of a text leaves an empty piece
        real = ~empty[codes]
        rows = np.repeat(np.arange(len(counts)), counts)[real]
        codes, counts = codes[real], np.bincount(rows, minlength=len(counts))
    return codes, dictionary, counts


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Offsets of consecutive runs of the given lengths, with the end of the last."""
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions of the runs [start, start + count), one after another."""
    counts = np.asarray(counts, dtype=np.int64)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - counts), counts)


def append_columns(df, function, added: str, text_col: str = "text"):
    """``df`` with the columns ``added`` (a schema), which ``function`` gives for an Arrow array of texts.

    Every row is kept, with all its columns. A column that has the name of an added one is replaced by it. Only the
    text goes to Python, and only the added columns come back.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(added).fieldNames()
    kept = [F.col(f"`{c}`") for c in df.columns if c not in names]

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            batch = pa.RecordBatch.from_arrays([texts], names=["text"])
            found = [pa.StructArray.from_arrays(function(part.column(0)), names=names) for part in slices([batch])]
            yield pa.concat_arrays(found) if found else pa.array([], pa.struct([(n, pa.null()) for n in names]))

    # Marked as not repeatable, or a filter on an added column would have the function run a second time.
    found = F.arrow_udf(run, StructType.fromDDL(added)).asNondeterministic()
    rows = small_batches(df).select(*kept, found(F.col(f"`{text_col}`").cast("string")).alias("__found"))
    return rows.select(*kept, "__found.*")


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))

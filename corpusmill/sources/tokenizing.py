"""A user's tokenizer over text columns: set up once per worker, fed by bytes, ids and lengths as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that the tokenizer gets at once; a longer text comes alone.
BYTES_AT_ONCE = 1 << 20

#: A list of texts to a list of token ids each.
Encode = Callable[[list[str]], Sequence[Sequence[int]]]


@lru_cache(maxsize=8)
def _loaded(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizer of the ``tokenizers`` library by the path of its file, which every worker has to reach.

    A worker loads it once, however many batches, tasks and queries use it.
    """

    path: str
    special_tokens: bool = False

    def __call__(self) -> Encode:
        tokenizer = _loaded(self.path)
        return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=self.special_tokens)]


def tokenized(text: Column, setup: Callable[[], Encode], max_length: int | None = None) -> Column:
    """Struct of ``ids`` and ``length``, the number of all tokens; null for null.

    ``setup`` is sent to the workers and called there once per task; it returns the function that encodes. ``ids`` is
    cut to ``max_length`` tokens if that is given, ``length`` is not.
    """

    def encoded(encode: Encode, texts: pa.Array) -> pa.Array:
        present = texts.is_valid()
        found = encode(texts.filter(present).to_pylist())
        sizes = np.zeros(len(texts), dtype=np.int64)
        sizes[present.to_numpy(zero_copy_only=False)] = [len(ids) for ids in found]
        kept = sizes if max_length is None else np.minimum(sizes, max_length)
        flat = np.concatenate([np.asarray(ids[:max_length], dtype=np.int32) for ids in found]) if found else np.zeros(0, np.int32)
        offsets = pa.array(np.append(0, np.cumsum(kept)).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(flat))
        lengths = pa.array(sizes.astype(np.int32))
        return pa.StructArray.from_arrays([lists, lengths], names=["ids", "length"], mask=pc.invert(present))

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = setup()
        for texts in arrays:
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            parts, start, used = [], 0, 0
            for i, size in enumerate([*sizes, BYTES_AT_ONCE + 1]):
                if i > start and used + size > BYTES_AT_ONCE:
                    parts.append(encoded(encode, texts.slice(start, i - start)))
                    start, used = i, 0
                used += size
            yield pa.concat_arrays(parts) if parts else encoded(encode, texts)

    return F.arrow_udf(run, "ids array<int>, length int").asNondeterministic()(text)


def token_ids(setup: Callable[[], Encode]) -> Callable[[Column], Column]:
    """A counter for the scorers and the length profile, which take a function from a text to an array."""
    return lambda text: tokenized(text, setup)["ids"]

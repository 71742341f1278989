"""N-gram language model by deleted interpolation, counted and looked up in one exchange.

The probability of a word is a mixture of maximum-likelihood estimates of all orders. The weight of an order depends
on how often its context occurs (in buckets of powers of two) and is learned by expectation-maximisation on part of
the training texts, against counts from which that part is deleted.

Texts are cut into chunks of words. A chunk sends each different n-gram once, with its count, to the bucket that its
hash falls into, order by order, and gets back the count in all training texts. A bucket so sees an n-gram once per chunk however
frequent it is, and the number of buckets grows with the number of words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import slices, small_batches, split_words, starts_of
from corpusmill.session import keep

#: Highest order, words per bucket of n-grams, bytes of text in a chunk, and one in so many training rows that the weights are learned on.
ORDER, WORDS_PER_BUCKET, CHUNK_BYTES, DELETED = 3, 1_500_000, 8 << 20, 20
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
MIX = np.uint64(0x9E3779B97F4A7C15)
STEPS_PER_OCTAVE = 4


@dataclass(frozen=True)
class Weights:
    """``by_order[n - 1][k]``: weight of order n after a context seen from 2 ** (k - 1) to 2 ** k - 1 times."""

    vocabulary: int
    tokens: int
    rows: int
    by_order: list[np.ndarray]


def _squeeze(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values), codec="zstd", asbytes=True)


def _expand(data: bytes, kind: str, count: int) -> np.ndarray:
    size = np.dtype(kind).itemsize * count
    return np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), dtype=kind) if count else np.zeros(0, kind)


def _squeeze_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte: the high bytes of many small differences take no room."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return _squeeze(steps.view(np.uint8).reshape(-1, 8).T)


def _expand_keys(data: bytes, count: int) -> np.ndarray:
    planes = _expand(data, "uint8", 8 * count).reshape(8, count)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _squeeze_counts(counts: np.ndarray) -> bytes:
    """Counts, nearly all of them small: one byte each, and those from 255 on behind, in order."""
    large = counts[counts >= 255].astype(np.int64)
    small = np.minimum(counts, 255).astype(np.uint8)
    return _squeeze(np.concatenate([small, large.view(np.uint8)]))


def _expand_counts(data: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, dtype=np.int64)
    whole = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    out = whole[:count].astype(np.int64)
    out[out == 255] = np.frombuffer(whole[count:].tobytes(), dtype=np.int64)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def chunks(docs: DataFrame, id_col: str, text_col: str, learn: Column) -> DataFrame:
    """One row per chunk of texts: ids, what each text is for, and its words as hashes and codes."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.coalesce(learn, F.lit(False)).alias("learn"),
    )
    place = F.pmod(F.xxhash64(F.lit(17), F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(DELETED))
    rows = rows.withColumn("tune", F.col("learn") & (place == 0))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for part in slices(batches, limit=CHUNK_BYTES):
            codes, dictionary, counts = split_words(part.column("text"))
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in dictionary.cast(pa.binary()).to_pylist()], dtype=np.uint64)
            tune = part.column("tune").to_numpy(zero_copy_only=False)
            for which in (False, True):
                own = tune == which
                if not own.any():
                    continue
                used, local = np.unique(codes[np.repeat(own, counts)], return_inverse=True)
                chosen = part.filter(pa.array(own))
                learned = chosen.column("learn").to_numpy(zero_copy_only=False).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([which]),
                        pa.array([int((counts[own] + 1)[learned].sum())]),
                        pa.array([int(learned.sum())]),
                        pa.array([int(counts[own].sum() + own.sum())]),
                        pa.ListArray.from_arrays(pa.array([0, len(chosen)], pa.int32()), chosen.column("id")),
                        pa.array([_squeeze(learned.astype(np.uint8))]),
                        pa.array([_squeeze(counts[own].astype(np.int64))]),
                        pa.array([len(used)]),
                        pa.array([hashes[used].tobytes()]),
                        pa.array([_squeeze(local.astype(np.int32).view(np.uint8).reshape(-1, 4).T)]),
                    ],
                    names=["tune", "learned", "rows", "tokens", "ids", "learn", "counts", "n_words", "words", "codes"],
                )

    out = small_batches(rows).mapInArrow(
        run,
        f"tune boolean, learned bigint, rows bigint, tokens bigint, ids array<{kind}>, learn binary, counts binary, n_words bigint,"
        " words binary, codes binary",
    )
    return out.withColumn("chunk", F.monotonically_increasing_id())


@dataclass
class Chunk:
    """The n-grams of a chunk: ``distinct[n - 1]`` the sorted keys of order n, ``at[n - 1]`` which of them is at each place."""

    counts: np.ndarray
    learn: np.ndarray
    starts: np.ndarray
    distinct: list[np.ndarray]
    at: list[np.ndarray]


def open_chunk(row: dict, order: int) -> Chunk:
    n = len(row["ids"])
    words = np.frombuffer(row["words"], dtype=np.uint64)
    counts = _expand(row["counts"], "int64", n)
    planes = _expand(row["codes"], "uint8", 4 * int(counts.sum())).reshape(4, -1)
    codes = np.ascontiguousarray(planes.T).view(np.int32).ravel()
    learn = _expand(row["learn"], "uint8", n).astype(bool)
    starts = starts_of(counts + 1)
    word = np.full(int(starts[-1]), END, dtype=np.uint64)
    inner = np.ones(len(word), dtype=bool)
    inner[starts[1:] - 1] = False
    word[inner] = words[codes]
    distinct, at, context, before = [], [], np.full(len(word), 1, dtype=np.uint64), word
    for k in range(1, order + 1):
        # Longer n-grams have twelve bits less, which take no room in the differences. One order after the other: the
        # sort of all orders at once takes three times the memory.
        keys = _mixed(context * MIX + word)
        if k > 1:
            keys &= ~np.uint64(0xFFF)
        own, place = np.unique(keys, return_inverse=True)
        distinct.append(own)
        at.append(place.astype(np.int32))
        shifted = np.roll(before, 1)
        shifted[starts[:-1]] = BEGIN
        before = shifted
        context = _mixed(context * np.uint64(0xD1342543DE82EF95) + before)
    return Chunk(counts, learn, starts, distinct, at)


def bucket_bounds(distinct: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, their first positions) of sorted keys; a bucket is a range of keys."""
    bucket = ((distinct >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 63)))
    return bucket[first].astype(np.int64), first


def _ask(kept: DataFrame, buckets: int, order: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                c = open_chunk(row, order)
                learning = np.repeat(c.learn, c.counts + 1)
                for k, (distinct, at) in enumerate(zip(c.distinct, c.at), 1):
                    seen = np.bincount(at[learning], minlength=len(distinct))
                    names, first = bucket_bounds(distinct, buckets)
                    ends = [*first[1:].tolist(), len(distinct)]
                    n = len(names)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names),
                            pa.array([k] * n, pa.int32()),
                            pa.array([row["chunk"]] * n, pa.int64()),
                            pa.array([row["tune"]] * n, pa.bool_()),
                            pa.array([b - a for a, b in zip(first.tolist(), ends)], pa.int64()),
                            pa.array([_squeeze_keys(distinct[a:b]) for a, b in zip(first, ends)], pa.binary()),
                            pa.array([_squeeze_counts(seen[a:b]) for a, b in zip(first, ends)], pa.binary()),
                        ],
                        names=["bucket", "order", "chunk", "tune", "n", "grams", "seen"],
                    )

    return kept.mapInArrow(run, "bucket bigint, order int, chunk bigint, tune boolean, n bigint, grams binary, seen binary")


def _answer(asked: DataFrame) -> DataFrame:
    """Per chunk and bucket the counts of its n-grams in all training rows and, for tuning, in those that are left."""

    def run(table: pa.Table) -> pa.Table:
        sizes, tune = table.column("n").to_numpy(), table.column("tune").to_numpy()
        grams = np.concatenate([_expand_keys(b.as_py(), n) for b, n in zip(table.column("grams"), sizes.tolist())])
        seen = np.concatenate([_expand_counts(b.as_py(), n) for b, n in zip(table.column("seen"), sizes.tolist())])
        order = np.argsort(grams, kind="stable")
        first = np.diff(grams[order], prepend=~grams[order[:1]]) != 0
        group = np.cumsum(first) - 1
        place = np.empty(len(grams), dtype=np.int64)
        place[order] = group
        total = np.bincount(group, weights=seen[order]).astype(np.int64)
        deleted = np.where(np.repeat(tune, sizes), seen, 0)
        left = total - np.bincount(group, weights=deleted[order]).astype(np.int64)
        single = table.column("order")[0].as_py() == 1
        words = [int((total > 0).sum()) if single else 0] + [0] * (len(sizes) - 1)
        cut = np.cumsum(sizes)[:-1]
        own = np.split(place, cut)
        return pa.table(
            {
                "bucket": table.column("bucket"),
                "order": table.column("order"),
                "chunk": table.column("chunk"),
                "tune": table.column("tune"),
                "n": table.column("n"),
                "words": pa.array(words, pa.int64()),
                "total": pa.array([_squeeze_counts(total[p]) for p in own], pa.binary()),
                "left": pa.array([_squeeze_counts(left[p]) if t else b"" for p, t in zip(own, tune)], pa.binary()),
            }
        )

    schema = "bucket bigint, order int, chunk bigint, tune boolean, n bigint, words bigint, total binary, left binary"
    return asked.groupBy("bucket", "order").applyInArrow(run, schema)


def _counted(left: pa.Table, right: pa.Table, order: int, column: str) -> tuple[dict, Chunk, list[np.ndarray]]:
    """A chunk with the counts of its n-grams at each place, from the answers of all buckets."""
    pa.default_memory_pool().release_unused()  # what is left of the chunk before
    row = left.to_pylist()[0]
    chunk = open_chunk(row, order)
    columns = (right.column(name).to_pylist() for name in ("order", "bucket", "n", column))
    answers: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(order)]
    for k, _, n, data in sorted(zip(*columns)):
        answers[k - 1].append(_expand_counts(data, n))
    return row, chunk, [np.concatenate(found)[at] for found, at in zip(answers, chunk.at)]


def probabilities(counts: list[np.ndarray], starts: np.ndarray, weights: Weights, upto: int):
    """(estimate, contexts) of order ``upto`` and the mixture of all lower ones, at each place."""
    mixture = np.full(len(counts[0]), 1.0 / (weights.vocabulary + 1))
    for n in range(1, upto + 1):
        if n == 1:
            context = np.full(len(mixture), weights.tokens, dtype=np.int64)
        else:
            context = np.roll(counts[n - 2], 1)
            context[starts[:-1]] = weights.rows
        likeliest = counts[n - 1] / np.maximum(context, 1)
        if n == upto:
            return mixture, likeliest, context
        share = np.where(context > 0, weights.by_order[n - 1][_bucket(context)], 0.0)
        mixture = share * likeliest + (1 - share) * mixture


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.frexp(context.astype(np.float64))[1].clip(0, 63)


def learn_weights(cells: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Expectation-maximisation: ``cells`` are rows (bucket, estimate, mixture of lower orders, how often).

    A bucket without cells has the weight of the next lower one that has some, the lowest ones one half.
    """
    out = np.full(64, np.nan)
    for k in np.unique(cells[:, 0]).astype(int).tolist():
        _, own, lower, times = cells[cells[:, 0] == k].T
        share = 0.5
        for _ in range(rounds):
            share = float((times * share * own / (share * own + (1 - share) * lower)).sum() / times.sum())
            share = min(max(share, 1e-6), 1 - 1e-6)
        out[k] = share
    last = 0.5
    for k in range(64):
        last = out[k] = last if np.isnan(out[k]) else out[k]
    return out


def _fit(tuned: DataFrame, vocabulary: int, tokens: int, rows: int, order: int) -> Weights:
    """One pass over the counts at the tuning places for each order, each with the weights of the lower ones."""
    weights = Weights(vocabulary, tokens, rows, [])
    for n in range(1, order + 1):
        known = Weights(vocabulary, tokens, rows, list(weights.by_order))

        def run(batches, n=n, known=known):
            for batch in batches:
                for row in batch.to_pylist():
                    starts = np.frombuffer(row["starts"], dtype=np.int64)
                    counts = [_expand_counts(b, int(starts[-1])) for b in row["counts"]]
                    lower, own, context = probabilities(counts, starts, known, n)
                    with np.errstate(divide="ignore"):
                        steps = [np.round(np.log2(x) * STEPS_PER_OCTAVE) for x in (own, lower)]
                    steps = [np.where(np.isfinite(s), s, -9999).astype(np.int64) for s in steps]
                    some = context > 0
                    cells, times = np.unique(
                        np.stack([_bucket(context), *steps], axis=1)[some].astype(np.int64), axis=0, return_counts=True
                    )
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells[:, 0]), pa.array(cells[:, 1]), pa.array(cells[:, 2]), pa.array(times)],
                        names=["k", "own", "lower", "n"],
                    )

        cells = tuned.mapInArrow(run, "k bigint, own bigint, lower bigint, n bigint")
        # Bounded by 64 buckets and four steps per octave of either probability.
        cells = cells.groupBy("k", "own", "lower").agg(F.sum("n").alias("n")).orderBy("k", "own", "lower").collect()
        table = np.array([tuple(r) for r in cells], dtype=float).reshape(-1, 4)
        for c in (1, 2):
            table[:, c] = np.where(table[:, c] == -9999, 0.0, 2.0 ** (table[:, c] / STEPS_PER_OCTAVE))
        weights.by_order.append(learn_weights(table))
    return weights


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Score every whole text by the model that the rows where ``learn`` holds give.

    Returns (id, ``learned``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``), one row per row.
    Words are cut at ASCII white space, with A to Z lower-cased; every text ends with one more token. ``n_known``
    tokens occur in training texts. ``base_score`` is the log10 probability under add-one-half counts of single
    tokens, ``score`` that of the model, in which unknown tokens share one place beside the vocabulary.

    Null texts are empty, a null id or ``learn`` is no reason to leave a row out (it is not learned from if null);
    repeated rows count each time. Without training rows every token has probability 1. Words are told apart by
    64-bit hashes, longer n-grams by 52-bit ones (of 1e13 different ones 0.2 % share theirs). Tables that cut lineage: the chunks of words, the answers of the buckets, the counts tuned on.
    """
    kept = keep(chunks(docs, id_col, text_col, learn), "chunks")
    only = F.when(F.col("tune"), 1).otherwise(0)
    sums = [F.sum("tokens"), F.sum("learned"), F.sum(F.col("learned") * only), F.sum("rows"), F.sum(F.col("rows") * only)]
    every, tokens, tokens_cut, rows, rows_cut = (int(x or 0) for x in kept.agg(*sums).first())
    buckets = max(1, -(-every // WORDS_PER_BUCKET))
    answered = keep(_answer(_ask(kept, buckets, order)), "ngram-counts")
    vocabulary = int(answered.agg(F.sum("words")).first()[0] or 0)

    def counts_left(left: pa.Table, right: pa.Table) -> pa.Table:
        _, chunk, counts = _counted(left, right, order, "left")
        return pa.table(
            {
                "starts": pa.array([chunk.starts.tobytes()], pa.binary()),
                "counts": pa.array([[_squeeze_counts(c) for c in counts]], pa.list_(pa.binary())),
            }
        )

    tuned = (
        kept.where("tune").groupBy("chunk").cogroup(answered.where("tune").groupBy("chunk"))
        .applyInArrow(counts_left, "starts binary, counts array<binary>")
    )
    fitted = _fit(keep(tuned, "tuning"), vocabulary, tokens - tokens_cut, rows - rows_cut, order)
    final = Weights(vocabulary, tokens, rows, fitted.by_order)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        _, chunk, counts = _counted(left, right, order, "total")
        lower, own, context = probabilities(counts, chunk.starts, final, order)
        share = np.where(context > 0, final.by_order[-1][_bucket(context)], 0.0)
        text = np.repeat(np.arange(len(chunk.counts)), chunk.counts + 1)

        def per_text(values) -> np.ndarray:
            return np.bincount(text, weights=values, minlength=len(chunk.counts))

        base = np.log10((counts[0] + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
        return pa.table(
            {
                "id": left.column("ids").chunk(0).flatten(),
                "learned": pa.array(chunk.learn),
                "n_tokens": pa.array(chunk.counts + 1),
                "n_known": pa.array(per_text(counts[0] > 0).astype(np.int64)),
                "base_score": pa.array(per_text(base)),
                "score": pa.array(per_text(np.log10(share * own + (1 - share) * lower))),
            }
        )

    scored = (
        kept.groupBy("chunk").cogroup(answered.groupBy("chunk"))
        .applyInArrow(total, f"id {kind}, learned boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    )
    return scored.select(
        F.col("id").alias(id_col), "learned", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )

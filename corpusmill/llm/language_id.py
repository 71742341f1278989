"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.words import append_columns, slices, small_batches, split_words, starts_of

#: Rows per language that the model is fitted on (all of a language with fewer), its hash buckets, dimensions,
#: subword lengths in bytes, and the share of calibration rows that may be rejected.
ROWS_PER_LANGUAGE, BUCKETS, DIMENSIONS, LENGTHS, REJECTED = 600, 1 << 15, 12, (2, 3, 4), 0.001
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    """``weights`` are the embeddings already multiplied by the softmax layer (buckets x languages)."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def subwords(dictionary: pa.Array, lengths=LENGTHS, buckets: int = BUCKETS):
    """For each subword length (word numbers, buckets): the byte n-grams of every word between ``<`` and ``>``."""
    sizes = pc.binary_length(dictionary).to_numpy().astype(np.int64) + 2
    starts = starts_of(sizes)
    data = np.empty(int(starts[-1]), dtype=np.uint64)
    data[starts[:-1]], data[starts[1:] - 1] = ord("<"), ord(">")
    raw = np.frombuffer(b"".join(dictionary.cast(pa.binary()).to_pylist()), dtype=np.uint8)
    inner = np.ones(len(data), dtype=bool)
    inner[starts[:-1]] = inner[starts[1:] - 1] = False
    data[inner] = raw
    word = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    for n in lengths:
        if len(data) < n:
            continue
        mixed = np.full(len(data) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            mixed = (mixed ^ data[k : len(data) - n + 1 + k]) * np.uint64(0x100000001B3)
        whole = word[: len(mixed)] == word[n - 1 :]
        mixed = mixed[whole]
        mixed ^= mixed >> np.uint64(29)
        yield word[: len(whole)][whole], ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets


def _bags(rows: DataFrame):
    """(lang, buckets, shares) of every text: its distinct buckets and their share of all its subwords."""

    def run(batches):
        for part in slices(batches):
            codes, dictionary, counts = split_words(part.column("text"))
            pieces = list(subwords(dictionary))
            word = np.concatenate([w for w, _ in pieces]) if pieces else np.zeros(0, np.int64)
            bucket = np.concatenate([b for _, b in pieces]) if pieces else np.zeros(0, np.int64)
            order = np.argsort(word, kind="stable")
            bucket, begin = bucket[order], np.searchsorted(word[order], np.arange(len(dictionary) + 1))
            at, ids, shares = starts_of(counts), [], []
            for i in range(len(counts)):
                own, times = np.unique(codes[at[i] : at[i + 1]], return_counts=True)
                total = np.zeros(BUCKETS)
                for w, n in zip(own.tolist(), times.tolist()):
                    np.add.at(total, bucket[begin[w] : begin[w + 1]], n)
                found = np.flatnonzero(total)
                ids.append(found.astype(np.int32))
                shares.append((total[found] / max(1.0, total.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [part.column("lang"), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
                names=["lang", "buckets", "shares"],
            )

    return small_batches(rows).mapInArrow(run, "lang string, buckets array<int>, shares array<float>")


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
    epochs: int = 12,
    seed: int = 5,
) -> LanguageModel:
    """Fit the model on whole texts of a bounded sample of ``docs``: those of each language with the smallest id hashes.

    Rows with a null language, id or text are not used; an id counts once, with the smallest of its languages and the
    smallest text in it. One fifth of the sample calibrates: the temperature that
    makes its probabilities likeliest, and the threshold below which at most ``REJECTED`` of it lies (0.5 at most).
    A table without usable rows gives a model without languages, which answers ``und``.
    """
    known = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    ).where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    chosen = known.groupBy("id").agg(F.min("lang").alias("lang")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows_per_language)
    texts = known.join(F.broadcast(chosen.select("id", "lang")), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))
    bags = _bags(texts.select("lang", "text")).toArrow().to_pandas()
    bags = bags[bags["buckets"].map(len) > 0]
    languages = sorted(set(bags["lang"]))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.5)
    target = bags["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    # The order in which Spark returns rows does not matter: they are sorted by their contents.
    keys = [(int(t), len(b), float(b.sum()), float(s.max())) for t, b, s in zip(target, bags["buckets"], bags["shares"])]
    by = sorted(range(len(keys)), key=keys.__getitem__)
    random = np.random.default_rng(seed)
    by = np.array(by)[random.permutation(len(by))]
    held, fit = by[::5], by[np.arange(len(by)) % 5 > 0]
    fit = fit if len(fit) else held
    ids, shares = bags["buckets"].to_numpy(), bags["shares"].to_numpy()

    def dense(rows) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), dtype=np.float32)
        for k, r in enumerate(rows):
            out[k, ids[r]] = shares[r]
        return out

    weight = 1.0 / np.bincount(target[fit], minlength=len(languages)).clip(1)
    embedding = (random.standard_normal((BUCKETS, DIMENSIONS)) * 0.1).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, len(languages)), dtype=np.float32), np.zeros(len(languages), dtype=np.float32)
    step, steps, size = 0, max(1, epochs * -(-len(fit) // 32)), 32
    while step < steps:
        random.shuffle(fit)
        for at in range(0, len(fit), size):
            rows = fit[at : at + size]
            rate = 1.0 - step / steps
            x, own = dense(rows), weight[target[rows]]
            hidden = x @ embedding
            p = _softmax(hidden @ layer + bias)
            p[np.arange(len(rows)), target[rows]] -= 1
            p *= (own / own.sum())[:, None]
            back = p @ layer.T
            layer -= (4.0 * rate * hidden.T @ p).astype(np.float32)
            bias -= (0.5 * rate * p.sum(axis=0)).astype(np.float32)
            embedding -= (60.0 * rate * x.T @ back).astype(np.float32)
            step += 1
    logits = np.concatenate([dense(held[i : i + 64]) @ (embedding @ layer) + bias for i in range(0, len(held), 64)])
    temperature = min(
        np.geomspace(0.1, 10, 41),
        key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(held)), target[held]].clip(1e-12)).mean(),
    )
    best = _softmax(logits / temperature).max(axis=1)
    threshold = min(0.5, float(np.quantile(best, REJECTED, method="lower")))
    return LanguageModel(languages, (embedding @ layer).astype(np.float32), bias.astype(np.float64), float(temperature), threshold)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def classify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (its calibrated probability) and ``accepted``.

    The whole text counts. Texts that are null or have no letter get ``und`` with score 0 and are rejected, as are
    those whose score is below the model's threshold (they keep the likeliest language). Equal texts get equal
    answers; columns of the same names are replaced, all others kept.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, a size fixed by the parameters

    def run(texts: pa.Array):
        model = sent.value
        letters = pc.match_substring_regex(texts, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
        if not model.languages:
            letters = np.zeros(len(texts), dtype=bool)
        codes, dictionary, counts = split_words(texts)
        sums = np.zeros((len(dictionary), len(model.languages)))
        parts = np.zeros(len(dictionary), dtype=np.int64)
        for word, bucket in subwords(dictionary):
            parts += np.bincount(word, minlength=len(dictionary))
            for k in range(len(model.languages)):
                sums[:, k] += np.bincount(word, weights=model.weights[bucket, k], minlength=len(dictionary))
        row = np.repeat(np.arange(len(counts)), counts)
        total = np.bincount(row, weights=parts[codes], minlength=len(counts)).clip(1)
        logits = np.empty((len(counts), len(model.languages)))
        for k in range(len(model.languages)):
            logits[:, k] = np.bincount(row, weights=sums[codes, k], minlength=len(counts)) / total + model.bias[k]
        if not model.languages:
            return [pa.array([UNDETERMINED] * len(texts)), pa.array(np.zeros(len(texts))), pa.array(letters)]
        p = _softmax(logits / model.temperature)
        best = p.argmax(axis=1)
        score = np.where(letters, p[np.arange(len(p)), best], 0.0)
        names = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters.tolist())]
        return [pa.array(names), pa.array(score), pa.array(letters & (score >= model.threshold))]

    return append_columns(docs, run, "lang_pred string, score double, accepted boolean", text_col)

"""Overlap metrics against brute force in plain Python."""

import math
import random
import re
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import stemming
from corpusmill.functions import text as tx
from corpusmill.operators import compression, corpus, overlap

draw = random.Random(11)
VOCAB = ["red", "green", "blue", "the", "a", "sky", "is", "7"]
PAIRS = [
    (i, " ".join(draw.choices(VOCAB, k=draw.randint(0, 25))), " ".join(draw.choices(VOCAB, k=draw.randint(0, 20))))
    for i in range(60)
] + [(60, "same words here", "same words here"), (61, "!!!", "???"), (62, "Æ red", "red.")]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "id int, prediction string, reference string")


def grams(words, n):
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def f1(m, p, r):
    precision, recall = m / p if p else 0.0, m / r if r else 0.0
    return 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


INFLECTED = [
    (100, "He was hoping for better tied ponies", "Hopes of the best ties and a pony"),
    (101, "generalizations relate", "general relational"),
    (102, None, "something"),
    (103, "skies were dying", "the sky dies"),
    (104, "ran RAN running runs", "runner run Running"),
]


@pytest.mark.parametrize("stem", [False, True])
def test_rouge(spark, stem):
    rows = PAIRS + INFLECTED
    pairs = spark.createDataFrame(rows, "id int, prediction string, reference string")
    got = {r.id: r for r in overlap.rouge(pairs, "id", stem=stem).collect()}
    scored = [p for p in rows if p[2] != ""]
    assert set(got) == {p[0] for p in scored}
    for i, pred, ref in scored:
        a, b = (re.findall("[a-z0-9]+", (t or "").lower()) for t in (pred, ref))
        if stem:
            a, b = ([stemming.stem(w) if len(w) > 3 else w for w in t] for t in (a, b))
        for n in (1, 2):
            x, y = grams(a, n), grams(b, n)
            expected = f1(sum((x & y).values()), sum(x.values()), sum(y.values()))
            assert got[i][f"rouge{n}"] == pytest.approx(expected)
        assert got[i].rougeL == pytest.approx(f1(lcs(a, b), len(a), len(b)))
    assert (got[103].rouge1 > 0.6) == stem
    assert [r.id for r in overlap.rouge_n(pairs, "id", stem=stem).orderBy("id").collect()] == sorted(got)
    assert overlap.rouge_l(pairs.limit(0), "id").count() == 0


def test_long_texts_are_compared_in_full_and_fast(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [[rng.choice(vocabulary[: rng.choice([40, 400, 3000])]) for _ in range(2000)] for _ in range(40)]
    rows = [(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(zip(texts, texts[1:]))]
    pairs = spark.createDataFrame(rows, "id int, prediction string, reference string")
    got = {r.id: r.rougeL for r in overlap.rouge_l(pairs, "id", stem=False).collect()}
    start = time.perf_counter()
    plain = lcs(texts[0], texts[1])
    table = time.perf_counter() - start
    start = time.perf_counter()
    for a, b in zip(texts, texts[1:]):
        overlap.lcs_length(a, b)
    assert (time.perf_counter() - start) / len(rows) < table / 10
    assert got[0] == pytest.approx(f1(plain, 2000, 2000))
    assert all(got[i] == pytest.approx(overlap.lcs_length(a, b) / 2000) for i, (a, b) in enumerate(zip(texts, texts[1:])))


def test_batches_are_cut_by_tokens(monkeypatch):
    rng = random.Random(5)
    left, right = ([[rng.choice(VOCAB) for _ in range(rng.randrange(0, 9))] for _ in range(50)] for _ in range(2))
    found = overlap.count_overlap(pa.array(left, pa.list_(pa.string())), pa.array([*right[:-1], None], pa.list_(pa.string())), 4, False, True)
    for i, (a, b) in enumerate(zip(left, [*right[:-1], []])):
        expected = []
        for n in range(1, 5):
            x, y = grams(a, n), grams(b, n)
            expected += [sum((x & y).values()), sum(x.values()), sum(y.values())]
        assert [c[i] for c in found] == [*expected, lcs(a, b)]


STEMS = """caresses:caress ponies:poni ties:tie died:die cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor
 sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file
 happy:happi sky:sky skies:sky dying:die news:news enjoy:enjoy relational:relat conditional:condit rational:ration digitizer:digit
 differentli:differ analogousli:analog operator:oper feudalism:feudal decisiveness:decis hopefulness:hope sensitiviti:sensit
 triplicate:triplic formative:form formalize:formal electrical:electr goodness:good revival:reviv allowance:allow airliner:airlin
 adjustable:adjust irritant:irrit replacement:replac adoption:adopt communism:commun angulariti:angular effective:effect
 bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll is:is a:a by:by theologically:theolog owed:owe
 spied:spi generally:gener proceed:proceed innings:inning 1990s:1990 x:x yyyy:yyyi"""


def test_stems(spark):
    listed = dict(pair.split(":") for pair in STEMS.split())
    assert {w: stemming.stem(w) for w in listed} == listed
    rows = spark.createDataFrame([(list(listed),), ([],), (None,)], "words array<string>")
    found = [r[0] for r in rows.select(stemming.stemmed(F.col("words"))).collect()]
    assert found[1:] == [[], None]
    assert found[0] == [s if len(w) > 3 else w for w, s in listed.items()]


def bleu(pairs, tokenise):
    match, total = [0] * 4, [0] * 4
    size = refs = 0
    for pred, references in pairs:
        a, bs = tokenise(pred), [tokenise(r) for r in references]
        size += len(a)
        refs += min(len(b) for b in bs)
        for n in range(1, 5):
            best = Counter()
            for b in bs:
                best |= grams(b, n)
            x = grams(a, n)
            match[n - 1] += sum((x & best).values())
            total[n - 1] += sum(x.values())
    p = [m / t if t else 0.0 for m, t in zip(match, total)]
    if min(p) == 0:
        return 0.0
    penalty = 1.0 if size > refs else math.exp(1 - refs / size)
    return penalty * math.exp(sum(map(math.log, p)) / 4)


def test_corpus_bleu(pairs):
    row = overlap.corpus_bleu(pairs, "id").first()
    expected = bleu([(p, [r]) for _, p, r in PAIRS], lambda t: re.findall(r"\w+|[^\w\s]", t))
    assert row.bleu == pytest.approx(expected)


@pytest.mark.parametrize("n", [11, 12, 40, 70])
def test_self_bleu(spark, n):
    texts = [(i, " ".join(draw.choices(VOCAB, k=30))) for i in range(n)]
    df = spark.createDataFrame(texts, "id bigint, text string")
    order = [r.id for r in df.orderBy(tx.seeded_key(42, F.col("id")), "id").collect()]
    sample = [dict(texts)[i] for i in order]
    expected = [
        bleu([(t, [o for j, o in enumerate(sample) if j != i][:10])], str.split) for i, t in enumerate(sample[:50])
    ]
    got = [r.bleu for r in overlap.self_bleu_scores(df, "id").orderBy("place").collect()]
    assert got == pytest.approx(expected)
    assert overlap.self_bleu(df, "id").first()[0] == pytest.approx(1 - sum(expected) / len(expected))


def test_self_bleu_needs_more_than_ten(spark):
    df = spark.createDataFrame([(i, "a b c d e") for i in range(10)], "id bigint, text string")
    assert overlap.self_bleu(df, "id").first()[0] is None


def test_report_columns(pairs):
    row = overlap.generation_quality(pairs, "id").first()
    assert 0 < row.rouge2 < row.rouge1 <= 1 and row.rougeL <= row.rouge1 + 1e-9
    assert row.bleu > 0 and row.avg_length_ratio > 0 and row.self_bleu is not None


def test_distinct_n_of_short_texts(spark):
    df = spark.createDataFrame([("a b",), ("A",), ("",)], "text string")
    got = {r.n: (r.total, r.distinct) for r in corpus.distinct_ngrams(df).collect()}
    assert got == {1: (3, 2), 2: (1, 1)}


def test_sketch_is_close(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    exact = {r.n: r.ratio for r in corpus.distinct_ngrams(docs).collect()}
    sketch = {r.n: r.ratio for r in corpus.distinct_ngrams(docs, approximate=True).collect()}
    assert all(sketch[n] == pytest.approx(exact[n], rel=0.05) for n in exact)


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "text string")
    row = corpus.vocabulary(empty).first()
    assert (row.tokens, row.vocab_diversity, row.entropy) == (0, None, None)
    assert list(corpus.quality_proxies(empty).first()) == [0.0] * 4


def test_compression(spark):
    df = spark.createDataFrame([(0, "ab" * 500), (1, ""), (2, None)], "id int, text string")
    got = {r.id: r.ratio for r in compression.compression_ratio(df, "id").collect()}
    assert got[0] < 0.05 and got[1] is None and got[2] is None

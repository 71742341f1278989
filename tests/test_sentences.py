"""Learned sentence ends: what is learned from a small corpus, hand-cut texts, and agreement with SQL."""

import random

import check
import pytest
from pyspark.sql import functions as F

from corpusmill.catalog import base as b
from corpusmill.functions import text as tx
from corpusmill.operators import corpus, quality, sentences

NAMES = ["Smith", "Jones", "Miller", "Brown", "Green", "Adams"]
VERBS = ["met", "saw", "called", "thanked", "paid", "heard"]
THINGS = ["apples", "pears", "plums", "lemons", "grapes", "melons", "figs", "dates"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(3, 9)):
            title, name, verb, thing = rng.choice(["Dr.", "Mr.", "Prof."]), rng.choice(NAMES), rng.choice(VERBS), rng.choice(THINGS)
            parts.append(
                rng.choice(
                    [
                        f"The {name} family {verb} {title} {rng.choice(NAMES)} about {thing}.",
                        f"{title} {name} {verb} the {rng.choice(NAMES)} sisters, e.g. for {rng.randrange(9)}.{rng.randrange(9)} kg of {thing}!",
                        f"However, we {verb} {title} {name} and ate {thing}, pears etc. in {rng.randrange(1900, 2000)}.",
                        f"Was it {title} {name} who {verb} them?",
                    ]
                )
            )
        out.append(rng.choice([" ", "\n", "  "]).join(parts))
    return out


@pytest.fixture(scope="module")
def ends(spark, texts):
    rows = spark.createDataFrame([(t,) for t in [*texts, "", None]], "text string")
    return sentences.learn(rows)


def test_what_is_learned(ends):
    assert {"dr", "mr", "prof", "e.g", "etc"} <= set(ends.abbreviations)
    assert not set(ends.abbreviations) & {t for t in THINGS} and "them" not in ends.abbreviations
    assert {"the", "however"} <= set(ends.starters)


CUT = [
    "Dr. Smith met Prof. Miller.| The end!| Really?| Yes.",
    "We ate pears, plums etc. in May.| However, he left.",
    "Fruit, e.g. figs, cost 3.5 dollars.| Nobody paid.",
    "He ate apples etc.| The sisters left.",
    "It was J. Adams who wrote it.| A. B. Green read it.",
    "Well... maybe not.| Hm...| Then he left.",
    "It stood on page 12. of the book.| In 1999.| Nobody knows.",
    "One line.|\nDr. Brown came\tlate.|\n\nGone",
    "(Dr. Green) called again.",
    "DR. GREEN CAME.| MR. ADAMS LEFT.",
    "É. Ünal et Dr. Öz.|  Où?",
    "",
    "   ",
    "Dr. ",
]


@pytest.mark.parametrize("plain", [False, True])
def test_hand_cut_texts(spark, ends, plain):
    texts = [c.replace("|", "") for c in CUT]
    wanted = [[p.strip() for p in c.split("|") if p.strip()] for c in CUT]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    text = tx.spaced(F.col("text")) if plain else F.col("text")
    found = rows.orderBy("id").select(ends.sentences(text, plain).alias("s")).collect()
    squeezed = [[" ".join(x.split()) for x in r.s] for r in found]
    assert squeezed == [[" ".join(x.split()) for x in w] for w in wanted]
    counts = rows.orderBy("id").select(tx.capital_sentences(ends.marked(text, plain), plain).alias("n")).collect()
    assert [r.n for r in counts][:3] == [4, 2, 2]


def test_plain_rule_without_a_model(spark):
    rows = spark.createDataFrame([("Dr. Smith came. He left.",), (None,)], "text string")
    nothing = sentences.learn(rows.limit(0))
    assert nothing == sentences.SentenceEnds()
    assert [r[0] for r in rows.select(nothing.sentences(F.col("text"))).collect()] == [["Dr.", "Smith came.", "He left."], None]


def test_sql_agrees(spark, texts):
    duck = check.connect("/root/testdata/sf0.001")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *(c.replace("|", "") for c in CUT)])], "doc_id bigint, text string")
    duck.execute("DROP VIEW documents")
    duck.register("documents", rows.toPandas())
    learned = b.learned("SELECT text FROM documents")
    for name, score in (("abbreviations", sentences.abbreviation_scores), ("starters", lambda d: sentences.starter_scores(d, sentences.learn(d).abbreviations))):
        theirs = {r[0]: r[1:] for r in duck.execute(f"WITH {learned} SELECT * FROM {name}").fetchall()}
        ours = {r[0]: tuple(r)[1:] for r in score(rows).collect()}
        assert set(ours) == set(theirs)
        assert all(ours[w][:2] == theirs[w][:2] and ours[w][2] == pytest.approx(theirs[w][2], rel=1e-9, abs=1e-9) for w in ours)
    theirs = dict(duck.execute(f"WITH {learned} SELECT doc_id, {b.learned_sents('text')} AS s FROM documents, learned").fetchall())
    ours = {r.doc_id: r.s for r in rows.select("doc_id", sentences.learn(rows).sentences(F.col("text")).alias("s")).collect()}
    assert {i: [" ".join(x.split()) for x in s] for i, s in ours.items()} == {i: [" ".join(x.split()) for x in s] for i, s in theirs.items()}


def test_scores_follow_the_learned_sentences(spark, texts, ends):
    rows = spark.createDataFrame([(i, "Explain fruit.", t, t) for i, t in enumerate(texts)], "idx int, instruction string, response string, text string")
    plain, learned = (quality.score_components(rows, ends=e).select("idx", "response_quality").collect() for e in (None, ends))
    assert len(plain) == len(learned) == len(texts) and plain != learned
    one, other = (corpus.quality_proxies(rows, ends=e).first() for e in (None, ends))
    assert other.grammar_score != one.grammar_score and other.avg_readability < one.avg_readability  # longer sentences
    many = spark.range(3).select(F.lit("U.S. e.g. Dr. ").alias("text"))
    assert sentences.learn(many, most=1).starters == ()


def test_learning_reads_the_texts_once(spark, texts):
    """What is counted over the corpus is kept: the scores are made of distinct words, without another pass."""
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for scores in (sentences.abbreviation_scores(rows), sentences.starter_scores(rows, ["dr", "mr"])):
        plan = scores._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "LogicalRDD" not in plan

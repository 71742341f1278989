"""Learned sentence ends keep every word from the score on, however many there are."""

import string

import pytest
from pyspark.sql import functions as F

from corpusmill.catalog import all_queries
from corpusmill.operators import corpus, quality, sentences

#: Sentence starters and abbreviations, more of either than a model once kept.
LETTERS = string.ascii_lowercase
STARTERS = [f"{a}{b}{c}x" for a in LETTERS for b in LETTERS for c in LETTERS][:2100]
SHORT = [chr(0x4E00 + i) for i in range(len(STARTERS))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Every document has a starter and an abbreviation of its own, and three sentences that need both."""
    rows = []
    for i, (word, short) in enumerate(zip(STARTERS, SHORT)):
        taught = f"{word.capitalize()} has one two three {short}. four five six seven eight nine ten eleven! " * 12
        rows.append((i, "en", taught + f"He met {short}. Smith today! She saw {short}. {word.capitalize()} there!"))
    path = str(tmp_path_factory.mktemp("words"))
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


WHOLE = sentences.SentenceEnds(tuple(SHORT), (*STARTERS, "he", "she"))


def test_every_abbreviation_is_kept(spark, folder, docs):
    assert set(sentences.abbreviations(docs)) == set(SHORT)
    found = {r.word: r.after_end for r in all_queries()["sentence_starters"](spark, folder).collect()}
    assert set(STARTERS) <= set(found) and "four" not in found  # it follows abbreviations only


def test_every_starter_is_kept_and_sentences_are_cut_there(spark, folder, docs):
    learned = sentences.learn(docs)
    assert set(STARTERS) <= set(learned.starters) and set(learned.abbreviations) == set(SHORT)
    cut = all_queries()["learned_sentences"](spark, folder)
    assert [tuple(r) for r in cut.groupBy("sentences").count().collect()] == [(15, len(STARTERS))]


def test_proxies_know_every_word(spark, folder, docs):
    found = all_queries()["learned_quality_proxies"](spark, folder).first()
    assert tuple(found) == pytest.approx(tuple(corpus.quality_proxies(docs, ends=WHOLE).first()), abs=1e-6)


def test_scores_know_every_word(spark, folder, docs):
    pairs = docs.selectExpr("doc_id AS idx", "text AS instruction", "text AS response")
    wanted = quality.score_components(pairs, ends=WHOLE).select("idx", F.col("response_quality").alias("wanted"))
    found = all_queries()["document_quality_learned"](spark, folder).join(wanted, "idx")
    assert found.count() == len(STARTERS) and found.where("abs(response_quality - wanted) > 1e-6").count() == 0

"""The training-data pipeline over ``documents``: language, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import graph, language_id, simhash, toxicity
from corpusmill.llm.queries import packed_documents
from corpusmill.llm.vectors import content_key
from corpusmill.session import keep

#: Documents are near-duplicates if the fingerprints of their shingles of so many words differ in so many bits at most.
SHINGLE_WORDS, BITS_APART = 3, 2


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, learned from their labels, does not reject."""
    found = language_id.classify(docs, language_id.train(docs))
    return found.where("accepted").select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model learned from ``labels`` does not call toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("toxic = 0").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates; of repeated rows one.

    Documents without an id come after all others of their group. Rows are told apart by id and text.
    """
    rows = docs.withColumn("_key", content_key(F.col("doc_id"), F.col("text")))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key").alias("_row")
    tables = simhash.single_table(64, radius=BITS_APART)
    groups = simhash.near_duplicates(rows.select(order, "text"), tables, bits=64, width=SHINGLE_WORDS, id_col="_row")
    chosen = groups.where("_row = component_id").select("_row._key.*").distinct()
    kept = rows.select("*", "_key.*").join(graph.shuffled(chosen), ["h", "l"], "left_semi")
    return kept.dropDuplicates(["h", "l"]).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents packed into sequences of 2048 tokens, one row per piece."""
    return packed_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("simhash_dedup", one_of_each),
    ("packing", packed),
]

#: Trained models are not said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = keep(stage(spark, out, sf_dir), name)
    return STAGES[-1][1](spark, out, sf_dir)

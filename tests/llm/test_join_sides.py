"""Joins whose sides both grow with the input never broadcast one, however small Spark takes it for."""

from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import graph, simhash


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_grid_points_are_not_broadcast(spark):
    fingerprint = F.unhex(F.lpad(F.hex(F.col("id") % 50), 16, "0")).alias("fingerprint")
    found = simhash.links(spark.range(300).select(F.col("id").alias("node"), fingerprint), simhash.single_table(64, 2))
    assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)
    texts = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three "), F.col("id") % 50).alias("text"))
    found = simhash.near_duplicates(texts, simhash.single_table(64, 2))
    assert found.count() == 300 and "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)


def test_smallest_neighbours_are_not_broadcast(spark, monkeypatch):
    plans, write = [], graph.keep
    monkeypatch.setattr(graph, "keep", lambda df, name: plans.append(plan(df)) or write(df, name))
    links = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert graph.components(links).where("root <> 0").count() == 0
    assert any("SortMergeJoin" in p for p in plans) and not [p for p in plans if "Broadcast" in p]


def test_kept_documents_are_not_broadcast(spark):
    docs = spark.range(20).selectExpr("id AS doc_id", "concat('one two three ', id % 4) AS text", "'en' AS lang")
    kept = corpus_pipeline.one_of_each(spark, docs, "")
    assert 1 <= kept.count() <= 4 and "SortMergeJoin" in plan(kept) and "Broadcast" not in plan(kept)

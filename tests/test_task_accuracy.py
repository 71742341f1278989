"""Generated tasks are graded where they are made, once per row, and responses to a fixed key where they are read."""

import pytest
from pyspark.sql import functions as F

from corpusmill.catalog import all_queries
from corpusmill.operators import grading

QUERIES = all_queries()
QUERY = QUERIES["task_accuracy"]


def figures(df):
    return {r.task_type: (r.total, r.accuracy) for r in df.collect()}


def test_no_join_and_no_broadcast(spark, sf):
    plan = QUERY(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_repeated_ids_count_once_per_row(spark, sf, tmp_path):
    once = figures(QUERY(spark, sf))
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders.union(orders).write.parquet(f"{tmp_path}/orders.parquet")
    assert figures(QUERY(spark, str(tmp_path))) == {t: (2 * n, share) for t, (n, share) in once.items()}


def test_rows_without_an_id_are_not_graded(spark, tmp_path):
    ids = spark.createDataFrame([(1,), (3,), (None,)], "o_orderkey bigint")
    ids.write.parquet(f"{tmp_path}/orders.parquet")
    assert set(figures(QUERY(spark, str(tmp_path))).values()) == {(3, 0.5)}


def test_graded_rows_equal_the_join(spark):
    tasks = grading.arithmetic_tasks(spark.range(300), "id").withColumn(
        "response", F.when(F.col("task_id") % 2 == 0, F.col("answer")).when(F.col("task_id") % 3 == 0, "none")
    )
    keys = grading.generated_keys(tasks)
    joined = grading.graded(tasks.select("task_id", "response"), keys).select("task_id", "correct")
    beside = grading.graded_rows(grading.generated_keys(tasks, keep=["response"])).select("task_id", "correct")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, beside.collect()))


@pytest.mark.parametrize("name", ["answer_checks", "answer_checks_whole_words", "few_shot_accuracy", "capability_accuracy"])
def test_responses_are_not_shuffled_to_the_keys(spark, sf, name):
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")  # as with documents too large to be broadcast themselves
    try:
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(setting, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(task_id" not in plan

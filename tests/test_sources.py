"""Files in and out, the score store, streams and whole jobs."""

import json
import os

import public_tokenizers
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill import schemas
from corpusmill.catalog import base as b
from corpusmill.operators import formats, generation
from corpusmill.plans import jobs
from corpusmill.session import drop_kept, keep, scratch_path, shared_dir
from corpusmill.sources import score_store, sinks, tables, tokenizing
from corpusmill.streaming import scoring


def test_shared_dir_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        assert shared_dir(spark).startswith(root)


def test_keep(spark):
    df = keep(spark.range(10), "numbers")
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().toString()


def test_unknown_source(spark):
    with pytest.raises(ValueError, match="Unknown dataset"):
        tables.SourceRegistry().load(spark, "nowhere")
    with pytest.raises(ValueError):
        tables.scan(spark, "x", "xls")


def test_prompt_json(spark, tmp_path):
    path = tmp_path / "prompts.json"
    path.write_text(json.dumps([{"prompt": "a", "category": "qa", "max_tokens": 9}, {"prompt": "b"}]))
    got = {r.prompt: (r.category, r.max_tokens) for r in tables.prompts_from_json(spark, str(path)).collect()}
    assert got == {"a": ("qa", 9), "b": ("general", 200)}


def test_report_text(spark, tmp_path):
    df = spark.createDataFrame([(2, "x", 0.7, "P", "two"), (1, "y", 1.0, "Q", "one")], "n int, c string, t double, p string, g string")
    block = generation.report_block(F.col("n"), F.col("c"), F.col("t"), F.col("p"), F.col("g"))
    sinks.save_report(df, str(tmp_path / "r"), block, "n", n=1)
    lines = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert lines[:3] == ["Sample 1", "Category: y", "Temperature: 1.00"] and "two" not in lines


def test_tokenizer_is_set_up_once_and_gives_the_ids_of_its_library(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ["Hello there, world!", "", None, "é 日本 🙂", "word " * 3000, "x" * 5000, " "]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    monkeypatch.setattr(tokenizing, "BYTES_AT_ONCE", 4000)
    for most in (None, 3):
        got = {r.id: r.t for r in rows.select("id", tokenizing.tokenized(F.col("text"), tokenizing.TokenizerFile(path), most).alias("t")).collect()}
        for i, text in enumerate(texts):
            ids = None if text is None else plain.encode(text, add_special_tokens=False).ids
            assert (got[i] and (got[i].ids, got[i].length)) == (ids if ids is None else (ids[:most], len(ids)))
    assert rows.limit(0).select(tokenizing.tokenized(F.col("text"), tokenizing.TokenizerFile(path))).count() == 0
    calls = spark.sparkContext.accumulator(0)

    def setup():
        calls.add(1)
        return lambda batch: [[len(t)] * len(t.split()) for t in batch]

    many = spark.range(0, 30000, 1, 1).select(F.concat_ws(" ", "id", "id").alias("text"))
    assert many.select(tokenizing.tokenized(F.col("text"), setup).alias("t")).agg(F.sum("t.length")).first()[0] == 60000
    assert calls.value == 1
    summary, histogram = jobs.length_profile(rows.where("text IS NOT NULL"), "id", counter=tokenizing.token_ids(tokenizing.TokenizerFile(path)))
    lengths = [len(plain.encode(t, add_special_tokens=False).ids) for t in texts if t is not None]
    row = summary.first()
    assert (row.n, row.max, row.median) == (6, max(lengths), sorted(lengths)[2] / 2 + sorted(lengths)[3] / 2)
    assert histogram.agg(F.sum("n")).first()[0] == 6


def test_missing_store_is_empty(spark, tmp_path):
    assert score_store.stored_scores(spark, str(tmp_path / "none")).count() == 0


def test_store_scores_once(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.createDataFrame([(1, "a", "bc"), (2, "ab", "c"), (3, "a", "bc")], "idx int, instruction string, response string")
    score_store.update_store(first, path)
    assert score_store.stored_scores(spark, path).count() == 2
    more = first.unionByName(spark.createDataFrame([(4, None, "new")], first.schema))
    score_store.update_store(more, path)
    assert score_store.stored_scores(spark, path).count() == 3
    assert score_store.with_stored_scores(more, path).count() == 4
    score_store.update_store(first.limit(1), path, force=True)
    assert score_store.stored_scores(spark, path).count() == 1


def files_of(spark, path, parts):
    """One file of ten rows per part, in the order in which they arrive."""
    for k in range(parts):
        spark.range(10 * k, 10 * k + 10, numPartitions=1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            if os.path.getmtime(f"{path}/{name}") > 10**9:
                os.utime(f"{path}/{name}", (10**8 + k, 10**8 + k))


def doubled(df):
    return df.withColumn("x", F.col("id") * 2)


def test_stream_resumes_without_duplicates(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    files_of(spark, src, 3)

    def run():
        scoring.run_available(tables.scan_stream(spark, src, "id bigint", files_per_trigger=1), doubled, out, check)
        return sorted(r.id for r in scoring.read_committed(spark, out, "id bigint, x bigint").collect())

    assert scoring.read_committed(spark, out, "id bigint, x bigint").count() == 0
    assert run() == list(range(30))
    assert run() == list(range(30))
    spark.range(30, 38).write.mode("append").parquet(src)
    assert run() == list(range(38))
    assert len(scoring.committed(spark, out)) >= 4 and sum(scoring.committed(spark, out).values()) == 38


@pytest.mark.parametrize("where", ["before the write", "half written", "before the commit", "after the commit"])
def test_stream_recovers_from_a_failure(spark, tmp_path, monkeypatch, where):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    files_of(spark, src, 4)
    write, commit = scoring._write, scoring.commit

    def failing_write(batch, output, number):
        if number == 2 and where == "before the write":
            raise OSError("lost")
        if number == 2 and where == "half written":
            batch.limit(3).write.mode("overwrite").parquet(f"{output}/batch={number}")
            raise OSError("lost")
        return write(batch, output, number)

    def failing_commit(spark, output, number, rows):
        if number == 2 and where == "before the commit":
            raise OSError("lost")
        commit(spark, output, number, rows)
        if number == 2 and where == "after the commit":
            raise OSError("lost")

    def run():
        scoring.run_available(tables.scan_stream(spark, src, "id bigint", files_per_trigger=1), doubled, out, check)

    monkeypatch.setattr(scoring, "_write", failing_write)
    monkeypatch.setattr(scoring, "commit", failing_commit)
    with pytest.raises(StreamingQueryException, match="lost"):
        run()
    seen = sorted(r.id for r in scoring.read_committed(spark, out, "id bigint, x bigint").collect())
    assert seen == list(range(30 if where == "after the commit" else 20))
    monkeypatch.undo()
    run()
    rows = scoring.read_committed(spark, out, "id bigint, x bigint").collect()
    assert sorted(map(tuple, rows)) == [(i, 2 * i) for i in range(40)]


def test_stream_take_leaves_the_rest_unread(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    files_of(spark, src, 50)

    def take(n):
        return scoring.take_from_stream(tables.scan_stream(spark, src, "id bigint", files_per_trigger=1), n, out, check)

    query = take(25)
    assert sorted(r.id for r in scoring.read_committed(spark, out, "id bigint").collect()) == list(range(25))
    assert sum(p.numInputRows for p in query.recentProgress) <= 3 * 20  # a batch is read again where it is cut
    assert len(scoring.committed(spark, out)) == 3
    assert take(25) is None
    assert len(os.listdir(f"{check}/offsets")) - 1 <= 2 * 4


@pytest.mark.parametrize("n", [0, 1, 7, 20, 21, 40, 41])
def test_first_rows_of_a_batch(spark, tmp_path, n):
    batch = spark.range(0, 40, 1, 4)
    kept = scoring.first_of(batch, n, str(tmp_path / "out"), 0)
    assert sorted(r.id for r in kept.collect()) == list(range(min(n, 40)))


def test_score_and_tier_job(spark, sf, tmp_path):
    path = str(tmp_path / "job")
    pairs = b.document_pairs(spark, sf)
    report = {r.tier: r for r in jobs.score_and_tier(pairs, "idx", path, {"top": 20, "all": 500}).collect()}
    assert (report["top"].total_samples, report["all"].total_samples) == (20, 200)
    assert report["top"].score_threshold >= report["all"].median
    saved = spark.read.parquet(f"{path}/tiers")
    assert saved.where("tier = 'top'").count() == 20 and saved.where("tier = 'all'").count() == 200
    assert {"instruction", "response", "quality_score", "quality_components", "split"} <= set(saved.columns)


def test_prepare_job(spark, tmp_path):
    rows = spark.range(100).select("id", formats.pair_text(F.lit("q"), F.col("id").cast("string")).alias("text"))
    summary = jobs.prepare(rows, str(tmp_path / "p"), "id", n=60).first()
    assert summary.total_samples == 60 == summary.train_samples + summary.validation_samples


def test_schemas_parse():
    for ddl in (schemas.DOCUMENTS, schemas.PAIR, schemas.SCORE_STORE, schemas.CHAT_FROM_VALUE, schemas.MIXED):
        assert schemas.struct(ddl).fields


def test_drop_kept(spark):
    path = scratch_path(spark, "gone")
    spark.range(1).write.parquet(path)
    drop_kept(spark)
    with pytest.raises(Exception):
        spark.read.parquet(path)

"""Streams over a table that is a folder of files, as Spark writes it."""

import os

import pytest

from corpusmill import schemas
from corpusmill.catalog import all_queries
from corpusmill.session import keep
from corpusmill.sources import tables
from corpusmill.streaming import scoring


QUERIES = all_queries()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The documents in three files; the first by name holds the fewest rows."""
    path = str(tmp_path_factory.mktemp("parts"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").toPandas()
    os.mkdir(f"{path}/documents.parquet")
    for k, part in enumerate((docs[:30], docs[30:80], docs[80:])):
        part.to_parquet(f"{path}/documents.parquet/part-{k}.parquet", index=False)
    return path


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_stream_scan_reads_every_file(spark, sf, folder):
    assert rows(QUERIES["stream_scan"](spark, folder)) == rows(QUERIES["stream_scan"](spark, sf)) != []


@pytest.mark.parametrize("name", ["stream_scores", "resumed_stream_scores"])
def test_stream_scores_cover_every_file(spark, folder, name):
    assert rows(QUERIES[name](spark, folder)) == rows(
        QUERIES["document_quality"](spark, folder).select("idx", "clarity", "response_quality", "diversity", "complexity", "score")
    )


def test_stream_take_goes_by_file_name(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").orderBy("doc_id").limit(100)
    assert rows(QUERIES["stream_take"](spark, folder)) == rows(docs)


def test_a_stream_of_one_file_and_of_its_folder(spark, folder, tmp_path):
    for k, place in enumerate((f"{folder}/documents.parquet/part-1.parquet", f"{folder}/documents.parquet")):
        stream = tables.scan_stream(spark, place, schemas.DOCUMENTS).select("doc_id")
        scoring.run_available(stream, lambda df: df, str(tmp_path / f"o{k}"), str(tmp_path / f"c{k}"))
        assert scoring.read_committed(spark, str(tmp_path / f"o{k}"), "doc_id bigint").count() == (50, 200)[k]


def test_first_rows_by_an_order(spark, tmp_path):
    batch = spark.range(0, 40, 1, 4).selectExpr("39 - id AS id")
    kept = keep(scoring.first_of(batch, 13, str(tmp_path / "out"), 0, ["id"]), "kept")
    assert sorted(r.id for r in kept.collect()) == list(range(13))


def test_batches_have_a_file_for_every_core(spark, sf, monkeypatch):
    """A fixed number of files bounds the tasks of a batch, however large the table is."""
    seen, scan = [], tables.scan_stream

    def watched(session, path, schema, files_per_trigger=1000, **options):
        seen.append((files_per_trigger, len([f for f in os.listdir(path) if f.endswith(".parquet")])))
        return scan(session, path, schema, files_per_trigger=files_per_trigger, **options)

    monkeypatch.setattr(tables, "scan_stream", watched)
    assert QUERIES["recovered_stream_scores"](spark, sf).count() == 200
    assert all(batch >= 8 and files > 2 * batch for batch, files in seen) and len(seen) == 2

"""Scans, sinks, the score store, batch maps and file streams, each written and read back."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.catalog import base as b
from corpusmill.catalog import corpus_queries as cq
from corpusmill.catalog.base import query, r6
from corpusmill.catalog.quality_queries import CHAT_SCORED, DOC_SCORED, PARTS, ROUNDED, scored_documents
from corpusmill.functions import text as tx
from corpusmill.operators import generation, mixing, quality
from corpusmill.session import scratch_path
from corpusmill.sources import score_store, sinks, tables, tokenizing
from corpusmill.streaming import scoring


@query("scan_documents", "SELECT doc_id, lang, source, n_chars FROM documents")
def scan_documents(spark, sf):
    """A whole-table scan with pruned columns."""
    return tables.scan(spark, f"{sf}/documents.parquet").select("doc_id", "lang", "source", "n_chars")


@query("scan_subset", "SELECT doc_id, lang FROM documents WHERE source = 'src3'")
def scan_subset(spark, sf):
    """One named subset of a table partitioned by source."""
    path = scratch_path(spark, "by_source")
    rows = b.table(spark, sf, "documents").select("doc_id", "lang", "source")
    sinks.save_splits(rows, path, by=("source",))
    return tables.scan_subset(spark, path, "source", "src3").select("doc_id", "lang")


@query("registered_sources", "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT 'web' AS source, text FROM documents UNION ALL SELECT 'questions', text FROM conversations WHERE role='user') t GROUP BY source")
def registered_sources(spark, sf):
    """Two sources of different layout through the registry."""
    registry = tables.SourceRegistry()
    registry.add("web", tables.Source(f"{sf}/documents.parquet", lambda df: df.select("text")))
    registry.add("questions", tables.Source(f"{sf}/conversations.parquet", lambda df: df.select("text"), subset=("role", "user")))
    rows = registry.load_all(spark, ["web", "questions"])
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


SPLIT = f"CASE WHEN {b.hash32(42, 'idx')} % 10000 < 500 THEN 'validation' ELSE 'train' END"


@query(
    "dataset_summary",
    f"""WITH {DOC_SCORED} SELECT count(*) AS total_samples, count_if(split='train')::BIGINT AS train_samples, count_if(split='validation')::BIGINT AS validation_samples,
 {r6('min(score)')} AS score_threshold, {r6('avg(score)')} AS mean_score, {r6('max(score)')} AS score_max FROM (SELECT score, {SPLIT} AS split FROM scored) t""",
)
def dataset_summary(spark, sf):
    """Counts and score range of a split dataset, written as JSON and read back."""
    rows = mixing.with_split(scored_documents(spark, sf), "idx")
    path = scratch_path(spark, "summary")
    summary = sinks.dataset_summary(rows, "score")
    sinks.save_json(summary, path)
    return tables.scan(spark, path, "json", summary.schema.simpleString()[7:-1].replace(":", " "))


@query("score_csv", f"WITH {DOC_SCORED} SELECT idx, {ROUNDED} FROM scored")
def score_csv(spark, sf):
    """The flat score table as CSV with a header, read back."""
    path = scratch_path(spark, "csv")
    sinks.save_score_csv(scored_documents(spark, sf), path)
    return tables.scan(spark, path, "csv", schemas.SCORE_CSV, header=True)


@query("prediction_json", "SELECT doc_id, text AS prediction FROM documents ORDER BY doc_id LIMIT 100")
def prediction_json(spark, sf):
    """The first hundred predictions as JSON, read back."""
    path = scratch_path(spark, "predictions")
    rows = b.table(spark, sf, "documents").select("doc_id", F.col("text").alias("prediction"))
    sinks.save_predictions(rows, path, "doc_id")
    return tables.scan(spark, path, "json", "doc_id bigint, prediction string")


LINES = f"""SELECT line, count(*) AS n FROM (SELECT unnest(string_split(block, chr(10))) AS line FROM (
 SELECT 'Sample '||doc_id||chr(10)||'Category: '||category||chr(10)||'Temperature: '||printf('%.2f', temperature)||chr(10)||'Prompt: '||source||chr(10)||'Generated:'||chr(10)||text||chr(10)||repeat('-',80)||chr(10) AS block
 FROM (SELECT o.*, source FROM ({cq.OUTPUTS}) o JOIN (SELECT doc_id, source FROM documents) d USING (doc_id)) x) t) u GROUP BY line"""


@query("report_lines", LINES)
def report_lines(spark, sf):
    """A text report over all samples, written and read back line by line."""
    path = scratch_path(spark, "report")
    names = b.table(spark, sf, "documents").select("doc_id", "source")
    rows = cq.outputs(spark, sf).join(names, "doc_id")
    block = generation.report_block(
        F.col("doc_id"), F.col("category"), F.col("temperature"), F.col("source"), F.col("generated")
    )
    sinks.save_report(rows.withColumn("_block", block), path, F.col("_block"), "doc_id", n=None)
    lines = tables.scan(spark, path, "text", "value string", lineSep="\n")
    return lines.groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query(
    "score_store",
    f"WITH {CHAT_SCORED} SELECT idx, {r6('score')} AS score, {r6('clarity')} AS clarity FROM scored",
)
def score_store_query(spark, sf):
    """Scores from a store that was filled in two steps; the second scores only what is new."""
    path = scratch_path(spark, "store")
    pairs = b.chat_pairs(spark, sf)
    score_store.update_store(pairs.where(F.crc32("idx") % 2 == 0), path)
    score_store.update_store(pairs, path)
    stored = score_store.with_stored_scores(pairs, path)
    return stored.select("idx", "score", F.col("components.clarity").alias("clarity"))


@query(
    "score_store_size",
    f"SELECT count(DISTINCT coalesce(instruction,'')||chr(1)||coalesce(response,'')) AS pairs FROM ({b.DOCUMENT_PAIRS}) t",
)
def score_store_size(spark, sf):
    """Rows in the store: one per distinct pair, although the documents hold copies."""
    path = scratch_path(spark, "store")
    pairs = b.document_pairs(spark, sf)
    score_store.update_store(pairs, path)
    score_store.update_store(pairs, path)
    return score_store.stored_scores(spark, path).agg(F.count("*").alias("pairs"))


# --- streams ---------------------------------------------------------------------------------------
def document_stream(spark, sf):
    return tables.scan_stream(spark, f"{sf}/documents.parquet", schemas.DOCUMENTS)


SCORES = "idx bigint, " + ", ".join(f"{c} double" for c in [*PARTS, "score"])


def _score_batch(df):
    pairs = df.select(
        F.col("doc_id").alias("idx"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("instruction"),
        F.col("text").alias("response"),
    )
    return quality.score_components(pairs).withColumn("score", quality.weighted_total()).select("idx", *PARTS, "score")


@query("stream_scan", "SELECT doc_id, lang, source, n_chars FROM documents")
def stream_scan(spark, sf):
    """The documents read as a bounded file stream."""
    out, check = scratch_path(spark, "stream"), scratch_path(spark, "progress")
    scoring.run_available(document_stream(spark, sf), lambda df: df.drop("text"), out, check)
    return scoring.read_committed(spark, out, document_stream(spark, sf).drop("text").schema)


@query("stream_scores", f"WITH {DOC_SCORED} SELECT idx, {ROUNDED} FROM scored")
def stream_scores(spark, sf):
    """Micro-batch scoring gives the batch scores."""
    out, check = scratch_path(spark, "stream"), scratch_path(spark, "progress")
    scoring.run_available(document_stream(spark, sf), _score_batch, out, check)
    return scoring.read_committed(spark, out, SCORES)


@query("resumed_stream_scores", f"WITH {DOC_SCORED} SELECT idx, {ROUNDED} FROM scored")
def resumed_stream_scores(spark, sf):
    """A second run on the same progress adds nothing."""
    out, check = scratch_path(spark, "stream"), scratch_path(spark, "progress")
    for _ in range(2):
        scoring.run_available(document_stream(spark, sf), _score_batch, out, check)
    return scoring.read_committed(spark, out, SCORES)


class Interrupted(RuntimeError):
    """The failure that ``recovered_stream_scores`` recovers from."""


@query("recovered_stream_scores", f"WITH {DOC_SCORED} SELECT idx, {ROUNDED} FROM scored")
def recovered_stream_scores(spark, sf):
    """Four batches, each of a file for every core and split of the table at least; the first run fails in the second
    one, after some of its rows are written."""
    source, out, check = (scratch_path(spark, name) for name in ("arrived", "stream", "progress"))
    docs = b.table(spark, sf, "documents")
    files = max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    docs.repartition(4 * files, "doc_id").write.parquet(source)

    def failing(df):
        scored = _score_batch(df)
        if scoring.committed(spark, out):
            scored.write.mode("overwrite").parquet(f"{out}/batch=1")
            raise Interrupted("after a batch was written and before it was committed")
        return scored

    for transform in (failing, _score_batch):
        stream = tables.scan_stream(spark, source, schemas.DOCUMENTS, files_per_trigger=files)
        try:
            scoring.run_available(stream, transform, out, check)
        except StreamingQueryException as error:
            if Interrupted.__name__ not in str(error):
                raise
    return scoring.read_committed(spark, out, SCORES)


@query("stream_take", "SELECT doc_id, lang FROM documents LIMIT 100")
def stream_take(spark, sf):
    """The first rows to arrive from a stream, file by file by name and in the order in which a file holds them."""
    out, check = scratch_path(spark, "taken"), scratch_path(spark, "progress")
    place = ("_metadata.file_path", "_metadata.row_index")
    rows = document_stream(spark, sf).select("doc_id", "lang", *[F.col(c).alias(f"_{i}") for i, c in enumerate(place)])
    scoring.take_from_stream(rows, 100, out, check, order=["_0", "_1"])
    return scoring.read_committed(spark, out, rows.schema).drop("_0", "_1")


# --- Python batches --------------------------------------------------------------------------------
@query("mapped_batches", f"SELECT doc_id, len({b.words('text')}) AS n_tokens FROM documents")
def mapped_batches(spark, sf):
    """A user's token counter over row batches."""

    def count(pdf):
        return pdf.assign(n_tokens=pdf["text"].map(lambda t: len(t.split())))[["doc_id", "n_tokens"]]

    docs = b.documents(spark, sf).select("doc_id", "text")
    return tables.map_batches(docs, count, "doc_id bigint, n_tokens bigint")


@query("tokenizer_lengths")
def tokenizer_lengths(spark, sf):
    """Token counts and a digest of the ids by a real tokenizer (its library is the check, in the tests)."""
    import public_tokenizers

    setup = tokenizing.TokenizerFile(public_tokenizers.path("word_bpe_49k.json"))
    rows = b.documents(spark, sf).select("doc_id", tokenizing.tokenized(F.col("text"), setup).alias("t"))
    return rows.select("doc_id", F.col("t.length").alias("tokens"), F.md5(F.array_join("t.ids", " ")).alias("ids_md5"))


@query("plugged_tokenizer", f"WITH {b.scored_sql(b.CHAT_PAIRS).replace(b.toks('both_l') + ' AS bt', b.words('both_l') + ' AS bt')} SELECT idx, {r6('diversity')} AS diversity FROM scored")
def plugged_tokenizer(spark, sf):
    """Diversity with another token counter plugged in."""
    return quality.score_components(b.chat_pairs(spark, sf), only=["diversity"], counter=tx.words).select("idx", "diversity")


@query("compression_ratio")
def compression_ratio(spark, sf):
    """Compressed over raw bytes of each text (zlib; DuckDB has no such function)."""
    from corpusmill.operators import compression

    return compression.compression_ratio(b.documents(spark, sf).select("doc_id", "text"), "doc_id")


@query("compression_by_source")
def compression_by_source(spark, sf):
    """Compression diversity per source: total compressed over total raw bytes."""
    from corpusmill.operators import compression

    return compression.compression_diversity(b.documents(spark, sf), "source")

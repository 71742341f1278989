"""Splits, quotas and mixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.catalog import base as b
from corpusmill.catalog.base import query, r6
from corpusmill.functions import fixed
from corpusmill.functions import text as tx
from corpusmill.operators import compare, formats, mixing, ranking
from corpusmill.plans import jobs
from corpusmill.session import scratch_path
from corpusmill.sources import sinks, tables

SEED = 42
NAMES = fixed.MIX_SOURCES
SPLIT = f"CASE WHEN {b.hash32(SEED, 'doc_id')} % 10000 < 500 THEN 'validation' ELSE 'train' END"


@query("train_validation_split", f"SELECT doc_id, {SPLIT} AS split FROM documents")
def train_validation_split(spark, sf):
    """95/5 by hash."""
    return mixing.with_split(b.table(spark, sf, "documents").select("doc_id"), "doc_id", SEED)


def _exact_sql(table: str, key: str) -> str:
    return f"""SELECT {key}, CASE WHEN row_number() OVER (ORDER BY {b.hash32(SEED, key)}, {key}) <= ceil(0.05e0*(SELECT count(*) FROM {table})) THEN 'validation' ELSE 'train' END AS split FROM {table}"""


@query("exact_split", _exact_sql("orders", "o_orderkey"))
def exact_split(spark, sf):
    """Exactly five percent for validation."""
    return mixing.exact_split(b.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", SEED)


@query(
    "seeded_order",
    f"SELECT o_orderkey, row_number() OVER (ORDER BY {b.hash32(7, 'o_orderkey')}, o_orderkey) AS place FROM orders",
)
def seeded_order(spark, sf):
    """Place of every row in the seeded shuffle."""
    rows = b.table(spark, sf, "orders").select("o_orderkey", tx.seeded_key(7, F.col("o_orderkey")).alias("h"))
    return ranking.rank_rows(rows, [F.col("h").asc(), F.col("o_orderkey").asc()], name="place").select("o_orderkey", "place")


@query("seeded_sample", f"SELECT doc_id, lang FROM documents ORDER BY {b.hash32(SEED, 'doc_id')}, doc_id LIMIT 100")
def seeded_sample(spark, sf):
    """A hundred rows without replacement."""
    return ranking.seeded_sample(b.table(spark, sf, "documents").select("doc_id", "lang"), 100, "doc_id", SEED)


# The four mixing sources are stood in for by document sources, src0, src4, … for the first and so on.
SOURCE = f"{b.text_list(NAMES)}[CAST(substr(source, 4) AS BIGINT) % 4 + 1]"
EDU, WEB = "length(text)>=100", "length(text)>=200"


def sources(spark, sf):
    """Every document with its mixing source and formatted text (NULL when rejected)."""
    number = F.substring("source", 4, 10).cast("int") % 4
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), number + 1)
    docs = b.documents(spark, sf).select("doc_id", "text", name.alias("source"))
    made = F.when(F.col("source") == "fineweb", formats.web_text(F.col("text"))).otherwise(
        formats.educational_text(F.col("text"))
    )
    return docs.withColumn("text", made)


def total_rows(spark, sf) -> int:
    return b.table(spark, sf, "documents").count() * 4 // 10


def _cut(limit: int) -> str:
    return f"CASE WHEN len(w)>{limit} THEN array_to_string(w[1:{limit}],' ') ELSE text END"


RATIOS = ", ".join(
    f"('{s}', '{n}', {r!r}::DOUBLE)" for s, ratios in fixed.MIX_STRATEGIES.items() for n, r in ratios.items()
)
POOL = f"""pool AS (SELECT doc_id, source, CASE WHEN source='fineweb' THEN CASE WHEN {WEB} THEN {_cut(800)} END ELSE CASE WHEN {EDU} THEN {_cut(1000)} END END AS text
 FROM (SELECT doc_id, text, {SOURCE} AS source, {b.words('text')} AS w FROM documents) a),
 total AS (SELECT count(*)*4//10 AS n FROM documents),
 plan AS (SELECT strategy, source, ratio, trunc(ratio*n)::BIGINT AS quota FROM (VALUES {RATIOS}) r(strategy, source, ratio), total)"""
ACCEPTED = f"""{POOL}, rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {b.hash32(SEED, 'doc_id')}, doc_id) AS place FROM pool WHERE text IS NOT NULL),
 mixed AS (SELECT strategy, rk.source, doc_id, text FROM rk JOIN plan USING (source) WHERE place <= quota)"""


@query("source_quotas", f"WITH {POOL} SELECT strategy, source, {r6('ratio')} AS ratio, quota FROM plan")
def source_quotas(spark, sf):
    """Ratio and quota per strategy and source."""
    return mixing.quota_table(spark, fixed.MIX_STRATEGIES, total_rows(spark, sf))


UNEVEN = {"openhermes": 0.6, "cosmopedia": 0.3, "magpie": 0.3}


@query(
    "quota_sample",
    f"""WITH {POOL}, rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {b.hash32(SEED, 'doc_id')}, doc_id) AS place FROM pool WHERE text IS NOT NULL)
 SELECT doc_id, source, md5(text) AS text_md5 FROM rk, total, (VALUES {", ".join(f"('{k}', {v!r}::DOUBLE/{sum(UNEVEN.values())!r}::DOUBLE)" for k, v in UNEVEN.items())}) q(name, ratio)
 WHERE source = name AND place <= trunc(ratio*n)""",
)
def quota_sample(spark, sf):
    """One strategy whose ratios have to be normalised; quotas count accepted rows."""
    mixed = mixing.mix(sources(spark, sf), {"uneven": UNEVEN}, total_rows(spark, sf), "doc_id", seed=SEED)
    return mixed.select("doc_id", "source", F.md5("text").alias("text_md5"))


@query(
    "quota_first_rows",
    f"""WITH {POOL}, rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM pool)
 SELECT strategy, doc_id, rk.source FROM rk JOIN plan USING (source) WHERE place <= quota AND text IS NOT NULL""",
)
def quota_first_rows(spark, sf):
    """The first rows of each source, rejected rows counted towards the quota."""
    mixed = mixing.mix(
        sources(spark, sf), fixed.MIX_STRATEGIES, total_rows(spark, sf), "doc_id", quota_on="raw", order="id"
    )
    return mixed.select("strategy", "doc_id", "source")


@query(
    "mixed_strategies",
    f"""WITH {ACCEPTED} SELECT strategy, doc_id, source, len({b.words('text')}) AS length,
 CASE WHEN {b.hash32(SEED, 'doc_id')} % 10000 < 500 THEN 'validation' ELSE 'train' END AS split, {b.hash32(SEED, 'strategy', 'doc_id')} AS shuffle_key FROM mixed""",
)
def mixed_strategies(spark, sf):
    """All six strategies from one pass over the sources, split and with their shuffle key."""
    mixed = mixing.mixed_dataset(sources(spark, sf), fixed.MIX_STRATEGIES, total_rows(spark, sf), "doc_id", SEED)
    return mixed.select("strategy", "doc_id", "source", tx.word_count(F.col("text")).alias("length"), "split", "shuffle_key")


@query(
    "saved_strategies",
    f"WITH {ACCEPTED} SELECT strategy, CASE WHEN {b.hash32(SEED, 'doc_id')} % 10000 < 500 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM mixed GROUP BY ALL",
)
def saved_strategies(spark, sf):
    """Rows per strategy and split after the whole mixing job was written and read back."""
    path = scratch_path(spark, "mix")
    jobs.mix_corpus(sources(spark, sf), path, total_rows(spark, sf), "doc_id", seed=SEED)
    return tables.scan(spark, f"{path}/rows").groupBy("strategy", "split").agg(F.count("*").alias("n"))


@query(
    "mix_metadata",
    f"""WITH {ACCEPTED}, c AS (SELECT strategy, source, count(*) AS contributed FROM mixed GROUP BY ALL)
 SELECT strategy, plan.source, {r6('ratio')} AS ratio, quota, coalesce(contributed,0) AS contributed, sum(contributed) OVER (PARTITION BY strategy)::BIGINT AS total_samples, 42::BIGINT AS seed
 FROM plan LEFT JOIN c USING (strategy, source)""",
)
def mix_metadata(spark, sf):
    """Ratios, quotas and contributions of every strategy."""
    total = total_rows(spark, sf)
    mixed = mixing.mix(sources(spark, sf), fixed.MIX_STRATEGIES, total, "doc_id", seed=SEED)
    return mixing.mix_metadata(mixed, fixed.MIX_STRATEGIES, total, SEED)


@query("source_contributions", f"WITH {POOL} SELECT source, count(*) AS contributed FROM pool WHERE text IS NOT NULL GROUP BY source")
def source_contributions(spark, sf):
    """Accepted rows per source."""
    return mixing.contributions(sources(spark, sf).where(F.col("text").isNotNull()))


@query(
    "leave_one_out",
    f"""SELECT removed, source, CASE WHEN removed=source THEN 0e0 ELSE 0.33e0 END AS ratio FROM
 (SELECT DISTINCT {SOURCE} AS removed FROM documents) a, (SELECT DISTINCT {SOURCE} AS source FROM documents) c""",
)
def leave_one_out(spark, sf):
    """Ablation ratios over the sources of the table."""
    return mixing.leave_one_out(sources(spark, sf).select("source"))


@query(
    "source_profiles",
    f"SELECT source, {r6('avg(n)')} AS avg_length, {r6('stddev_pop(n)')} AS std_length, count(*) AS sample_count FROM (SELECT source, len({b.words('text')}) AS n FROM documents) t GROUP BY source",
)
def source_profiles(spark, sf):
    """Words per row and rows of every source."""
    return compare.source_profiles(b.documents(spark, sf))




@query("reloaded_split", f"SELECT doc_id, lang FROM documents WHERE {SPLIT} = 'train'")
def reloaded_split(spark, sf):
    """Save by split, read one split back."""
    path = scratch_path(spark, "splits")
    rows = mixing.with_split(b.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", SEED)
    sinks.save_splits(rows, path)
    return tables.reload_split(spark, path, "train").select("doc_id", "lang")


@query(
    "prepared_dataset",
    f"""SELECT count(*) AS total_samples, count_if(split='train')::BIGINT AS train_samples, count_if(split='validation')::BIGINT AS validation_samples FROM
 (SELECT CASE WHEN {b.hash32(SEED, 'conv_id')} % 10000 < 500 THEN 'validation' ELSE 'train' END AS split FROM (SELECT DISTINCT conv_id FROM conversations) a) t""",
)
def prepared_dataset(spark, sf):
    """The preparation job: format chats, split, save, summarise."""
    from corpusmill.catalog.text_queries import CHAT_ROLES

    chats = formats.chat_text(b.conversations(spark, sf), CHAT_ROLES)
    return jobs.prepare(chats, scratch_path(spark, "prepared"), "conv_id", seed=SEED)

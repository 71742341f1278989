"""Quality scores, ranks, tiers, bins and statistics over scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.catalog import base as b
from corpusmill.catalog.base import query, r6
from corpusmill.functions import fixed
from corpusmill.functions import text as tx
from corpusmill.operators import quality, ranking, sentences, stats
from corpusmill.plans import jobs
from corpusmill.session import keep, scratch_path

CHAT_SCORED = b.scored_sql(b.CHAT_PAIRS)
DOC_SCORED = b.scored_sql(b.DOCUMENT_PAIRS)
PARTS = quality.COMPONENTS
ROUNDED = ", ".join(f"{r6(c)} AS {c}" for c in [*PARTS, "score"])


def scored_documents(spark, sf):
    """Stored narrow scores (idx, score, components) of the document pairs."""
    rows = quality.score_pairs(b.document_pairs(spark, sf)).select("idx", "score", "components")
    return keep(rows, "scores")


def flat(scored):
    return scored.select("idx", "score", "components.*")


for _name in PARTS:

    def _one(spark, sf, part=_name):
        return quality.score_components(b.chat_pairs(spark, sf), only=[part]).select("idx", part)

    _one.__doc__ = f"The {_name.replace('_', ' ')} dimension of every exchange of every chat."
    query(f"{_name}_scores", f"WITH {CHAT_SCORED} SELECT idx, {r6(_name)} AS {_name} FROM scored")(_one)


@query("chat_quality", f"WITH {CHAT_SCORED} SELECT idx, {ROUNDED} FROM scored")
def chat_quality(spark, sf):
    """All dimensions and the weighted total of every exchange of every chat."""
    return flat(quality.score_pairs(b.chat_pairs(spark, sf)))


@query("document_quality", f"WITH {DOC_SCORED} SELECT idx, {ROUNDED} FROM scored")
def document_quality(spark, sf):
    """All dimensions and the weighted total of every document pair; one scan, no shuffle."""
    return flat(quality.score_pairs(b.document_pairs(spark, sf)))


@query(
    "document_quality_learned",
    f"WITH {b.learned('SELECT text FROM documents')}, {b.scored_sql(b.DOCUMENT_PAIRS, learn=True)} SELECT idx, {ROUNDED} FROM scored",
)
def document_quality_learned(spark, sf):
    """The same with sentence ends learned from the documents."""
    pairs = b.document_pairs(spark, sf)
    return flat(quality.score_pairs(pairs, ends=sentences.learn(pairs, "response")))


@query(
    "custom_weights",
    f"WITH {CHAT_SCORED} SELECT idx, {r6('clarity*0.1e0+response_quality*0.2e0+diversity*0.3e0+complexity*0.4e0')} AS score FROM scored",
)
def custom_weights(spark, sf):
    """The total with other weights."""
    weights = {"clarity": 0.1, "response_quality": 0.2, "diversity": 0.3, "complexity": 0.4}
    return quality.score_pairs(b.chat_pairs(spark, sf), weights=weights).select("idx", "score")


@query(
    "attached_scores",
    f"""WITH {CHAT_SCORED} SELECT idx, md5(instruction) AS instruction_md5, {r6('score')} AS quality_score, {r6('clarity')} AS quality_clarity
 FROM scored JOIN src USING (idx)""",
)
def attached_scores(spark, sf):
    """Score metadata joined to the rows."""
    pairs = b.chat_pairs(spark, sf)
    scores = quality.score_pairs(pairs).select("idx", "score", "components")
    return quality.attach_scores(pairs, scores, "idx").select(
        "idx",
        F.md5("instruction").alias("instruction_md5"),
        "quality_score",
        F.col("quality_components.clarity").alias("quality_clarity"),
    )


# --- order and tiers -------------------------------------------------------------------------------
ORDERS = "SELECT o_orderkey AS idx, o_totalprice AS score FROM orders"


def order_scores(spark, sf):
    return b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("score"))


@query("score_ranks", f"SELECT idx, {r6('score')} AS score, row_number() OVER (ORDER BY score DESC, idx) AS rank FROM ({ORDERS}) t")
def score_ranks(spark, sf):
    """Score against rank for every row."""
    return ranking.score_ranks(order_scores(spark, sf))


@query(
    "sorted_by_score",
    f"WITH {DOC_SCORED} SELECT idx, {r6('score')} AS score FROM scored ORDER BY scored.score DESC, idx",
)
def sorted_by_score(spark, sf):
    """Best first."""
    return ranking.sorted_by_score(flat(scored_documents(spark, sf)).select("idx", "score"))


@query("top_scores", f"WITH {DOC_SCORED} SELECT idx, {r6('score')} AS score FROM scored ORDER BY scored.score DESC, idx LIMIT 50")
def top_scores(spark, sf):
    """The fifty best rows."""
    return ranking.top_k(flat(scored_documents(spark, sf)).select("idx", "score"), 50)


TIERS = {"ultra_high": 100, "high": 500, "medium": 2000}
TIER_ROWS = ", ".join(f"('{n}', {s})" for n, s in TIERS.items())
TIER_SQL = f"""ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, idx) AS rank FROM scored),
 members AS (SELECT tier, ranked.* FROM ranked JOIN (VALUES {TIER_ROWS}) v(tier, size) ON rank <= size)"""


@query("quality_tiers", f"WITH {DOC_SCORED}, {TIER_SQL} SELECT tier, idx, {r6('score')} AS score, rank FROM members")
def quality_tiers(spark, sf):
    """Nested top-N tiers; the largest is capped at the row count."""
    return ranking.nested_tiers(scored_documents(spark, sf).select("idx", "score"), TIERS)


@query(
    "tier_report",
    f"""WITH {DOC_SCORED}, {TIER_SQL} SELECT tier, count(*) AS total_samples, {r6('avg(score)')} AS mean, {r6('stddev_pop(score)')} AS std,
 {r6('min(score)')} AS score_threshold, {r6('max(score)')} AS max, {r6('median(score)')} AS median,
 {", ".join(f"{r6(f'avg({c})')} AS {c}_mean, {r6(f'stddev_pop({c})')} AS {c}_std" for c in PARTS)} FROM members GROUP BY tier""",
)
def tier_report(spark, sf):
    """Size, threshold and component statistics of every tier."""
    members = ranking.nested_tiers(flat(scored_documents(spark, sf)), TIERS)
    return ranking.tier_report(members, PARTS)


SPLIT_SQL = f"CASE WHEN {b.hash32(42, 'idx')} % 10000 < 500 THEN 'validation' ELSE 'train' END"


@query(
    "score_and_tier_report",
    f"""WITH {DOC_SCORED}, {TIER_SQL} SELECT tier, count(*) AS total_samples, {r6('avg(score)')} AS mean, {r6('min(score)')} AS score_threshold,
 {r6('median(score)')} AS median FROM members GROUP BY tier""",
)
def score_and_tier_report(spark, sf):
    """The whole scoring job over the documents: its report."""
    report = jobs.score_and_tier(b.document_pairs(spark, sf), "idx", scratch_path(spark, "job"), TIERS)
    return report.select("tier", "total_samples", "mean", "score_threshold", "median")


@query(
    "score_and_tier_rows",
    f"""WITH {DOC_SCORED}, {TIER_SQL} SELECT tier, {SPLIT_SQL} AS split, idx, {r6('score')} AS quality_score, {r6('clarity')} AS clarity,
 md5(coalesce(p.response, '')) AS response_md5 FROM members JOIN ({b.DOCUMENT_PAIRS}) p USING (idx)""",
)
def score_and_tier_rows(spark, sf):
    """The whole scoring job over the documents: the rows that it saved by tier and split."""
    path = scratch_path(spark, "job")
    jobs.score_and_tier(b.document_pairs(spark, sf), "idx", path, TIERS)
    saved = spark.read.parquet(f"{path}/tiers")
    return saved.select(
        "tier", "split", "idx", "quality_score", F.col("quality_components.clarity").alias("clarity"), F.md5("response").alias("response_md5")
    )


ORDER_TIERS = {"ultra_high": 150, "high": 1500, "medium": 12000}


@query(
    "cutoff_scores",
    f"""WITH r AS (SELECT score, row_number() OVER (ORDER BY score DESC, idx) AS rank FROM ({ORDERS}) t)
 SELECT tier, {r6('score')} AS score, rank FROM r JOIN (VALUES {", ".join(f"('{n}', {s})" for n, s in ORDER_TIERS.items())}) v(tier, size) ON rank = size+1""",
)
def cutoff_scores(spark, sf):
    """The first score outside each tier."""
    return ranking.cutoff_scores(ranking.score_ranks(order_scores(spark, sf)), ORDER_TIERS)


@query(
    "bottom_tier",
    f"""SELECT 'low' AS tier, idx, {r6('score')} AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY score, idx) AS rank FROM ({ORDERS}) t) u WHERE rank <= 3000""",
)
def bottom_tier(spark, sf):
    """The lowest scores."""
    return ranking.nested_tiers(order_scores(spark, sf), {"low": 3000}, ascending=True)


def _bins_sql(source: str, value: str, n: int) -> str:
    probs = "[" + ",".join(f"{i / n}e0" if i not in (0, n) else f"{i // n}.0e0" for i in range(n + 1)) + "]"
    inner = " + ".join(f"({value} > q[{i + 1}])::INT" for i in range(1, n))
    names = "[" + ",".join(f"'bin_{i + 1}_q{100 * i // n}-{100 * (i + 1) // n}'" for i in range(n)) + "]"
    return f"""lim AS (SELECT quantile_cont({value}, {probs}) AS q FROM {source}),
 binned AS (SELECT *, names[bin] AS bin_name, q[bin] AS min_score, q[bin+1] AS max_score FROM (
 SELECT s.*, q, {names} AS names, 1 + {inner} AS bin FROM {source} s, lim) x)"""


@query(
    "quantile_bins",
    f"WITH {DOC_SCORED}, {_bins_sql('scored', 'score', 5)} SELECT idx, bin::BIGINT AS bin, bin_name, {r6('min_score')} AS min_score, {r6('max_score')} AS max_score FROM binned",
)
def quantile_bins(spark, sf):
    """Five quantile bins of the quality score."""
    rows = flat(scored_documents(spark, sf)).select("idx", "score")
    return ranking.quantile_bins(rows, "score", 5).drop("score")


@query(
    "price_bins",
    f"""WITH o AS ({ORDERS}), {_bins_sql('o', 'score', 10)} SELECT bin::BIGINT AS bin, bin_name, count(*) AS num_samples,
 {r6('avg(score)')} AS mean_quality_score, {r6('min(min_score)')} AS min_score, {r6('max(max_score)')} AS max_score FROM binned GROUP BY bin, bin_name""",
)
def price_bins(spark, sf):
    """Ten bins over the orders table."""
    return ranking.bin_metrics(ranking.quantile_bins(order_scores(spark, sf), "score", 10), "score")


BIN_INPUT = f"""WITH {DOC_SCORED}, {_bins_sql('scored', 'score', 5)},
 docs AS (SELECT doc_id AS idx, text, n_chars, {b.words('text')} AS w FROM documents),
 ppl AS (SELECT binned.*, exp((n_chars % 700)/100e0) AS ppl, list_unique(w)::DOUBLE/nullif(len(w),0) AS div, CASE WHEN {b.strip('text')}<>'' THEN
  CASE WHEN {b.proper('text')} THEN 1e0 ELSE 0.5e0 END END AS coh, len(w) AS n_words FROM binned JOIN docs USING (idx)),
 per_bin AS (SELECT bin, bin_name, count(*) AS num_samples, avg(score) AS mean_quality_score, min(min_score) AS min_score, max(max_score) AS max_score,
  avg(ppl) AS perplexity, avg(div) AS generation_diversity, avg(coh) AS generation_coherence, avg(n_words) AS avg_response_length FROM ppl GROUP BY bin, bin_name)"""


def _bin_metrics(spark, sf):
    from corpusmill.functions import features as ft

    scores = flat(scored_documents(spark, sf)).select("idx", "score")
    t = F.col("text")
    outputs = b.documents(spark, sf).select(
        F.col("doc_id").alias("idx"),
        F.exp((F.col("n_chars") % 700) / 100).alias("ppl"),
        ft.generation_coherence(t).alias("coh"),
        tx.words(t).alias("w"),
    ).select("idx", "ppl", "coh", ft.generation_diversity(F.col("w")).alias("div"), F.size("w").alias("n_words"))
    binned = ranking.quantile_bins(scores, "score", 5).join(outputs, "idx")
    return ranking.bin_metrics(
        binned,
        "score",
        [
            F.avg("ppl").alias("perplexity"),
            F.avg("div").alias("generation_diversity"),
            F.avg("coh").alias("generation_coherence"),
            F.avg("n_words").alias("avg_response_length"),
        ],
    )


@query(
    "bin_metrics",
    f"""{BIN_INPUT} SELECT bin::BIGINT AS bin, bin_name, num_samples, {", ".join(f"{r6(c)} AS {c}" for c in
 ("mean_quality_score", "min_score", "max_score", "perplexity", "generation_diversity", "generation_coherence", "avg_response_length"))} FROM per_bin""",
)
def bin_metrics(spark, sf):
    """Metrics per quality bin."""
    return _bin_metrics(spark, sf)


@query(
    "single_bin",
    "SELECT 1::BIGINT AS bin, 'all' AS bin_name, count(*) AS num_samples, 0e0 AS min_score, 1e0 AS max_score FROM documents",
)
def single_bin(spark, sf):
    """The bin of a table without scores."""
    rows = ranking.single_bin(b.documents(spark, sf).withColumn("score", F.lit(None).cast("double")))
    return ranking.bin_metrics(rows, "score").drop("mean_quality_score")


@query(
    "weighted_bin_means",
    f"""{BIN_INPUT} SELECT {", ".join(f"{r6(f'sum({m}*num_samples)/sum(CASE WHEN {m} IS NOT NULL THEN num_samples END)')} AS weighted_avg_{m}" for m in ("perplexity", "generation_diversity", "generation_coherence"))},
 {r6('sum(mean_quality_score*num_samples)/sum(num_samples)')} AS quality_mean,
 {r6('sqrt(sum(num_samples*(mean_quality_score-mu)**2)/sum(num_samples))')} AS quality_std
 FROM per_bin, (SELECT sum(mean_quality_score*num_samples)/sum(num_samples) AS mu FROM per_bin) m""",
)
def weighted_bin_means(spark, sf):
    """Row-weighted means over the bins and the spread of the bin scores."""
    return stats.weighted_bins(_bin_metrics(spark, sf), ["perplexity", "generation_diversity", "generation_coherence"])


# --- statistics over scores ------------------------------------------------------------------------
def _summary_sql(source: str, columns) -> str:
    cuts = ", ".join(f"{r6(f'quantile_cont(v, {p / 100}e0)')} AS p{p}" for p in fixed.SUMMARY_PERCENTILES)
    one = f"count(v) AS n, {r6('avg(v)')} AS mean, {r6('stddev_pop(v)')} AS std, {r6('min(v)')} AS min, {r6('max(v)')} AS max, {r6('median(v)')} AS median, {cuts}"
    return " UNION ALL ".join(f"SELECT '{c}' AS metric, {one} FROM (SELECT {c}::DOUBLE AS v FROM {source}) t" for c in columns)


@query("score_summary", f"WITH {DOC_SCORED} {_summary_sql('scored', ['score', *PARTS])}")
def score_summary(spark, sf):
    """Moments and percentiles of the total and each dimension."""
    return stats.summary(flat(scored_documents(spark, sf)), ["score", *PARTS], fixed.SUMMARY_PERCENTILES)


LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("lineitem_summary", _summary_sql("lineitem", LINE_COLUMNS))
def lineitem_summary(spark, sf):
    """The same summary at volume."""
    return stats.summary(b.table(spark, sf, "lineitem"), LINE_COLUMNS, fixed.SUMMARY_PERCENTILES)


def _hist_sql(source: str, value: str, n: int, by: str) -> str:
    return f"""SELECT tier, bin, sum(c)::BIGINT AS n, {r6('min(lo)+bin*min(w)')} AS low FROM (
 SELECT tier, lo, (hi-lo)/{n} AS w, c, least(CASE WHEN hi=lo THEN 0 ELSE floor((v-lo)/((hi-lo)/{n}))::BIGINT END, {n - 1}) AS bin FROM (
 SELECT {by} AS tier, {value} AS v, 1 AS c, min({value}) OVER (PARTITION BY {by}) AS lo, max({value}) OVER (PARTITION BY {by}) AS hi FROM {source}) a) b GROUP BY tier, bin"""


@query("score_histogram", f"WITH {DOC_SCORED}, {TIER_SQL} {_hist_sql('members', 'score', 50, 'tier')}")
def score_histogram(spark, sf):
    """Fifty equal-width cells per tier."""
    members = ranking.nested_tiers(scored_documents(spark, sf).select("idx", "score"), TIERS)
    return stats.width_histogram(members, "score", 50, ["tier"])


@query("price_histogram", _hist_sql("lineitem", "l_extendedprice", 30, "'all'").replace("SELECT tier, bin, sum", "SELECT bin, sum", 1))
def price_histogram(spark, sf):
    """Thirty equal-width cells over a whole table."""
    return stats.width_histogram(b.table(spark, sf, "lineitem"), "l_extendedprice", 30)


def _matrix_sql(source: str, columns) -> str:
    cells = []
    for a in columns:
        for c in columns:
            r = "max(1e0)" if a == c else r6(f"CASE WHEN stddev_pop({a})>0 AND stddev_pop({c})>0 THEN corr({a},{c}) END")
            cells.append(f'SELECT \'{a}\' AS "left", \'{c}\' AS "right", {r} AS r FROM {source}')
    return " UNION ALL ".join(cells)


@query("component_correlation", f"WITH {DOC_SCORED} {_matrix_sql('scored', PARTS)}")
def component_correlation(spark, sf):
    """Correlation matrix of the four dimensions."""
    return stats.correlation_matrix(flat(scored_documents(spark, sf)), PARTS)


GOLD = f"""WITH {DOC_SCORED}, gold AS (SELECT score, quality FROM scored JOIN labels ON doc_id=idx),
 rk AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score)-1)/2e0 AS rs,
  rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality)-1)/2e0 AS rq FROM gold)"""


def _gold(spark, sf):
    scores = scored_documents(spark, sf).select(F.col("idx").alias("doc_id"), "score")
    return keep(scores.join(b.table(spark, sf, "labels"), "doc_id").select("doc_id", "score", "quality", "toxic"), "gold")


@query(
    "gold_correlation",
    f"""{GOLD} SELECT count(*) AS n, {r6('corr(score, quality)')} AS pearson_r, {r6('corr(rs, rq)')} AS spearman_r FROM rk""",
)
def gold_correlation(spark, sf):
    """Pearson and Spearman correlation of the score with the gold labels."""
    return stats.correlations(_gold(spark, sf), "score", "quality").select("n", "pearson_r", "spearman_r")


def _p_sql(r: str) -> str:
    """The share of cos(t) ** (n - 3) between asin |r| and a right angle, by Simpson's rule."""
    steps = 20000

    def area(low: str) -> str:
        width = f"((pi()/2 - {low})/{steps})"
        weight = f"CASE WHEN k IN (0, {steps}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
        return f"{width}*list_sum([({weight})*pow(greatest(cos({low} + k*{width}), 0), n - 3) FOR k IN range({steps + 1})])"

    return f"{area(f'asin(abs({r}))')}/({area('0e0')})"


@query(
    "gold_correlation_p_values",
    f"""{GOLD}, row AS (SELECT count(*) AS n, corr(score, quality) AS pearson_r, corr(rs, rq) AS spearman_r FROM rk)
 SELECT n, {r6('pearson_r')} AS pearson_r, {r6(_p_sql('pearson_r'))} AS pearson_p, {r6('spearman_r')} AS spearman_r, {r6(_p_sql('spearman_r'))} AS spearman_p FROM row""",
)
def gold_correlation_p_values(spark, sf):
    """The same with two-sided p-values."""
    return stats.correlations(_gold(spark, sf), "score", "quality")


@query(
    "price_rank_correlation",
    f"""SELECT count(*) AS n, {r6('corr(x, y)')} AS pearson_r, {r6('corr(rx, ry)')} AS spearman_r FROM (SELECT x, y,
 rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x)-1)/2e0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y)-1)/2e0 AS ry
 FROM (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem) a) t""",
)
def price_rank_correlation(spark, sf):
    """Correlations at volume; the quantity has few values, each with many ties."""
    return stats.correlations(b.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select("n", "pearson_r", "spearman_r")


@query("score_matrix", f"WITH {DOC_SCORED}, j AS (SELECT scored.*, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM scored JOIN labels ON doc_id=idx) {_matrix_sql('j', ['score', 'quality', 'toxic'])}")
def score_matrix(spark, sf):
    """Correlations across scores and labels."""
    return stats.correlation_matrix(_gold(spark, sf), ["score", "quality", "toxic"])


@query(
    "linear_fit",
    f"""WITH {DOC_SCORED} SELECT {r6('regr_slope(y, score)')} AS slope, {r6('regr_intercept(y, score)')} AS intercept, {r6('corr(score, y)')} AS r
 FROM (SELECT score, ln(n_chars+1) AS y FROM scored JOIN documents ON doc_id=idx) t""",
)
def linear_fit(spark, sf):
    """Least-squares fit of log length on the score."""
    scores = scored_documents(spark, sf).select(F.col("idx").alias("doc_id"), "score")
    rows = scores.join(b.documents(spark, sf).select("doc_id", F.log(F.col("n_chars") + 1).alias("y")), "doc_id")
    return stats.linear_fit(rows, "score", "y")


@query("mean_quality", f"WITH {CHAT_SCORED} SELECT {r6('coalesce(avg(score),0)')} AS mean_score FROM scored")
def mean_quality(spark, sf):
    """Mean score of a table."""
    return stats.mean_quality(quality.score_pairs(b.chat_pairs(spark, sf)), "score")

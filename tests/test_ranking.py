"""Ranks, tiers, quantiles, bins and correlations, with ties and a hot value."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import ranking, stats

draw = random.Random(3)
# a third of the rows share one score
VALUES = [0.5 if i % 3 == 0 else round(draw.random(), 2) for i in range(900)]


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(list(enumerate(VALUES)), "idx bigint, score double").repartition(5)


ORDER = sorted(range(len(VALUES)), key=lambda i: (-VALUES[i], i))


def test_rank_with_hot_score(scores):
    got = {r.idx: r.rank for r in ranking.score_ranks(scores).collect()}
    assert got == {i: k + 1 for k, i in enumerate(ORDER)}


def test_rank_in_groups(scores):
    rows = scores.withColumn("g", F.when(F.col("idx") < 600, "hot").otherwise(F.col("idx").cast("string")))
    got = {r.idx: r.rank for r in ranking.rank_rows(rows, [F.col("score").desc(), F.col("idx").asc()], ["g"]).collect()}
    hot = [i for i in ORDER if i < 600]
    assert all(got[i] == k + 1 for k, i in enumerate(hot))
    assert all(got[i] == 1 for i in range(600, 900))


@pytest.mark.parametrize("n", [1, 50, 299, 300, 301, 900, 5000])
def test_top_ranked(scores, n):
    got = [r.idx for r in ranking.top_ranked(scores, n).orderBy("rank").collect()]
    assert got == ORDER[:n]


def test_bottom(scores):
    got = [r.idx for r in ranking.top_ranked(scores, 70, ascending=True).orderBy("rank").collect()]
    assert got == sorted(range(len(VALUES)), key=lambda i: (VALUES[i], i))[:70]


def test_tiers_are_nested(scores):
    members = ranking.nested_tiers(scores, {"a": 10, "b": 100, "c": 10_000}).collect()
    sets = {t: {m.idx for m in members if m.tier == t} for t in "abc"}
    assert sets["a"] < sets["b"] < sets["c"]
    assert [len(sets[t]) for t in "abc"] == [10, 100, 900]


def test_constant_score(spark):
    rows = spark.range(20).select(F.col("id").alias("idx"), F.lit(1.0).alias("score"))
    assert [r.idx for r in ranking.top_ranked(rows, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert {r.bin for r in ranking.quantile_bins(rows, "score", 4).collect()} == {1}


def test_quantiles_are_numpys(scores):
    probs = [0.0, 0.25, 0.333, 0.5, 0.9, 0.99, 1.0]
    row = ranking.quantiles(scores, "score", probs).first()
    assert list(row) == pytest.approx(list(np.percentile(VALUES, [100 * p for p in probs])))


def test_cells_rise_with_the_values(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.standard_normal(3000) * 10.0 ** rng.integers(-300, 300, 3000), 2.0 ** np.arange(-1000, 1000), [0.0, -0.0, 5e-324, 1.7e308, np.inf]])
    values = np.concatenate([values, -values, np.nextafter(values, np.inf)])
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", ranking.value_cell(F.col("v")).alias("c")).collect()
    ordered = sorted((r.v, r.c) for r in rows)
    assert all(a[1] <= b[1] for a, b in zip(ordered, ordered[1:]))
    assert spark.sql("SELECT double('nan') AS v").select(ranking.value_cell(F.col("v"))).first()[0] > ordered[-1][1]


@pytest.mark.parametrize("columns", [1, 4])
def test_summary_reads_its_input_twice(spark, columns):
    rng = np.random.default_rng(columns)
    table = [rng.standard_normal(900) * 100, rng.integers(0, 5, 900), np.exp(rng.standard_normal(900) * 9), np.full(900, 7.25)][:columns]
    names = ["a", "b", "c", "d"][:columns]
    rows = spark.createDataFrame([tuple(float(x) for x in r) for r in zip(*table)], ", ".join(f"{n} double" for n in names))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    found = {r.metric: r for r in stats.summary(rows.mapInArrow(counted, rows.schema), names, (25, 99)).collect()}
    assert seen.value == 2 * 900
    for name, values in zip(names, table):
        r = found[name]
        expected = (values.mean(), values.std(), values.min(), values.max(), *np.percentile(values, [50, 25, 99]))
        assert r.n == 900 and (r.mean, r.std, r.min, r.max, r.median, r.p25, r.p99) == pytest.approx(expected)


def test_summary_of_nothing(spark):
    rows = spark.createDataFrame([(None, 1.0)], "a double, b double")
    found = {r.metric: r for r in stats.summary(rows, ["a", "b"]).collect()}
    assert (found["a"].n, found["a"].mean, found["a"].median) == (0, None, None)
    assert (found["b"].n, found["b"].std, found["b"].median) == (1, 0.0, 1.0)


def test_approximate_quantiles_are_close(scores):
    row = ranking.quantiles(scores, "score", [0.25, 0.75], approximate=True).first()
    assert list(row) == pytest.approx(list(np.percentile(VALUES, [25, 75])), abs=0.02)


def test_bins_partition_the_rows(scores):
    binned = ranking.quantile_bins(scores, "score", 5).collect()
    bounds = np.percentile(VALUES, [0, 20, 40, 60, 80, 100])
    assert len(binned) == len(VALUES)
    for r in binned:
        low_ok = r.score >= bounds[0] if r.bin == 1 else r.score > bounds[r.bin - 1]
        assert low_ok and r.score <= bounds[r.bin]


def test_empty_bins_input(spark):
    empty = spark.createDataFrame([], "idx bigint, score double")
    assert ranking.quantile_bins(empty, "score", 5).count() == 0
    assert stats.mean_quality(empty, "score").first()[0] == 0.0


def test_edges(spark):
    rows = spark.createDataFrame([(v,) for v in (0, 255, 256, 8192, 8193)], "n int")
    got = [(r.low, r.n, round(r.percent, 6)) for r in stats.edge_histogram(rows, "n").orderBy("low").collect()]
    assert got == [(0, 2, 40.0), (256, 1, 20.0), (512, 0, 0.0), (1024, 0, 0.0), (2048, 0, 0.0), (4096, 1, 20.0)]


def test_correlations_and_p(spark):
    xs = [float(i % 7) for i in range(60)]
    ys = [x * 2 + (i % 5) for i, x in enumerate(xs)]
    row = stats.correlations(spark.createDataFrame(list(zip(xs, ys)), "x double, y double"), "x", "y").first()
    assert row.pearson_r == pytest.approx(np.corrcoef(xs, ys)[0, 1])

    def ranks(v):
        s = sorted(v)
        return [np.mean([k + 1 for k, w in enumerate(s) if w == u]) for u in v]

    assert row.spearman_r == pytest.approx(np.corrcoef(ranks(xs), ranks(ys))[0, 1])
    assert 0.0 <= row.pearson_p < 1e-20


def p_by_integral(r, n):
    """The share of cos(t) ** (n - 3) between asin |r| and a right angle, by Gauss-Legendre quadrature."""
    nodes, weights = np.polynomial.legendre.leggauss(400)

    def area(low):
        high = math.pi / 2
        t = low + (high - low) * (nodes + 1) / 2
        return (weights * np.cos(t) ** (n - 3)).sum() * (high - low)

    return area(math.asin(abs(r))) / area(0.0)


def test_p_values(spark):
    # two-sided 5 % points of Student's t: 2.228 at 10, 2.042 at 30 degrees of freedom
    listed = [(t / math.sqrt(df + t * t), df + 2, 0.05) for df, t in ((10, 2.228139), (30, 2.042272))]
    listed += [(0.0, 20, 1.0), (1.0, 20, 0.0), (-1.0, 3, 0.0), (1.0000001, 9, 0.0), (None, 20, None), (float("nan"), 20, None), (0.5, 2, None)]
    listed += [(r, n, p_by_integral(r, n)) for n in (3, 4, 5, 10, 57, 400, 3000) for r in (-0.999, -0.6, -0.2, 0.01, 0.05, 0.3, 0.8)]
    listed += [(0.002, 10**6, 0.0455), (1e-4, 10**8, 0.317311)]
    rows = spark.createDataFrame([(i, r, n) for i, (r, n, _) in enumerate(listed)], "i int, r double, n bigint").coalesce(1)
    found = [x.p for x in rows.select("i", stats.correlation_p_value(F.col("r"), F.col("n")).alias("p")).orderBy("i").collect()]
    for p, (r, n, expected) in zip(found, listed):
        assert (p is None) == (expected is None), (r, n)
        assert p is None or p == pytest.approx(expected, rel=1e-6, abs=1e-6 if n < 10**5 else 1e-4), (r, n)
    plan = rows.select(stats.correlation_p_value(F.col("r"), F.col("n")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_ranks_of_all_columns_at_once(spark):
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 6, 500).astype(float), np.round(rng.standard_normal(500), 1)
    rows = [(float(a), float(b) if i % 50 else None) for i, (a, b) in enumerate(zip(x, y))]
    kept = [(a, b) for a, b in rows if b is not None]
    row = stats.correlations(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()

    def ranks(v):
        s = np.sort(v)
        return (np.searchsorted(s, v, "left") + np.searchsorted(s, v, "right") + 1) / 2

    a, b = np.array(kept).T
    assert row.n == len(kept) and row.spearman_r == pytest.approx(np.corrcoef(ranks(a), ranks(b))[0, 1])
    assert row.spearman_p == pytest.approx(p_by_integral(row.spearman_r, row.n), rel=1e-6)
    assert stats.correlations(spark.createDataFrame([], "x double, y double"), "x", "y").first().n == 0


def test_constant_column_has_no_correlation(spark):
    rows = spark.range(10).select(F.lit(1.0).alias("x"), F.col("id").cast("double").alias("y"))
    assert stats.correlations(rows, "x", "y").first().pearson_r is None
    assert stats.linear_fit(rows, "x", "y").first().slope is None


def test_losses(spark):
    rows = spark.createDataFrame([(1.0, 2), (2.0, 2)], "loss double, n_tokens bigint")
    assert stats.token_perplexity(rows).first()[0] == pytest.approx(math.exp(1.5))
    assert stats.token_perplexity(rows.limit(0)).first()[0] == math.inf
    mixed = spark.createDataFrame([("a", float("nan")), ("a", float("inf")), ("a", 1.0)], "g string, loss double")
    row = stats.perplexity_summary(mixed, ["g"]).first()
    assert (row.n, row.perplexity, row.perplexity_median) == (1, pytest.approx(math.e), pytest.approx(math.e))


def _scored(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "idx bigint, score double")


def test_top_ranked_leaves_out_missing_scores_only(spark):
    values = [None if i % 2 else float(i) for i in range(1000)]
    rows = ranking.top_ranked(_scored(spark, values), 100).orderBy("rank").collect()
    assert [r.score for r in rows] == sorted((v for v in values if v is not None), reverse=True)[:100]
    members = ranking.nested_tiers(_scored(spark, values), {"a": 10, "b": 600}).groupBy("tier").count()
    assert {r.tier: r["count"] for r in members.collect()} == {"a": 10, "b": 500}


def test_top_ranked_orders_infinite_scores_and_drops_nan(spark):
    values = [1.0, float("nan"), float("inf"), float("-inf"), None, 2.0, 3.0]
    best = [r.score for r in ranking.top_ranked(_scored(spark, values), 3).orderBy("rank").collect()]
    assert best == [float("inf"), 3.0, 2.0]
    worst = [r.score for r in ranking.top_ranked(_scored(spark, values), 2, ascending=True).orderBy("rank").collect()]
    assert worst == [float("-inf"), 1.0]


def test_top_ranked_constant_and_few(spark):
    assert ranking.top_ranked(_scored(spark, [5.0, None, 5.0]), 10).count() == 2
    assert ranking.top_ranked(_scored(spark, [None, None]), 1).count() == 0


def test_bin_names_scale_the_step():
    linear = [int(100 * 29 / 100), int(29 * (100 / 100))]
    assert ranking._percent(29, 100) == linear[1] == 29
    assert [ranking._percent(i, 50) for i in (0, 29, 50)] == [0, 58, 100]


def test_comparable_keeps_what_rounding_would_change(spark):
    from corpusmill.catalog.base import comparable

    rows = comparable(_scored(spark, [float("inf"), 1e14, 0.1234567, None])).orderBy("idx").collect()
    assert [r.score for r in rows] == [float("inf"), 1e14, 0.123457, None]

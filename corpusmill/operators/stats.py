"""Aggregates: summaries, histograms, rates, correlations, fits and perplexities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.operators.ranking import cell_counts, quantiles, quantiles_in_cells, running_totals
from corpusmill.session import keep


def melt(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Long form: ids, ``metric``, ``value``."""
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(list(ids), list(columns), "metric", "value")


def summary(
    df: DataFrame,
    columns: Sequence[str],
    percentiles: Sequence[int] = (),
    approximate: bool = False,
) -> DataFrame:
    """One row per column: count, mean, population std, min, max, median and percentiles ``p25`` …

    Two passes over ``df`` for any number of columns: cells with their counts and moments, then the values in the
    cells that hold a wanted position. One pass if ``approximate``.
    """
    probs, names = [0.5, *[p / 100 for p in percentiles]], ["median", *[f"p{p}" for p in percentiles]]
    long = melt(df, columns)
    if approximate:
        row = long.groupBy("metric").agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.percentile_approx("value", probs, 100_000).alias("_q"),
        )
        return row.select("*", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)]).drop("_q")
    long = long.withColumnRenamed("value", "_v")
    cells = cell_counts(long, ["metric"])
    n, mean = F.sum("_rows"), F.try_divide(F.sum("_sum"), F.sum("_rows"))
    whole = cells.groupBy("metric").agg(n.alias("n"), mean.alias("mean"), F.min("_lo").alias("min"), F.max("_hi").alias("max"))
    # Spread inside the cells and of the cells around the mean: no difference of large squares.
    apart = F.col("_m2") + F.col("_rows") * F.pow(F.col("_sum") / F.col("_rows") - F.col("mean"), F.lit(2.0))
    spread = cells.join(F.broadcast(whole), "metric").groupBy("metric").agg(F.sqrt(F.sum(apart) / F.first("n")).alias("std"))
    every = cells.sparkSession.createDataFrame([(c,) for c in columns], "metric string")
    moments = every.join(F.broadcast(whole), "metric", "left").join(F.broadcast(spread), "metric", "left")
    cuts = quantiles_in_cells(long, cells, probs, ["metric"], groups=len(columns))
    cuts = cuts.select("metric", *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])
    order = ["metric", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std", "min", "max", *names]
    return moments.join(F.broadcast(cuts), "metric", "left").select(*order)


def edge_histogram(df: DataFrame, value: str, edges: Sequence[float] = fixed.LENGTH_EDGES) -> DataFrame:
    """Rows per ``[low, high)`` interval, the last one closed, with the percentage of all rows.

    Values outside the edges are in no interval but count in the denominator; intervals without rows
    are listed with 0. A single aggregation of fixed width.
    """
    pairs = list(zip(edges[:-1], edges[1:]))
    inside = []
    for i, (low, high) in enumerate(pairs):
        below = F.col(value) <= high if i == len(pairs) - 1 else F.col(value) < high
        inside.append(F.count_if((F.col(value) >= low) & below))
    totals = df.agg(F.count("*").alias("_n"), F.array(*inside).alias("_c"))
    cells = totals.select("_n", F.posexplode("_c").alias("_i", "n"))
    return cells.select(
        F.element_at(F.lit(list(edges)), F.col("_i") + 1).alias("low"),
        F.element_at(F.lit(list(edges)), F.col("_i") + 2).alias("high"),
        "n",
        F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("_n")), F.lit(0.0)).alias("percent"),
    )


def width_histogram(df: DataFrame, value: str, n_bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram between the minimum and maximum of each group (maximum in the last bin).

    Two passes that each combine before the shuffle: the limits, then the counts. No value is shuffled.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    limits = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if by:
        # Written first: Spark then knows its size and broadcasts it only if it is small.
        spread = rows.join(keep(limits, "limits"), by)
    else:
        limit = limits.select(F.struct("_lo", "_hi").alias("x")).scalar()
        spread = rows.withColumn("_x", limit).select("_v", "_x._lo", "_x._hi")
    width = F.try_divide(F.col("_hi") - F.col("_lo"), F.lit(n_bins))
    place = F.floor(F.try_divide(F.col("_v") - F.col("_lo"), width)).cast("int")
    place = F.least(F.coalesce(place, F.lit(0)), F.lit(n_bins - 1))
    return (
        spread.groupBy(*by, place.alias("bin"))
        .agg(F.count("*").alias("n"), F.min("_lo").alias("_lo"), F.min(width).alias("_w"))
        .select(*by, "bin", "n", (F.col("_lo") + F.col("bin") * F.coalesce("_w", F.lit(0.0))).alias("low"))
    )


def group_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.count("*").alias("count"),
        F.avg(value).alias("avg_length"),
        F.stddev_pop(value).alias("std_length"),
        F.min(value).alias("min_length"),
        F.max(value).alias("max_length"),
    )


def group_rates(df: DataFrame, by: str, flags: Sequence[str]) -> DataFrame:
    """Percentage of rows with each flag."""
    return df.groupBy(by).agg(*[(F.avg(F.col(f).cast("int")) * 100).alias(f) for f in flags])


def metric_stats(df: DataFrame, by: str, metrics: Sequence[str]) -> DataFrame:
    """Per group and metric: mean, std, and ``ratio`` when every value is 0 or 1; NULLs are skipped."""
    return (
        melt(df, metrics, [by])
        .where(F.col("value").isNotNull())
        .groupBy(by, "metric")
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
            F.when(F.bool_and(F.col("value").isin(0.0, 1.0)), F.avg("value")).alias("ratio"),
        )
    )


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def mean_by_rounded(df: DataFrame, key: str, value: str, digits: int = 2) -> DataFrame:
    return df.groupBy(F.round(key, digits).alias(key)).agg(F.avg(value).alias(f"avg_{value}"))


# --- correlation and fit --------------------------------------------------------------------------
def _complete(x: Column, y: Column) -> tuple[Column, Column]:
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def pearson(x: Column, y: Column) -> Column:
    """Correlation aggregate; NULL when either side is constant."""
    a, b = _complete(x.cast("double"), y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def average_ranks(long: DataFrame, groups: int) -> DataFrame:
    """(``column``, ``value``, ``n``, ``from_mean``) of every distinct value of every column of (column, value).

    Equal values share the mean of their ranks, from which the mean rank of the column is taken off. One range shuffle
    of the counted values ranks all columns; ``groups`` is their number.
    """
    counted = keep(long.groupBy("column", "value").agg(F.count("*").alias("n")), "values")
    table = running_totals(counted, [F.col("value").asc()], ["column"], weight="n", groups=groups)
    rank = F.col("_before") + (F.col("n") + 1) / 2 - (F.col("_total") + 1) / 2
    return keep(table.select("column", "value", "n", rank.alias("from_mean")), "ranks")


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: ``n``, Pearson and Spearman coefficient, each with its two-sided p-value.

    ``df`` is read once, for its complete pairs. Both columns are ranked together, and the ranks are joined to the
    distinct pairs; as mean ranks are known, one sum over these gives the coefficient.
    """
    complete = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    complete = keep(complete.where(F.col("_x").isNotNull() & F.col("_y").isNotNull()), "pairs")
    sides = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in ("_x", "_y")]
    ranks = average_ranks(complete.select(F.inline(F.array(*sides))), groups=2)
    joined = complete.groupBy("_x", "_y").agg(F.count("*").alias("_n"))
    for c in ("_x", "_y"):
        own = ranks.where(F.col("column") == c).select(F.col("value").alias(c), F.col("from_mean").alias(f"{c}_d"))
        joined = joined.join(own, c)
    shared = joined.agg(F.sum(F.col("_n") * F.col("_x_d") * F.col("_y_d"))).scalar()
    squares = F.col("n") * F.col("from_mean") * F.col("from_mean")
    spread = [ranks.where(F.col("column") == c).agg(F.sqrt(F.sum(squares))).scalar() for c in ("_x", "_y")]
    row = complete.agg(F.count("*").alias("n"), pearson(F.col("_x"), F.col("_y")).alias("pearson_r"))
    row = row.withColumn("spearman_r", F.try_divide(shared, spread[0] * spread[1]))
    return row.select(
        "n",
        "pearson_r",
        correlation_p_value(F.col("pearson_r"), F.col("n")).alias("pearson_p"),
        "spearman_r",
        correlation_p_value(F.col("spearman_r"), F.col("n")).alias("spearman_p"),
    )


#: Steps of the continued fraction; it needs about the root of the number of rows.
FRACTION_STEPS = 2000


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function above zero: ten steps up, then Stirling's series."""
    up = x + 10
    series = 1 / (12 * up) - 1 / (360 * F.pow(up, F.lit(3.0))) + 1 / (1260 * F.pow(up, F.lit(5.0))) - 1 / (1680 * F.pow(up, F.lit(7.0)))
    at_up = (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + series
    for k in range(10):
        at_up = at_up - F.log(x + k)
    return at_up


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function for x up to about (a + 1) / (a + b + 2): its continued fraction by products."""

    def step(state: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        term = F.when(k % 2 == 0, even).otherwise(odd)
        d, c = 1 / (1 + term * state["d"]), 1 + term / state["c"]
        return F.struct(c.alias("c"), d.alias("d"), (state["value"] * c * d).alias("value"))

    one = F.lit(1.0)
    first = F.struct(F.lit(1e300).alias("c"), one.alias("d"), one.alias("value"))  # so that the first c is one
    value = F.aggregate(F.sequence(F.lit(1), F.lit(FRACTION_STEPS)), first, step)["value"]
    front = F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    return front * value / a


def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation: t with n - 2 degrees of freedom; NULL without r or for under three rows.

    Spark expressions over the result row: the incomplete beta function by its continued fraction, on the side where
    that converges.
    """
    missing = r.isNull() | F.isnan(r.cast("double")) | (n < 3)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r.cast("double")))
    a, square = (n.cast("double") - 2) / 2, r * r
    outer = F.when((square < 1) & (n >= 3), 1 - square)
    inner = F.when((square > 0) & (n >= 3), square)
    near = outer <= (a + 1) / (a + 2.5)
    p = F.when(near, _beta_fraction(a, F.lit(0.5), outer)).otherwise(1 - _beta_fraction(F.lit(0.5), a, inner))
    return F.when(missing, None).when(square == 0, 1.0).when(square == 1, 0.0).otherwise(p)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``left``, ``right``, ``r`` for every ordered pair, from one aggregation of the upper triangle."""
    upper = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[pearson(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in upper])
    cells = [
        F.struct(F.lit(p).alias("left"), F.lit(q).alias("right"), F.col(f"{a}|{b}").alias("r"))
        for a, b in upper
        for p, q in ((a, b), (b, a))
    ] + [
        F.struct(F.lit(a).alias("left"), F.lit(a).alias("right"), F.lit(1.0).alias("r")) for a in columns
    ]
    return row.select(F.inline(F.array(*cells)))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares ``slope``, ``intercept`` and ``r``; NULL for constant x."""
    a, b = _complete(F.col(x).cast("double"), F.col(y).cast("double"))
    slope = F.try_divide(F.covar_pop(a, b), F.var_pop(a))
    return df.agg(
        slope.alias("slope"),
        (F.avg(b) - slope * F.avg(a)).alias("intercept"),
        pearson(F.col(x), F.col(y)).alias("r"),
    )


# --- losses ---------------------------------------------------------------------------------------
def finite(value: Column) -> Column:
    """Neither NULL, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def token_perplexity(df: DataFrame, loss: str = "loss", n_tokens: str = "n_tokens") -> DataFrame:
    """exp of the token-weighted mean loss; infinite when there is no token."""
    mean = F.try_divide(F.sum(F.col(loss) * F.col(n_tokens)), F.sum(n_tokens))
    return df.agg(F.coalesce(F.exp(mean), F.lit(float("inf"))).alias("perplexity"))


def perplexity_summary(df: DataFrame, by: Sequence[str], loss: str = "loss", approximate: bool = False) -> DataFrame:
    """Per group mean, std and median of the finite ``exp(loss)``."""
    rows = df.withColumn("_ppl", F.exp(loss)).where(finite(F.col("_ppl")))
    moments = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("_ppl").alias("perplexity"),
        F.stddev_pop("_ppl").alias("perplexity_std"),
    )
    middle = quantiles(rows, "_ppl", [0.5], by, approximate)
    return moments.join(middle.withColumnRenamed("q0", "perplexity_median"), list(by))


def ignored_label_count(labels: Column, ignored: int = -100) -> Column:
    """Labels that count towards the loss."""
    return F.size(F.filter(labels, lambda t: t != ignored))


def weighted_bins(bins: DataFrame, metrics: Sequence[str], weight: str = "num_samples") -> DataFrame:
    """Row-weighted means over bins (bins without the metric skipped) and spread of the bin scores."""
    w = F.col(weight)
    means = [
        F.try_divide(F.sum(F.col(m) * w), F.sum(F.when(F.col(m).isNotNull(), w))).alias(f"weighted_avg_{m}")
        for m in metrics
    ]
    q = F.col("mean_quality_score")
    mean = F.try_divide(F.sum(q * w), F.sum(w))
    square = F.try_divide(F.sum(q * q * w), F.sum(w))
    return bins.agg(
        *means,
        mean.alias("quality_mean"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("quality_std"),
    )


def mean_quality(df: DataFrame, score: str = "quality_score") -> DataFrame:
    """Mean score, 0 for an empty table."""
    return df.agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_score"))

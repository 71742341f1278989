"""Ranks, tiers, quantiles and seeded order, without a window over the whole table.

``row_number`` over an unpartitioned (or a hot) window sends every row to one task. Here rows are
range-partitioned on the full sort key, sorted inside the partitions and stored; the rank is the
position in the partition plus the number of rows in the partitions before. Because the sort key ends
in the row id, a value shared by a third of all rows is still cut over many partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.functions.text import seeded_key
from corpusmill.session import keep

_POSITION_BITS = 33  # monotonically_increasing_id: partition above, row position below
PRUNE_CELLS = 4096
CELLS_PER_OCTAVE = 64
_OCTAVES = 1 << 20  # more than all cells between the smallest and the largest value
BROADCAST_ROWS = 100_000
_HASH_SHIFT = 20  # 32-bit hash -> 4096 cells


def small_side(df: DataFrame, rows: int | None, name: str) -> DataFrame:
    """The small side of a join: broadcast when a bound of its rows is known and low; otherwise written
    first, so that Spark knows its size and broadcasts it only if it is small."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else keep(df, name)


def _most_partitions(spark) -> int:
    """How many partitions a range shuffle can have at most under the session's settings."""
    initial = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(initial or 0))


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    weight: str | None = None,
    groups: int | None = None,
) -> DataFrame:
    """Add ``_before`` (rows, or sum of ``weight``, sorted earlier in the group) and ``_total``.

    One range shuffle and one written table. ``order`` must decide every tie. ``groups`` is a bound of
    the number of groups where the caller knows one.
    """
    by = list(by)
    if not by:
        groups = 1
    keys = [F.col(k) for k in by]
    placed = keep(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", _POSITION_BITS)),
        "ranged",
    )
    amount = F.col(weight) if weight else F.lit(1)
    # At most one row per partition and group boundary: partitions + groups rows in all.
    cells = placed.groupBy("_part", *by).agg(
        F.sum(amount).alias("_cell"), F.min("_at").alias("_first")
    )
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "_part",
        *by,
        "_first",
        F.coalesce(F.sum("_cell").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_cell").over(group).alias("_total"),
    )
    bound = None if groups is None else _most_partitions(df.sparkSession) + groups
    joined = placed.join(small_side(cells, bound, "cells"), ["_part", *by])
    if weight:
        inside = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        here = F.coalesce(F.sum(weight).over(inside), F.lit(0))
    else:
        here = F.col("_at") - F.col("_first")
    return joined.withColumn("_before", F.col("_offset") + here).select(*df.columns, "_before", "_total")


def rank_rows(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """1-based rank of every row in its group. Pass narrow rows: sort key and id only."""
    return running_totals(df, order, by).select(*df.columns, (F.col("_before") + 1).alias(name))


def _cells_before_cut(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    running = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("_run", F.sum("_rows").over(running))


def prune_to_first(df: DataFrame, score: str, n: int, ascending: bool = False) -> DataFrame:
    """Drop rows that cannot be among the first ``n`` by ``score``; keeps all that can.

    NULL and NaN scores are unranked and dropped. Counts rows in equal-width cells of the finite scores (a fixed
    number of them, infinite ones before and after) and keeps the cells up to the one that completes ``n`` rows, so
    that only little more than ``n`` rows are ranked afterwards.
    """
    value = F.col(score).cast("double")
    df = df.where(value.isNotNull() & ~F.isnan(value))
    finite = F.when(F.abs(value) < float("inf"), value)
    low, high = df.agg(F.min(finite), F.max(finite)).first()
    if low is None or low == high:
        return df
    share = (value - F.lit(low)) / F.lit(high - low)
    first = float("-inf") if ascending else float("inf")
    cell = (
        F.when(value == first, -1)
        .when(value == -first, PRUNE_CELLS + 1)
        .otherwise(F.floor((share if ascending else F.lit(1.0) - share) * PRUNE_CELLS).cast("int"))
    )
    counts = df.groupBy(cell.alias("_cell")).agg(F.count("*").alias("_rows"))
    cut = _cells_before_cut(counts, ()).where(F.col("_run") >= n).agg(F.min("_cell")).first()[0]
    return df if cut is None else df.where(cell <= cut)


def top_ranked(
    df: DataFrame, n: int, score: str = "score", key: str = "idx", ascending: bool = False
) -> DataFrame:
    """The best ``n`` rows with their ``rank``, ties by key; NULL and NaN scores have none. ``n`` may be millions.

    Rows that cannot reach the top are dropped by a counted score cut before the range shuffle, so
    that the shuffle carries little more than ``n`` rows with whatever columns ``df`` has.
    """
    order = [F.col(score).asc() if ascending else F.col(score).desc(), F.col(key).asc()]
    return rank_rows(prune_to_first(df, score, n, ascending), order).where(F.col("rank") <= n)


def sorted_by_score(df: DataFrame, score: str = "score", key: str = "idx") -> DataFrame:
    """Best first, ties in input order."""
    return df.orderBy(F.col(score).desc(), F.col(key).asc())


def top_k(df: DataFrame, k: int, score: str = "score", key: str = "idx") -> DataFrame:
    """The first ``k`` rows as one ``TakeOrderedAndProject``; for report-sized ``k``."""
    return sorted_by_score(df, score, key).limit(k)


def score_ranks(df: DataFrame, score: str = "score", key: str = "idx") -> DataFrame:
    """Rank of every row by score: the score-versus-rank curve."""
    return rank_rows(df.select(key, score), [F.col(score).desc(), F.col(key).asc()])


def cutoff_scores(ranked: DataFrame, tiers: Mapping[str, int], score: str = "score") -> DataFrame:
    """Score of the first row outside each tier; tiers that hold every row have none."""
    sizes = F.create_map(*[F.lit(v) for name, size in tiers.items() for v in (size + 1, name)])
    return (
        ranked.where(F.col("rank").isin([s + 1 for s in tiers.values()]))
        .select(sizes[F.col("rank").cast("int")].alias("tier"), score, "rank")
    )


def tier_names(tiers: Mapping[str, int], rank: Column) -> Column:
    """Array of the tiers that contain a rank; nested tiers give several names."""
    listed = F.array(*[F.struct(F.lit(n).alias("tier"), F.lit(s).alias("size")) for n, s in tiers.items()])
    return F.transform(F.filter(listed, lambda t: t["size"] >= rank), lambda t: t["tier"])


def nested_tiers(
    df: DataFrame,
    tiers: Mapping[str, int] = fixed.TIER_SIZES,
    score: str = "score",
    key: str = "idx",
    ascending: bool = False,
) -> DataFrame:
    """One row per member and tier: ``tier``, the columns of ``df`` and ``rank``."""
    ranked = top_ranked(df, max(tiers.values()), score, key, ascending)
    return ranked.select(F.explode(tier_names(tiers, F.col("rank"))).alias("tier"), *df.columns, "rank")


def tier_report(members: DataFrame, components: Sequence[str], score: str = "score") -> DataFrame:
    """Per tier: size, mean, spread, range (the minimum is its threshold), median and component stats."""
    stats = [
        F.count("*").alias("total_samples"),
        F.avg(score).alias("mean"),
        F.stddev_pop(score).alias("std"),
        F.min(score).alias("score_threshold"),
        F.max(score).alias("max"),
    ]
    for c in components:
        stats += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    report = members.groupBy("tier").agg(*stats)
    # Ranks already order the tier, so the median is the mean of its one or two middle rows.
    sized = report.select("tier", F.col("total_samples").alias("_n"))
    middle = (
        members.join(F.broadcast(sized), "tier")
        .where(F.col("rank").isin(F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)))
        .groupBy("tier")
        .agg(F.avg(score).alias("median"))
    )
    return report.join(middle, "tier")


def value_cell(value: Column) -> Column:
    """A cell that does not depend on the data and never falls as the value rises: ``CELLS_PER_OCTAVE`` of equal width
    between powers of two, the same below zero. NaN comes last."""
    size = F.abs(value)
    octave = F.floor(F.log2(F.when(size > 0, size)))
    # Continuous where octaves meet, so that a rounded logarithm does no harm.
    place = F.floor((octave + size / F.pow(F.lit(2.0), octave) - 1) * CELLS_PER_OCTAVE)
    infinite = F.when(size == float("inf"), 2 * _OCTAVES).otherwise(_OCTAVES + place).cast("bigint")
    return F.when(F.isnan(value), 3 * _OCTAVES).when(value == 0, 0).when(value < 0, -infinite).otherwise(infinite).cast("bigint")


def _cell_edge(value: Column) -> Column:
    """The end of the value's cell that is nearer to zero."""
    size = F.abs(value)
    width = F.pow(F.lit(2.0), F.floor(F.log2(F.when(size > 0, size)))) / CELLS_PER_OCTAVE
    inside = F.floor(size / F.when((width > 0) & (size < float("inf")), width)) * width * F.signum(value)
    return F.coalesce(inside, value)


def cell_counts(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, ``_slot``, ``_rows``, ``_lo``, ``_hi``, ``_sum``, ``_m2``) of the values ``_v``: one pass, which combines
    before the shuffle to a few hundred rows for each group and task. Written, as it is read more than once."""
    rows = long.withColumn("_v", F.col("_v").cast("double")).where(F.col("_v").isNotNull())
    # Sums of edges are exact, being few bits long, and what is left is small: the mean is right to the last digit.
    rows = rows.withColumn("_edge", _cell_edge(F.col("_v")))
    return keep(
        rows.groupBy(*by, value_cell(F.col("_v")).alias("_slot")).agg(
            F.count("*").alias("_rows"),
            F.min("_v").alias("_lo"),
            F.max("_v").alias("_hi"),
            (F.sum("_edge") + F.sum(F.when(F.col("_v") != F.col("_edge"), F.col("_v") - F.col("_edge")).otherwise(0.0))).alias("_sum"),
            (F.var_pop("_v") * F.count("*")).alias("_m2"),
        ),
        "cells",
    )


def quantiles_in_cells(
    long: DataFrame, cells: DataFrame, probs: Sequence[float], by: Sequence[str], groups: int | None = None
) -> DataFrame:
    """(by, ``q0``, ``q1``, …) of the values ``_v`` by their counted cells.

    A second pass looks only at the cells that hold a wanted position, those of all groups together; their equal values
    are counted before they are ranked, so that a hot value is one row. ``groups`` bounds the number of groups.
    """
    group = list(by)
    n_wanted = None if groups is None else 2 * len(probs) * groups
    earlier = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    at = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    positions = F.array(*[f(a).cast("bigint") for a in at for f in (F.floor, F.ceil)])
    # At most two cells per group and quantile.
    wanted = (
        cells.withColumn("_skip", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .withColumn("_n", F.sum("_rows").over(Window.partitionBy(*group)))
        .where(F.exists(positions, lambda x: (x >= F.col("_skip")) & (x < F.col("_skip") + F.col("_rows"))))
        .select(*group, "_slot", "_skip", "_n")
    )
    placed = long.withColumn("_v", F.col("_v").cast("double")).where(F.col("_v").isNotNull())
    placed = placed.withColumn("_slot", value_cell(F.col("_v"))).join(small_side(wanted, n_wanted, "wanted"), [*group, "_slot"])
    # Written before it is ranked: a range shuffle reads its input twice.
    counted = keep(placed.groupBy(*group, "_slot", "_skip", "_n", "_v").agg(F.count("*").alias("_w")), "values")
    table = running_totals(counted, [F.col("_v").asc()], [*group, "_slot"], weight="_w", groups=n_wanted)
    first = F.col("_skip") + F.col("_before")

    def value_at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position < first + F.col("_w")), F.col("_v")))

    picked = table.groupBy(*group).agg(
        F.max("_n").alias("_n"),
        *[value_at(F.floor(a)).alias(f"_lo{i}") for i, a in enumerate(at)],
        *[value_at(F.ceil(a)).alias(f"_hi{i}") for i, a in enumerate(at)],
    )
    return picked.select(
        *group,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (a - F.floor(a))).alias(f"q{i}")
            for i, a in enumerate(at)
        ],
    )


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    approximate: bool = False,
    groups: int | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles per group as columns ``q0, q1, …``; NULLs are left out.

    Exact by default, in two passes over ``df``: one counts the rows in cells, one ranks the values in the cells that
    hold a wanted position. ``approximate`` uses ``approx_percentile``, one aggregation with bounded memory.
    """
    by = list(by)
    if approximate:
        present = df.where(F.col(value).isNotNull())
        found = present.groupBy(*by).agg(F.percentile_approx(value, list(probs), 100_000).alias("_q"))
        return found.select(*by, *[F.col("_q")[i].alias(f"q{i}") for i in range(len(probs))])
    group, groups = (by, groups) if by else (["_all"], 1)
    long = df.select(*by, *([] if by else [F.lit(0).alias("_all")]), F.col(value).alias("_v"))
    found = quantiles_in_cells(long, cell_counts(long, group), probs, group, groups)
    return found if by else found.drop("_all")


def _percent(i: int, n_bins: int) -> int:
    """The whole percent at which bin ``i`` starts, cut off after scaling the step and not the share."""
    return 100 if i == n_bins else int(i * (100 / n_bins))


def quantile_bins(df: DataFrame, score: str, n_bins: int, approximate: bool = False) -> DataFrame:
    """Add ``bin`` (1..n), ``bin_name``, ``min_score`` and ``max_score``.

    The first bin includes both ends, the others only the upper; n + 1 bounds come to the driver.
    """
    probs = [i / n_bins for i in range(n_bins + 1)]
    row = quantiles(df, score, probs, approximate=approximate).first()
    if row is None or row[0] is None:
        return df.limit(0).select("*", F.lit(0).alias("bin"), F.lit("").alias("bin_name"),
                                  F.lit(0.0).alias("min_score"), F.lit(0.0).alias("max_score"))
    bounds = [float(v) for v in row]
    number = F.lit(1)
    for bound in bounds[1:-1]:
        number = number + (F.col(score) > bound).cast("int")
    edges = F.array(*[F.lit(b) for b in bounds])
    names = F.array(
        *[F.lit(f"bin_{i + 1}_q{_percent(i, n_bins)}-{_percent(i + 1, n_bins)}") for i in range(n_bins)]
    )
    return (
        df.where(F.col(score).isNotNull())
        .withColumn("bin", number)
        .withColumn("bin_name", F.element_at(names, F.col("bin")))
        .withColumn("min_score", F.element_at(edges, F.col("bin")))
        .withColumn("max_score", F.element_at(edges, F.col("bin") + 1))
    )


def bin_metrics(binned: DataFrame, score: str, metrics: Sequence[Column] = ()) -> DataFrame:
    """Per bin: rows, mean score, range and the given aggregates; empty bins do not appear."""
    return binned.groupBy("bin", "bin_name").agg(
        F.count("*").alias("num_samples"),
        F.avg(score).alias("mean_quality_score"),
        F.min("min_score").alias("min_score"),
        F.max("max_score").alias("max_score"),
        *metrics,
    )


def single_bin(df: DataFrame) -> DataFrame:
    """The bin of a table without scores: everything in ``all``."""
    return df.withColumns(
        {"bin": F.lit(1), "bin_name": F.lit("all"), "min_score": F.lit(0.0), "max_score": F.lit(1.0)}
    )


def nth_rows(
    df: DataFrame, by: str, key: str, place: Column, cell: Column, needs: Mapping[str, Sequence[int]]
) -> dict[tuple[str, int], tuple[int, int]]:
    """(group, n) -> (place, key) of the group's n-th row in that order; groups with fewer rows have none.

    Rows are counted in cells; only the cells that hold a requested row are ranked. ``cell`` must not
    decrease with ``place`` and take about 4096 values. What reaches the driver is at most one row per
    requested n.
    """
    spark = df.sparkSession
    needs = {g: sorted({n for n in ns if n > 0}) for g, ns in needs.items()}
    needs = {g: ns for g, ns in needs.items() if ns}
    if not needs:
        return {}
    wanted = F.create_map(*[F.lit(x) for g, ns in needs.items() for x in (g, ns)])
    # Kept as a narrow table, so that the texts (and their formatter) are scanned once here.
    narrow = keep(
        df.where(F.col(by).isin(list(needs))).select(
            by, F.col(key).alias("_key"), place.alias("_place"), cell.cast("bigint").alias("_slot")
        ),
        "places",
    )
    counts = narrow.groupBy(by, "_slot").agg(F.count("*").alias("_rows"))
    running = Window.partitionBy(by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    runs = counts.withColumn("_run", F.sum("_rows").over(running))
    hits = (
        runs.select(by, "_slot", "_rows", "_run", F.explode(wanted[F.col(by)]).alias("_n"))
        .where((F.col("_run") >= F.col("_n")) & (F.col("_run") - F.col("_rows") < F.col("_n")))
        .select(by, "_slot", (F.col("_n") - F.col("_run") + F.col("_rows")).alias("_inside"), "_n")
        .collect()
    )
    if not hits:
        return {}
    group_type = dict(df.dtypes)[by]
    targets = F.broadcast(
        spark.createDataFrame(hits, f"{by} {group_type}, _slot bigint, _inside bigint, _n bigint")
    )
    candidates = narrow.join(targets.select(by, "_slot").distinct(), [by, "_slot"], "left_semi")
    ranked = rank_rows(candidates, [F.col("_place").asc(), F.col("_key").asc()], [by, "_slot"])
    found = ranked.join(targets, [by, "_slot"]).where(F.col("rank") == F.col("_inside"))
    return {(r[by], r["_n"]): (r["_place"], r["_key"]) for r in found.select(by, "_n", "_place", "_key").collect()}


def hash_cell(place: Column) -> Column:
    return F.shiftright(place, _HASH_SHIFT)


def id_cell(df: DataFrame, key: str) -> Column:
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return F.lit(0)
    return F.floor((F.col(key) - low) / F.lit(float(high - low + 1)) * PRUNE_CELLS)


def not_after(place: Column, key: Column, bound: tuple[int, int]) -> Column:
    """Rows up to and including a bound of ``nth_rows``."""
    return (place < bound[0]) | ((place == bound[0]) & (key <= bound[1]))


def _first_by(df: DataFrame, n: int, key: str, place: Column, cell: Column) -> DataFrame:
    bound = nth_rows(df.select(key, F.lit("all").alias("_all")), "_all", key, place, cell, {"all": [n]}).get(("all", n))
    if n <= 0:
        return df.limit(0)
    return df if bound is None else df.where(not_after(place, F.col(key), bound))


def first_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """The first ``n`` rows by a numeric id.

    ``orderBy().limit(n)`` would send n whole rows of every partition to one task; here the n-th id is
    found first and the table is filtered by it.
    """
    return _first_by(df, n, key, F.col(key), id_cell(df, key))


def row_index(df: DataFrame, key: str, by: Sequence[str] = (), name: str = "source_index") -> DataFrame:
    """0-based dense index in id order, per group when ``by`` is given."""
    ranked = rank_rows(df.select(key, *by), [F.col(key).asc()], by, "_rank")
    return ranked.select(key, *by, (F.col("_rank") - 1).alias(name))


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A reproducible random order."""
    return df.orderBy(seeded_key(seed, F.col(key)), F.col(key))


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same for the same seed, in no particular order."""
    place = seeded_key(seed, F.col(key))
    return _first_by(df, n, key, place, hash_cell(place))

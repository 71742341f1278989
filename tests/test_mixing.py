"""Splits, quotas and mixes: invariants and brute force."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import fixed
from corpusmill.operators import mixing

N = 3000


def place(seed, *ids):
    return int(hashlib.md5(":".join(map(str, (seed, *ids))).encode()).hexdigest()[:8], 16)


@pytest.fixture(scope="module")
def rows(spark):
    # one source holds two thirds of the rows; every tenth row is rejected
    return spark.range(N).select(
        F.col("id"),
        F.when(F.col("id") % 3 < 2, "big").otherwise("small").alias("source"),
        F.when(F.col("id") % 10 != 0, F.concat(F.lit("text "), F.col("id"))).alias("text"),
    )


def source_of(i):
    return "big" if i % 3 < 2 else "small"


def test_ratios():
    assert mixing.normalised({"a": 0.5, "b": 0.505}) == {"a": 0.5, "b": 0.505}
    assert mixing.normalised({"a": 0.6, "b": 0.6}) == {"a": 0.5, "b": 0.5}
    assert mixing.quotas({"a": 0.333, "b": 0.667}, 100) == {"a": 33, "b": 66}
    assert all(abs(sum(r.values()) - 1) < 1e-9 for r in fixed.MIX_STRATEGIES.values())


def expected(order, quota_on, quotas):
    out = {}
    for name, n in quotas.items():
        ids = [i for i in range(N) if source_of(i) == name and (quota_on == "raw" or i % 10)]
        ids.sort(key=(lambda i: (place(42, i), i)) if order == "hash" else (lambda i: i))
        out[name] = {i for i in ids[:n] if i % 10}
    return out


@pytest.mark.parametrize("order", ["hash", "id"])
@pytest.mark.parametrize("quota_on", ["accepted", "raw"])
def test_quota_sample(rows, order, quota_on):
    strategies = {"s": {"big": 0.7, "small": 0.3}, "t": {"big": 0.0, "small": 1.0}}
    mixed = mixing.mix(rows, strategies, 1000, "id", quota_on=quota_on, order=order).collect()
    for name, ratios in strategies.items():
        want = expected(order, quota_on, mixing.quotas(ratios, 1000))
        got = {s: {r.id for r in mixed if r.strategy == name and r.source == s} for s in ("big", "small")}
        assert got == want


def test_quota_larger_than_the_source(rows):
    mixed = mixing.mix(rows, {"s": {"big": 0.5, "small": 0.5}}, 100_000, "id")
    assert mixed.count() == N - N // 10


def test_bad_options(rows):
    with pytest.raises(ValueError):
        mixing.mix(rows, {"s": {"big": 1.0}}, 10, "id", quota_on="some")


def test_split_is_disjoint_and_complete(rows):
    split = mixing.with_split(rows, "id")
    counts = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert sum(counts.values()) == N
    assert 0.03 < counts["validation"] / N < 0.07


@pytest.mark.parametrize("share", [0.05, 0.5, 0.0])
def test_exact_split(rows, share):
    got = {r.id for r in mixing.exact_split(rows, "id", validation=share).where("split = 'validation'").collect()}
    order = sorted(range(N), key=lambda i: (place(42, i), i))
    assert got == set(order[: math.ceil(share * N)])


def test_metadata(rows):
    strategies = {"s": {"big": 0.7, "small": 0.3}}
    mixed = mixing.mix(rows, strategies, 1000, "id")
    got = {r.source: (r.quota, r.contributed, r.total_samples) for r in mixing.mix_metadata(mixed, strategies, 1000).collect()}
    assert got == {"big": (700, 700, 1000), "small": (300, 300, 1000)}


def test_leave_one_out(spark):
    got = {(r.removed, r.source): r.ratio for r in mixing.leave_one_out(spark.createDataFrame([("a",), ("b",), ("a",)], "source string")).collect()}
    assert got == {("a", "a"): 0.0, ("a", "b"): 0.33, ("b", "a"): 0.33, ("b", "b"): 0.0}

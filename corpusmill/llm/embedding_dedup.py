"""Near-duplicate vectors: Euclidean p-stable hashing proposes pairs, exact cosines decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import graph, vectors
from corpusmill.llm.words import starts_of
from corpusmill.session import keep

#: Tables, projections per table and width of a quantisation cell. Unit vectors with cosine 0.98 lie 0.2 apart and
#: share a projection's cell with probability 1 - 0.8 * 0.2 / 2 = 0.92, all 16 of a table with 0.263 and so some of
#: 24 tables with 0.9993. Vectors at a right angle share all 16 with 1e-5.
TABLES, PROJECTIONS, WIDTH, SEED = 24, 16, 2.0, 20240229
#: Pairs whose vectors are gathered at once.
AT_ONCE = 1 << 15


def hash_planes(dim: int, tables: int, projections: int, width: float, seed: int):
    """Directions, offsets and odd mixing factors, the same in every task."""
    random = np.random.default_rng([seed, dim])
    planes = random.standard_normal((dim, tables * projections))
    offsets = random.uniform(0, width, tables * projections)
    mix = random.integers(1 << 62, size=(tables, projections), dtype=np.int64) * 2 + 1
    return planes, offsets, mix


def bucket_keys(unit: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """The bucket of each unit vector in each table, as 64-bit keys (rows x tables)."""
    planes, offsets, mix = hash_planes(unit.shape[1], tables, projections, width, seed)
    cells = np.floor((unit @ planes + offsets) / width).astype(np.int64).reshape(len(unit), tables, projections)
    keys = (cells * mix[None]).sum(axis=2) + np.arange(tables)[None]
    return keys ^ (keys >> 29)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_duplicates(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    tables: int = TABLES,
    projections: int = PROJECTIONS,
    width: float = WIDTH,
    seed: int = SEED,
) -> DataFrame:
    """(id, ``n_links``, ``component_id``, ``kept``) of every row.

    Two rows are linked if their labels are equal and not null and the cosine of their vectors, in double precision,
    is at least ``threshold``. ``n_links`` counts the rows linked directly, ``component_id`` is the smallest id
    reachable over links, ``kept`` marks its own row. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without a label, are linked with nothing; vectors of different length never are. Null ids
    and repeated rows stay rows of their own; a null id is nobody's component_id unless there is no other.
    Other columns are not read.

    Equal vectors are compared once and counted as often as they occur. The vectors that share a bucket of a table
    meet in pieces of bounded size; a pair is counted in the first table in which it meets. A piece returns, per
    member, a number of links and one link to the smallest member reached, never the pairs.
    """
    named = rows.select(
        F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).cast("string").alias("label")
    )
    named = named.withColumn("usable", vectors.usable(F.col("vector")) & F.col("label").isNotNull())
    keyed = named.where("usable").withColumn("key", vectors.content_key(F.col("label"), F.col("vector")))
    different = vectors.distinct_vectors(keyed.select("id", "key", "label", "vector"), "key", "vector", "id")
    # A label and a length never meet another: both are part of every bucket key.
    labels = keyed.groupBy("key").agg(F.any_value(F.xxhash64("label", F.size("vector"))).alias("world"))
    nodes = keep(
        different.join(labels, "key").withColumn("place", F.monotonically_increasing_id()), "vectors"
    )

    def meet(batches):
        for batch in batches:
            place, world = batch.column("place").to_numpy(), batch.column("world").to_numpy()
            sizes = batch.column("vector").value_lengths().to_numpy()
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                x = vectors.matrix(batch.column("vector").take(pa.array(own)))
                keys = bucket_keys(_unit(x), tables, projections, width, seed) ^ world[own, None]
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, t]), pa.array(place[own])], names=["bucket", "place"])

    met = nodes.select("place", "world", "vector").mapInArrow(meet, "bucket bigint, place bigint")
    dealt = graph.in_blocks(met, "bucket", "place", nodes.select("place", "world", "copies", "vector"))

    def verify(batches):
        for table, starts in graph.pieces(batches, "bucket"):
            place, copies, world, bucket, i, j, block = (
                table.column(c).to_numpy() for c in ("place", "copies", "world", "bucket", "_i", "_j", "_block")
            )
            n, lists = len(place), table.column("vector").chunk(0)
            sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
            at = starts_of(sizes)
            unit, keys = np.zeros((n, sizes.max())), np.zeros((n, tables), dtype=np.int64)
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                part = _unit(flat[at[own][:, None] + np.arange(size)].astype(np.float64))
                unit[own, :size] = part
                keys[own] = bucket_keys(part, tables, projections, width, seed)
            counted, left, right = np.zeros(n, dtype=np.int64), [], []
            for a, b in graph.pairs_of(starts, n, i, j, block, AT_ONCE):
                close = (np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold) & (world[a] == world[b])
                a, b = a[close], b[close]
                if not len(a):
                    continue
                first = (keys[a] == keys[b]).argmax(axis=1)  # the first table in which both share a bucket
                here = (keys[a, first] ^ world[a]) == bucket[a]
                np.add.at(counted, a[here], copies[b[here]])
                np.add.at(counted, b[here], copies[a[here]])
                left.append(a)
                right.append(b)
            if not left:
                continue
            low = graph.smallest(place, np.concatenate(left), np.concatenate(right))
            out = np.flatnonzero((counted > 0) | (low != place))
            yield pa.RecordBatch.from_arrays(
                [pa.array(place[out]), pa.array(low[out]), pa.array(counted[out])], names=["a", "b", "n"]
            )

    found = keep(dealt.mapInArrow(verify, "a bigint, b bigint, n bigint"), "vector-links")
    direct = found.groupBy(F.col("a").alias("place")).agg(F.sum("n").alias("n"))
    roots = graph.components(found.select("a", "b")).withColumnRenamed("node", "place")
    rooted = nodes.drop("vector").join(direct, "place", "left").join(roots, "place", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "place"))
    lowest = rooted.groupBy("root").agg(F.min("node").alias("component_id"))
    classes = rooted.join(lowest, "root").select(
        "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    linked = keyed.select("id", "key").join(classes, "key").select("id", "n_links", "component_id")
    alone = named.where(~F.col("usable")).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(
        F.col("id").alias(id_col),
        F.col("n_links").cast("bigint").alias("n_links"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
    )

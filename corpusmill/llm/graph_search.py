"""Approximate nearest neighbours: a robust-pruned directed graph per shard, searched with a beam.

Nearness is the largest inner product. One more component, the root of what a vector's squared norm lacks to the
largest, puts all vectors on a sphere; there the nearest in Euclidean distance are those with the largest inner
product with a query whose extra component is zero. Graphs are built on that sphere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import vectors
from corpusmill.session import keep

#: Different vectors per shard, edges per vector, beam widths when building and searching, relaxation of the pruning,
#: points inserted together, nodes expanded together, and queries that meet a shard at once.
SHARD_ROWS, DEGREE, BUILD_BEAM, BEAM, ALPHA, TOGETHER, EXPAND, QUERY_ROWS = 8192, 40, 64, 192, 1.2, 256, 4, 4096


def beam_search(x: np.ndarray, neighbours: np.ndarray, start: int, queries: np.ndarray, beam: int):
    """(ids, similarities) of the ``beam`` best nodes found for each query, best first; -1 and -inf where there are fewer.

    Each step expands the best ``EXPAND`` nodes of every beam that have not been expanded.
    """
    n, lines = len(queries), np.arange(len(queries))[:, None]
    ids = np.full((n, beam), -1, dtype=np.int64)
    sims = np.full((n, beam), -np.inf, dtype=np.float32)
    ids[:, 0], sims[:, 0] = start, queries @ x[start]
    fresh = np.zeros((n, beam), dtype=bool)
    fresh[:, 0] = True
    seen = np.zeros((n, len(x)), dtype=bool)
    seen[:, start] = True
    while fresh.any():
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :EXPAND]  # beams are sorted, best first
        chosen = np.where(fresh[lines, order], ids[lines, order], -1)
        fresh[lines, order] = False
        found = np.where(chosen[:, :, None] >= 0, neighbours[chosen], -1).reshape(n, -1)
        found = np.sort(found, axis=1)
        new = found >= 0
        new[:, 1:] &= found[:, 1:] != found[:, :-1]
        new &= ~seen[lines, found]
        seen[np.broadcast_to(lines, found.shape)[new], found[new]] = True
        near = np.full(found.shape, -np.inf, dtype=np.float32)
        row = np.broadcast_to(lines, found.shape)[new]
        near[new] = np.einsum("ij,ij->i", x[found[new]], queries[row])
        every = np.concatenate([sims, near], axis=1)
        best = np.argsort(-every, axis=1, kind="stable")[:, :beam]
        ids = np.concatenate([ids, np.where(new, found, -1)], axis=1)[lines, best]
        fresh = np.concatenate([fresh, new], axis=1)[lines, best]
        sims = every[lines, best]
    return ids, sims


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` of the candidates (-1: none) of each point: the nearest, without those that a chosen one is
    nearer to, by a factor of ``alpha``, than the point is. Diverse edges stay, long ones among them."""
    lines = np.arange(len(points))[:, None]
    candidates = np.sort(candidates, axis=1)
    alive = (candidates >= 0) & (candidates != points[:, None])
    alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    own = x[candidates]
    far = np.maximum(0, ((own - x[points][:, None]) ** 2).sum(axis=2))
    order = np.argsort(np.where(alive, far, np.inf), axis=1, kind="stable")
    candidates, alive, far, own = candidates[lines, order], alive[lines, order], far[lines, order], own[lines, order]
    size = (own**2).sum(axis=2)
    between = np.maximum(0, size[:, :, None] + size[:, None, :] - 2 * own @ own.transpose(0, 2, 1))
    out = np.full((len(points), degree), -1, dtype=np.int64)
    line = lines[:, 0]
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[line, first]
        if not some.any():
            break
        out[some, k] = candidates[line, first][some]
        alive &= ~(some[:, None] & (alpha * alpha * between[line, first] <= far))
        alive[line, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 3):
    """(neighbours, start) of a graph over the rows of ``x``; points are inserted in growing batches, in random order."""
    n = len(x)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    neighbours = np.full((n, degree), -1, dtype=np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != start]
    at, size = 0, 1
    while at < len(order):
        points = order[at : at + size]
        found, _ = beam_search(x, neighbours, start, x[points], beam)
        neighbours[points] = robust_prune(x, points, found, degree, alpha)
        _add_back(x, neighbours, points, degree, alpha)
        at, size = at + size, min(TOGETHER, size * 2)
    return neighbours, start


def _add_back(x, neighbours, points, degree, alpha) -> None:
    """Edges back from the chosen neighbours; lists that grow too long are pruned."""
    chosen = neighbours[points]
    source = np.broadcast_to(points[:, None], chosen.shape)[chosen >= 0]
    target = chosen[chosen >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, counts)
    wide = np.full((len(nodes), degree + int(counts.max(initial=0))), -1, dtype=np.int64)
    wide[:, :degree] = neighbours[nodes]
    wide[np.repeat(np.arange(len(nodes)), counts), degree + place] = source
    full = (wide >= 0).sum(axis=1) > degree
    short = -np.sort(-wide[~full], axis=1)[:, :degree]
    neighbours[nodes[~full]] = short
    for k in np.array_split(np.flatnonzero(full), max(1, full.sum() // 256)):
        if len(k):
            neighbours[nodes[k]] = robust_prune(x, nodes[k], wide[k], degree, alpha)


def build_index(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", copies: int = 21, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(``dim``, ``shard``, ids, vectors, neighbours, start): one graph per shard over all usable rows.

    Equal vectors are one node, with their ``copies`` smallest ids: ties go to smaller ids, so larger ones can be in
    no answer of fewer neighbours. Vectors that are null, empty, zero or hold null or non-finite components, and
    rows without an id, are left out. Vectors of different length are in different graphs.
    """
    named = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"))
    named = named.where(F.col("id").isNotNull() & vectors.usable(F.col("vector"))).withColumn(
        "key", vectors.content_key(F.col("vector"))
    )
    # A row that is there more than once is one.
    once = named.groupBy("key", "id").agg(F.any_value("vector").alias("vector"))
    order = Window.partitionBy("key").orderBy("id")
    low = once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= copies)
    nodes = low.groupBy("key").agg(
        F.sort_array(F.collect_set("id")).alias("ids"), F.any_value("vector").cast("array<double>").alias("vector")
    )
    nodes = keep(nodes.withColumn("dim", F.size("vector")), "nodes")
    square = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)
    # One row per length of vector.
    sizes = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("largest"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("n") / shard_rows))
    dealt = nodes.join(F.broadcast(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("key"), shards))

    def run(key, table):
        table = table.combine_chunks().sort_by([("first", "ascending")])  # the same graph whatever the order of rows
        x = vectors.matrix(table.column("vector").chunk(0))
        lack = np.maximum(0, table.column("largest")[0].as_py() - (x * x).sum(axis=1))
        neighbours, start = build_graph(np.hstack([x, np.sqrt(lack)[:, None]]).astype(np.float32))
        return pa.table(
            {
                "dim": pa.array([key[0].as_py()], pa.int32()),
                "shard": pa.array([key[1].as_py()], pa.int64()),
                "ids": pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
                "vectors": pa.array([x.tobytes()], pa.binary()),
                "neighbours": pa.array([neighbours.astype(np.int32).tobytes()], pa.binary()),
                "start": pa.array([start], pa.int64()),
            }
        )

    return (
        dealt.select("dim", "shard", "ids", "vector", "largest", F.col("ids")[0].alias("first"))
        .groupBy("dim", "shard")
        .applyInArrow(run, "dim int, shard bigint, ids array<array<bigint>>, vectors binary, neighbours binary, start bigint")
    )


def search(
    index: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    beam: int = BEAM,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): the ``k`` best found for each query, itself left out.

    ``index`` is that of ``build_index`` with at least ``k`` + 1 copies. Every shard is searched for every query, in
    blocks of ``query_rows`` queries; the score is the inner product in double precision, ties go to the smaller id.
    Unusable query vectors and null ids have no answer; a query that comes twice is one; fewer candidates than ``k``
    are all returned if the beam holds them.
    """
    asked = queries.select(F.col(id_col).cast("bigint").alias("query_id"), F.col(vector_col).alias("vector"))
    asked = asked.where(F.col("query_id").isNotNull() & vectors.usable(F.col("vector"))).select(
        "query_id", F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim")
    )
    blocks = max(1, -(-asked.count() // query_rows))
    # One row per length of vector.
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = (
        asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        .join(F.broadcast(shards), "dim")
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))))
    )

    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        names = ("query_id", "vec_id", "score")
        if not shard.num_rows or not block.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.float64()))})
        row = shard.to_pylist()[0]
        x = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
        neighbours = np.frombuffer(row["neighbours"], dtype=np.int32).reshape(len(x), -1)
        low, out = x.astype(np.float32), []
        asked, ids = vectors.matrix(block.combine_chunks().column("vector").chunk(0)), block.column("query_id").to_numpy()
        for at in range(0, len(ids), TOGETHER):
            q = asked[at : at + TOGETHER]
            found, _ = beam_search(low, neighbours, row["start"], q.astype(np.float32), max(beam, k + 1))
            exact = np.where(found >= 0, np.einsum("ijk,ik->ij", x[found], q), -np.inf)
            for own, nodes, scores in zip(ids[at : at + TOGETHER].tolist(), found.tolist(), exact.tolist()):
                best = [(-s, v) for n, s in zip(nodes, scores) if n >= 0 for v in row["ids"][n] if v != own]
                out.extend((own, v, -s) for s, v in sorted(best)[:k])
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, (pa.int64(), pa.int64(), pa.float64()))})

    found = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block"))
    found = found.applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

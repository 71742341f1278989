"""Links between nodes: comparing the members of buckets in blocks, and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import keep

#: Members of a bucket that are compared in one piece; larger buckets are dealt out as pairs of blocks.
BLOCK_ROWS = 1024
#: Copies of the smaller side of a join on a node that may have very many links.
SALTS = 16
PAIRS_AT_ONCE = 1 << 20


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join of two tables that both grow with the input: neither is broadcast.

    Spark sizes rows that a Python function or an explode makes by those that go in, and a written table by its
    compressed files. What it takes for small enough to broadcast can be many times what the driver holds.
    """
    return df.hint("merge")


def in_blocks(members: DataFrame, key: str, node: str, data: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Members of buckets with two or more members, dealt out so that every pair of a bucket meets in one piece.

    ``data`` (node, ...) is joined to the members that are left once buckets of one are gone.

    A piece is (bucket, i, j) with i <= j: the members of blocks i and j, at most about twice ``block_rows``. The
    column ``_block`` says which block a member is of. Rows come partitioned and sorted by piece.
    """
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    cut = members.join(shuffled(sizes), key).withColumn("_blocks", F.ceil(F.col("_n") / block_rows).cast("int"))
    cut = cut.withColumn("_block", F.pmod(F.xxhash64(F.lit(7), node), "_blocks").cast("int"))
    if data is not None:
        cut = cut.join(shuffled(data), node)
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    dealt = cut.select("*", other).select(
        *[c for c in cut.columns if c not in ("_n", "_blocks")],
        F.least("_block", "_other").alias("_i"),
        F.greatest("_block", "_other").alias("_j"),
    )
    return dealt.repartition(key, "_i", "_j").sortWithinPartitions(key, "_i", "_j")


def pieces(batches, key: str):
    """Whole pieces of ``in_blocks`` as tables of one or more pieces, put together across batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        starts = _starts(table, key)
        if len(starts) > 1 and table.num_rows >= 4096:
            cut = int(starts[-1])
            yield table.slice(0, cut).combine_chunks(), starts[:-1]
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _starts(table, key)


def _starts(table: pa.Table, key: str) -> np.ndarray:
    change = np.zeros(table.num_rows, dtype=bool)
    change[:1] = True
    for name in (key, "_i", "_j"):
        column = table.column(name).to_numpy()
        change[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(change)


def pairs_of(starts: np.ndarray, end: int, i: np.ndarray, j: np.ndarray, block: np.ndarray, at_once: int = PAIRS_AT_ONCE):
    """(left, right) row numbers of the pairs of every piece, a bounded number at a time.

    A piece of one block has all its pairs, a piece of two blocks those across the blocks.
    """
    sizes = np.diff(np.append(starts, end))
    for size in np.unique(sizes[sizes > 1]).tolist():
        own = starts[sizes == size]
        left, right = np.triu_indices(size, 1)
        step = max(1, at_once // len(left))
        for at in range(0, len(own), step):
            base = own[at : at + step, None]
            for part in range(0, len(left), at_once):
                a = (base + left[None, part : part + at_once]).ravel()
                b = (base + right[None, part : part + at_once]).ravel()
                across = (i[a] == j[a]) | (block[a] != block[b])
                yield (a, b) if across.all() else (a[across], b[across])


def stars(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest row number reachable from each of ``n`` rows."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        label = label[label]
        if (label[left] == label[right]).all() and (label == label[label]).all():
            break
    return label


def smallest(node: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For every row the smallest ``node`` reachable over links between row numbers."""
    order = np.argsort(node, kind="stable")
    rank = np.empty(len(node), dtype=np.int64)
    rank[order] = np.arange(len(node))
    out = np.empty(len(node), dtype=node.dtype)
    out[order] = node[order][stars(rank[left], rank[right], len(node))]
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), for every node that has an edge.

    Large-star and small-star rounds: each node hands its larger, then its smaller neighbours to the smallest one.
    A round writes its links to the shared folder. Only the number and checksum of the links reach the driver. The
    smallest neighbours are replicated ``SALTS`` times, so that a node with very many links is spread out.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, before = keep(edges, "links"), None
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s")

    def with_lowest(pairs: DataFrame) -> DataFrame:
        """(u, v, m): m is the smallest of u and its neighbours v."""
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return pairs.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(
            shuffled(low.select("u", "m", salts)), ["u", "_s"]
        )

    while True:
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = current.selectExpr("a AS u", "b AS v").union(current.selectExpr("b AS u", "a AS v"))
        large = with_lowest(both).where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        found = with_lowest(large)
        small = found.selectExpr("u AS a", "m AS b").union(found.selectExpr("v AS a", "m AS b"))
        current = keep(small.where("a <> b").distinct(), "links")
    roots = current.selectExpr("a AS node", "b AS root")
    return roots.union(current.selectExpr("b AS node", "b AS root")).distinct()

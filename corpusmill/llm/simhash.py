"""SimHash near-duplicates by a segment-popcount embedding.

The bits of a table are cut into segments and mapped to the number of set bits in each. Two fingerprints that differ
in r bits of a table have counts at most r apart in Manhattan distance, so a grid over the counts is a lower bound:
where the distance is at most 2 * reach, some point of the grid is within ``reach`` of both. Fingerprints meet at these
points and are then compared exactly.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import graph
from corpusmill.llm.words import slices, small_batches, split_words, starts_of
from corpusmill.session import keep

SEED = 42
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16


def text_fingerprint(data: bytes, starts: list[int], ends: list[int], width: int, bits: int) -> bytes:
    """The fingerprint of one text, given its words joined by single spaces and the offsets of the words.

    A bit is 1 if set in over half of the hashes of all shingles, repeats included. The first 64 bits hash with XXH64
    seeded ``SEED``, each further 64 with a mix of that. No shingle gives zeros. Least significant byte first.
    """
    n, seed, hashed = len(starts), SEED, xxhash.xxh64_intdigest
    if not n:
        return bytes(bits // 8)
    size = min(width, n)
    ones, total = np.zeros(bits, dtype=np.int64), n - size + 1
    for at in range(0, total, AT_ONCE):
        upto = min(total, at + AT_ONCE)
        spans = zip(starts[at:upto], ends[at + size - 1 : upto + size - 1])
        found = np.array([hashed(data[a:b], seed) for a, b in spans], dtype="<u8")
        for k in range(bits // 64):
            mixed = found if not k else _mixed(found + np.uint64(k * int(MIX) % 2**64))
            set_bits = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[64 * k : 64 * k + 64] += set_bits.sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > total, bitorder="little").tobytes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 64) -> DataFrame:
    """(id, ``fingerprint``): one row per row of ``docs``; ``bits`` bits, a multiple of 64, in bytes.

    Words are cut at ASCII white space with A to Z lower-cased. A text of fewer than ``width`` words is one shingle,
    a null, empty or white text has none and the fingerprint zero.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for part in slices(batches):
            codes, dictionary, counts = split_words(part.column("text"))
            sizes = dictionary.to_numpy(zero_copy_only=False)
            sizes = np.array([len(w.encode()) for w in sizes], dtype=np.int64)
            words = pa.DictionaryArray.from_arrays(pa.array(codes, pa.int32()), dictionary)
            lists = pa.ListArray.from_arrays(pa.array(starts_of(counts), pa.int32()), words.dictionary_decode())
            joined = pc.binary_join(lists, " ").cast(pa.binary())
            lengths, begin, out = sizes[codes], starts_of(counts), []
            for i, data in enumerate(joined):
                own = lengths[begin[i] : begin[i + 1]]
                ends = np.cumsum(own) + np.arange(len(own))
                out.append(text_fingerprint(data.as_py(), (ends - own).tolist(), ends.tolist(), width, bits))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out, pa.binary())], names=["id", "fingerprint"])

    kind = rows.schema["id"].dataType.simpleString()
    found = small_batches(rows).mapInArrow(run, f"id {kind}, fingerprint binary")
    return found.withColumnRenamed("id", id_col)


def _moves(segments: int, reach: int) -> np.ndarray:
    """All steps on the grid of Manhattan length at most ``reach``."""
    out = {(0,) * segments}
    for _ in range(reach):
        more = set()
        for step in out:
            for s, d in itertools.product(range(segments), (-1, 1)):
                more.add(tuple(v + d * (k == s) for k, v in enumerate(step)))
        out |= more
    return np.array(sorted(out), dtype=np.int64)


@dataclass(frozen=True)
class Tables:
    """Which bits of a fingerprint each table reads (tables x bits), in how many segments and with what reach.

    ``radius`` is the most bits of the whole fingerprint in which two that are linked differ.
    """

    bits: np.ndarray
    segments: int
    reach: int
    radius: int


def single_table(bits: int = 64, radius: int = 2, segments: int = 16) -> Tables:
    """One table of all bits: finds every pair within ``radius``."""
    return Tables(np.arange(bits)[None], segments, (radius + 1) // 2, radius)


def links(classes: DataFrame, tables: Tables) -> DataFrame:
    """Links (a, b) that join the fingerprints of ``classes`` (node, fingerprint) that meet and are within the radius.

    Of the members of a grid point that are linked with one another, each is returned with the smallest: as many rows
    as members, never all pairs.
    """
    wide, reach = tables.bits.shape[1] // tables.segments, tables.reach
    moves = _moves(tables.segments, reach)
    scale = np.uint64(wide + 1 + 2 * reach) ** np.arange(tables.segments, dtype=np.uint64)

    def meet(batches):
        """Every fingerprint at all grid points within reach of its counts, table by table."""
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            data = np.frombuffer(b"".join(batch.column("fingerprint").to_pylist()), dtype=np.uint8)
            data = np.unpackbits(data.reshape(len(node), -1), axis=1, bitorder="little")
            step = max(1, (1 << 19) // len(moves))
            for t, at in itertools.product(range(len(tables.bits)), range(0, len(node), step)):
                part = data[at : at + step, tables.bits[t]]
                counts = part.reshape(len(part), tables.segments, wide).sum(axis=2, dtype=np.int64)
                points = counts[:, None, :] + moves[None]
                inside = ((points >= 0) & (points <= wide)).all(axis=2)
                cell = ((points + reach).astype(np.uint64) * scale).sum(axis=2, dtype=np.uint64)
                cell = _mixed(cell + np.uint64(t * int(MIX) % 2**64)).view(np.int64)
                row = np.broadcast_to(node[at : at + step, None], inside.shape)
                yield pa.RecordBatch.from_arrays([pa.array(cell[inside]), pa.array(row[inside])], names=["cell", "node"])

    def verify(batches):
        for table, starts in graph.pieces(batches, "cell"):
            node = table.column("node").to_numpy()
            data = np.frombuffer(b"".join(table.column("fingerprint").to_pylist()), dtype=np.uint64)
            data = data.reshape(len(node), -1)
            i, j, block = (table.column(c).to_numpy() for c in ("_i", "_j", "_block"))
            left, right = [], []
            for a, b in graph.pairs_of(starts, len(node), i, j, block):
                differ = sum(np.bitwise_count(data[a, k] ^ data[b, k]).astype(np.int64) for k in range(data.shape[1]))
                close = differ <= tables.radius
                if close.any():
                    left.append(a[close])
                    right.append(b[close])
            if left:
                root = graph.smallest(node, np.concatenate(left), np.concatenate(right))
                far = node != root
                yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(root[far])], names=["a", "b"])

    met = classes.select("node", "fingerprint").mapInArrow(meet, "cell bigint, node bigint")
    dealt = graph.in_blocks(met, "cell", "node", classes.select("node", "fingerprint"))
    return dealt.mapInArrow(verify, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, tables: Tables, bits: int = 64, width: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ``fingerprint``, ``component_id``) of every row: the smallest id reachable over links, its own included.

    Equal fingerprints are one node of the graph, so copies cost no comparison. Null ids are never the smallest; a
    component of null ids only has component_id null. Repeated rows stay. Columns other than the two are not read.
    """
    rows = keep(fingerprints(docs, id_col, text_col, width, bits), "fingerprints")
    classes = rows.groupBy("fingerprint").agg(F.min(id_col).alias("_first"))
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = graph.components(links(classes, tables))
    rooted = classes.join(graph.shuffled(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = rooted.join(graph.shuffled(lowest), "root").select("fingerprint", "component_id")
    return rows.join(graph.shuffled(named), "fingerprint").select(id_col, "fingerprint", "component_id")


def as_hex(fingerprint: Column) -> Column:
    """A 64-bit fingerprint in 16 lowercase hexadecimal digits, most significant first."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.hex(F.substring(fingerprint, i, F.lit(1))))
    return F.lower(F.array_join(F.reverse(digits), ""))

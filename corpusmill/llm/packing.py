"""Packing documents into token sequences: cutting-stock column generation over the histogram of their lengths.

Whole sequences are cut off first. What is left of a document (its rest) is a piece of a multiple of ``grain`` tokens
and a tail of fewer. The pieces are items of a cutting-stock problem whose linear program is solved by column
generation: a knapsack by dynamic programming finds the pattern of pieces that improves it most. Rounded down, the
patterns are filled with documents in order of their rank among those of their length. Pieces that no pattern takes,
and all tails, are cut into powers of two, which fill sequences without a gap.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.operators.ranking import running_totals
from corpusmill.session import keep

#: Tokens of a sequence, tokens to which pieces are rounded, and the padding that one more cut is worth.
CAPACITY, GRAIN, CUT = 2048, 16, 4.0
PIECES = "array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint,cut:int>>"


def _waste(units: int, grain: int) -> np.ndarray:
    """Padding by units filled: none for a full sequence or one of a power of two tokens."""
    fill = np.arange(units + 1) * grain
    return np.where(fill & (fill - 1) == 0, 0, units * grain - fill).astype(float)


def best_pattern(value: np.ndarray, units: int, grain: int) -> tuple[float, np.ndarray]:
    """(reduced cost, items) of the pattern with the least padding minus value; ``value[u]`` is that of u units.

    An unbounded knapsack, by dynamic programming over the units filled.
    """
    best, last = np.full(units + 1, -np.inf), np.zeros(units + 1, dtype=np.int64)
    best[0] = 0.0
    for fill in range(1, units + 1):
        gain = best[fill - 1 :: -1][: len(value) - 1] + value[1 : fill + 1]
        last[fill] = 1 + int(gain.argmax())
        best[fill] = gain[last[fill] - 1]
    cost = _waste(units, grain) - best
    fill = 1 + int(cost[1:].argmin())
    items, lowest = np.zeros(len(value), dtype=np.int64), float(cost[fill])
    while fill:
        items[last[fill]] += 1
        fill -= last[fill]
    return lowest, items


def solve(demand: np.ndarray, units: int, grain: int, cut: float = CUT) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, for ``demand[u]`` pieces of u units (u from 1 to ``units`` - 1).

    The linear program fills every piece into a pattern, at the cost of its padding, or cuts it into powers of two,
    at ``cut`` for each cut. Its solution by column generation is rounded down; whatever step it stops at is
    feasible, since pieces outside of patterns are cut.
    """
    rows = np.flatnonzero(demand)
    if not len(rows):
        return []
    price = cut * (np.bitwise_count(rows.astype(np.uint64)).astype(float) - 1)
    inverse, amount, cost = np.eye(len(rows)), demand[rows].astype(float), price.copy()
    column: list[np.ndarray | None] = [None] * len(rows)
    for _ in range(60 * len(rows)):
        dual = cost @ inverse
        value = np.full(units, -1e9)
        value[rows] = dual
        lowest, items = best_pattern(value, units, grain)
        slack = price - dual
        entering, own = items[rows].astype(float), float(_waste(units, grain)[int(items @ np.arange(units))])
        if slack.min() < lowest:
            lowest, items = float(slack.min()), None
            entering, own = np.zeros(len(rows)), float(price[slack.argmin()])
            entering[slack.argmin()] = 1.0
        if lowest > -1e-7:
            break
        step = inverse @ entering
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1.0), np.inf)
        leaving = int(ratio.argmin())
        if not np.isfinite(ratio[leaving]):
            break
        move = ratio[leaving]
        amount = np.maximum(amount - move * step, 0.0)
        amount[leaving] = move
        pivot = inverse[leaving] / step[leaving]
        inverse = inverse - np.outer(step, pivot)
        inverse[leaving] = pivot
        cost[leaving], column[leaving] = own, items
    found = [(items, int(np.floor(x + 1e-6))) for items, x in zip(column, amount) if items is not None]
    left, out = demand.copy(), []
    for items, times in found:  # rounding errors never take more pieces than there are
        most = min((int(left[u] // items[u]) for u in np.flatnonzero(items)), default=0)
        if times := min(times, most):
            left -= items * times
            out.append((items, times))
    return out


@dataclass(frozen=True)
class Plan:
    """Where the pieces of every rest go, as functions of its length and its rank among rests of that length."""

    capacity: int
    grain: int
    before_units: np.ndarray
    before_tail: np.ndarray
    slots: list[tuple[list[int], list[tuple[int, int, int]]]]
    taken: np.ndarray
    unit_ranks: np.ndarray
    tail_ranks: np.ndarray
    bit_starts: np.ndarray
    bits_total: int
    bits_base: int
    blocks_base: int

    def places(self, rest: int, rank: int):
        """(start in the rest, length, sequence, offset, number of the cut) of each piece of a rest."""
        units, tail = rest // self.grain, rest % self.grain
        cuts, place = tail, self.before_units[rest] + rank
        if units and place < self.taken[units]:
            starts, found = self.slots[units]
            k = bisect_right(starts, place) - 1
            base, times, offset = found[k]
            slot, copy = divmod(int(place) - starts[k], times)
            yield 0, units * self.grain, base + copy, offset + slot * units * self.grain, 0
        else:
            cuts = rest
        wide = self.capacity.bit_length() - 1
        for b in range(wide - 1, -1, -1):
            if cuts >> b & 1:
                if 1 << b >= self.grain:
                    at = self.unit_ranks[b, units] + place - self.taken[units]
                else:
                    at = self.tail_ranks[b, tail] + self.before_tail[rest] + rank
                sequence, offset = self.bit_place(int(self.bit_starts[b]) + (int(at) << b))
                yield rest >> (b + 1) << (b + 1), 1 << b, sequence, offset, wide - b

    def bit_place(self, at: int) -> tuple[int, int]:
        """(sequence, offset) of a place among the powers of two; the last, partial sequence is one per set bit."""
        sequence, offset = divmod(at, self.capacity)
        if sequence < self.bits_total // self.capacity:
            return self.bits_base + sequence, offset
        last, begin, number = self.bits_total % self.capacity, 0, 0
        for b in range(self.capacity.bit_length() - 2, -1, -1):
            if last >> b & 1:
                if offset < begin + (1 << b):
                    break
                begin, number = begin + (1 << b), number + 1
        return self.bits_base + sequence + number, offset - begin


def make_plan(counts: np.ndarray, capacity: int = CAPACITY, grain: int = GRAIN) -> Plan:
    """``counts[r]``: documents whose rest has r tokens (r below ``capacity``). Only this histogram is needed."""
    units, wide = capacity // grain, capacity.bit_length() - 1
    by_unit, by_tail = counts.reshape(units, grain), counts.reshape(units, grain)
    before_units = (np.cumsum(by_unit, axis=1) - by_unit).ravel()
    before_tail = (np.cumsum(by_tail, axis=0) - by_tail).ravel()
    demand = by_unit.sum(axis=1)
    demand[0] = 0
    slots: list[tuple[list[int], list[tuple[int, int, int]]]] = [([], []) for _ in range(units)]
    taken, base = np.zeros(units, dtype=np.int64), 0
    for items, times in solve(demand, units, grain):
        offset = 0
        for u in np.flatnonzero(items)[::-1].tolist():
            slots[u][0].append(int(taken[u]))
            slots[u][1].append((base, times, offset))
            taken[u] += int(items[u]) * times
            offset += int(items[u]) * u * grain
        base += times
    left, tails = demand - taken, by_tail.sum(axis=0)
    unit_ranks, tail_ranks = np.zeros((wide, units), dtype=np.int64), np.zeros((wide, grain), dtype=np.int64)
    bit_starts, total = np.zeros(wide, dtype=np.int64), 0
    for b in range(wide - 1, -1, -1):
        if 1 << b >= grain:
            has = np.where((np.arange(units) * grain) >> b & 1, left, 0)
            unit_ranks[b] = np.cumsum(has) - has
        else:
            has = np.where(np.arange(grain) >> b & 1, tails, 0)
            tail_ranks[b] = np.cumsum(has) - has
        bit_starts[b] = total
        total += int(has.sum()) << b
    sequences = total // capacity + int(total % capacity).bit_count()
    return Plan(
        capacity, grain, before_units, before_tail, slots, taken, unit_ranks, tail_ranks, bit_starts, total, base, base + sequences
    )


def possible_cuts(tokens: Column, capacity: int = CAPACITY, grain: int = GRAIN) -> Column:
    """Every (start, length) that a piece of a document of so many tokens can have, in the order of ``cut``.

    The whole sequences, the rest without its tail, and the powers of two that make up the rest (length 0 where the
    rest has no such bit).
    """
    blocks = F.floor(tokens / capacity)
    first, rest = blocks * capacity, tokens % capacity

    def piece(start: Column, length: Column) -> Column:
        return F.struct(start.cast("bigint").alias("start"), length.cast("bigint").alias("length"))

    whole = F.transform(F.sequence(F.lit(0).cast("bigint"), blocks), lambda i: piece(i * capacity, F.lit(capacity)))
    tail = [piece(first, rest - rest % grain)]
    for b in range(capacity.bit_length() - 2, -1, -1):
        bit = F.floor(rest / (1 << b)) % 2
        tail.append(piece(first + F.floor(rest / (2 << b)) * (2 << b), bit * (1 << b)))
    return F.concat(F.slice(whole, F.lit(1), blocks.cast("int")), F.array(*tail))


def pack(docs: DataFrame, tokens_col: str = "tokens", capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """``docs`` with ``pieces``: (start, length, sequence_id, offset, cut) of each piece of the row's document.

    ``tokens_col`` is its number of tokens; null, zero and negative counts have no pieces. Pieces come by start and
    cover the document once. Sequences hold at most ``capacity`` tokens without gaps; a sequence that is neither full
    nor a power of two long can only come from a pattern. ``cut`` is the piece's place in ``possible_cuts``. Every
    row is packed, repeated ones too. Which of the documents of a length goes where depends on the order of rows.
    A column ``pieces`` is replaced; names that begin with an underscore are taken for the work.

    Only the histogram of rests (``capacity`` counts) reaches the driver. Ranks come from two range shuffles.
    """
    tokens = F.greatest(F.coalesce(F.col(tokens_col).cast("bigint"), F.lit(0)), F.lit(0))
    carried = [c for c in docs.columns if c != "pieces"]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_row"),
        F.floor(tokens / capacity).alias("_blocks"),
        (tokens % capacity).alias("_rest"),
        F.monotonically_increasing_id().alias("_uid"),
    )
    rows = keep(rows, "lengths")
    counts = np.zeros(capacity, dtype=np.int64)
    for r in rows.groupBy("_rest").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["_rest"]] = r["n"]
    plan = make_plan(counts, capacity, grain)
    first = running_totals(rows, [F.col("_uid")], weight="_blocks")
    first = first.select("_row", "_blocks", "_rest", "_uid", F.col("_before").alias("_begin"))
    ranked = running_totals(first, [F.col("_uid")], by=["_rest"], groups=capacity)
    ranked = ranked.select("_row", "_blocks", "_rest", "_begin", F.col("_before").alias("_rank"))
    sent = docs.sparkSession.sparkContext.broadcast(plan)  # bounded by capacity and grain

    def run(batches):
        plan = sent.value
        names = ("start", "length", "sequence_id", "offset", "cut")
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("_blocks", "_rest", "_begin", "_rank")]
            for blocks, rest, first, rank in zip(*columns):
                pieces = [(i * capacity, capacity, plan.blocks_base + first + i, 0, i) for i in range(blocks)]
                at = blocks * capacity
                pieces += [(at + s, n, int(q), int(o), blocks + c) for s, n, q, o, c in plan.places(rest, rank) if n]
                out.append([dict(zip(names, p)) for p in pieces])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(out, _arrow_pieces())], names=["_row", "pieces"]
            )

    schema = StructType([ranked.schema["_row"], *StructType.fromDDL(f"pieces {PIECES}").fields])
    return ranked.mapInArrow(run, schema).select("_row.*", "pieces")


def _arrow_pieces() -> pa.DataType:
    kinds = [(n, pa.int64()) for n in ("start", "length", "sequence_id", "offset")]
    return pa.list_(pa.struct([*kinds, ("cut", pa.int32())]))

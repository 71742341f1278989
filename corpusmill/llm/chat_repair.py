"""Cheapest repair of damaged chats by branch-and-bound.

A chat is sound if the initials of its roles read ``(s?(ua)+)?`` and no row is blank or repeats an earlier one. Rows may be
kept (K), given the role user or assistant (R), deleted (D), and empty rows inserted (I). The search goes depth-first
over (rows done, state) with a stack of its own: every prefix of edits carries its cost and its audit, the letters of
its edits; lower bounds of what the remaining rows cost and the best repair found so far cut branches, and a table per node drops a prefix that
a cheaper one, or an equally cheap one with a smaller audit, has already reached. When the stack is empty the repair is
proved to be the cheapest, and the one with the ASCII-least audit among those.

Chats of any length are cut into segments of ``SEGMENT`` rows, which are searched for every pair of entry and exit state
apart from one another; the segments of a chat are then joined in order. So no task ever holds more than a segment.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.vectors import content_key
from corpusmill.llm.words import small_batches
from corpusmill.operators import ranking
from corpusmill.session import keep

#: Rows of a chat that are searched together.
SEGMENT = 128
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
#: Cost of a row that ends in the middle of a sentence and is not deleted.
TRUNCATED = 3
#: States: nothing yet, after a system row, after a user row, after an assistant row; what each may be followed by.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
SOUND = (0, 3)
LEGAL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}
SPACE = r"\x20\x09-\x0D"
EMPTY = hashlib.sha256(b"").hexdigest()


@dataclass
class Row:
    """What the search needs of a row: its initial, whether it has to go, whether it is truncated, its further copies."""

    initial: str
    doomed: bool
    truncated: bool
    copies: int = 0


def edits(row: Row, state: int) -> Iterator[tuple[int, int, str]]:
    """(state after it, cost, letters) of everything that can be done with a row."""
    gone, more = DELETE * row.copies, "D" * row.copies  # further copies go, and before anything is inserted
    yield state, gone + DELETE, "D" + more
    if not row.doomed:
        late = gone + TRUNCATED * row.truncated
        for letter, to in NEXT[state].items():
            if letter != "s":
                yield to, late + REROLE, "R" + more
            if letter == row.initial:
                yield to, late + KEEP, "K" + more


def inserts(state: int) -> Iterator[int]:
    return (to for letter, to in NEXT[state].items() if letter != "s")


def suffix_bounds(rows: list[Row], goals) -> list[list[float]]:
    """Per row and state the least that the rows from there on cost, whatever the audit."""
    bounds: list[list[float]] = []
    for i in range(len(rows), -1, -1):
        if i == len(rows):
            own = [0 if state in goals else math.inf for state in range(4)]
        else:
            own = [min(cost + bounds[-1][to] for to, cost, _ in edits(rows[i], state)) for state in range(4)]
        for _ in range(3):  # no more than three inserted rows in a run lead to a new state
            own = [min([own[state], *(INSERT + own[to] for to in inserts(state))]) for state in range(4)]
        bounds.append(own)
    return bounds[::-1]


def search(rows: list[Row], entry: int = 0, goals=SOUND) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits that lead from state ``entry`` to one of ``goals``; None if nothing does."""
    n, bounds = len(rows), suffix_bounds(rows, goals)
    best: tuple[int, str] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}
    stack = [(bounds[0][entry], "", 0, entry, 0)]
    while stack:
        bound, audit, i, state, cost = stack.pop()
        if reached[i, state] != (cost, audit):
            continue  # a better prefix came here after this one was put on the stack
        if best is not None and (bound > best[0] or (bound == best[0] and audit > best[1][: len(audit)])):
            continue
        if i == n and state in goals and (best is None or (cost, audit) < best):
            best = (cost, audit)
        options = [(cost + INSERT, audit + "I", i, to) for to in inserts(state)]
        if i < n:
            options += [(cost + more, audit + letters, i + 1, to) for to, more, letters in edits(rows[i], state)]
        branches = []
        for spent, letters, at, to in options:
            bound = spent + bounds[at][to]
            if bound < math.inf and ((at, to) not in reached or (spent, letters) < reached[at, to]):
                reached[at, to] = (spent, letters)
                branches.append((bound, letters, at, to, spent))
        stack += sorted(branches, reverse=True)  # the most promising branch is tried first
    return best


def applied(audit: str, rows: list[tuple[str, str, int]], entry: int = 0) -> Iterator[str]:
    """The lines ``role:text`` of a repair of rows (role, text, number of times)."""
    state, source = entry, ((role, text) for role, text, times in rows for _ in range(times))
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(source)
        if letter == "D":
            continue
        if letter != "K":
            role = NAMES[next(x for x in NEXT[state] if x != "s")]
        state = NEXT[state][role[0]]
        yield f"{role}:{text}"


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the damage done to chats for a test of the repair.

    By the CRC-32 of ``conv_id:turn`` modulo 20 a row is dropped (0), emptied (1), loses its sentence marks (2), is
    repeated (3) or becomes the user's (4). Nulls count as one blank.
    """
    blank = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    fate = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    text = F.coalesce("text", blank)
    return turns.withColumn("_fate", fate).where("_fate <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("_fate") == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(F.col("_fate") == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def repair(turns: DataFrame) -> DataFrame:
    """Every chat of ``turns`` (conv_id, turn, role, text, and optionally copies) with its faults and its repair.

    Rows come by turn (nulls first), role and text. The columns are ``conv_id``, ``gaps`` (turn numbers missing between
    the first and the last), the rows whose first fault is ``blank``, ``duplicate`` (role and text seen before) or
    ``truncated`` (last visible character no sentence mark), ``illegal`` neighbours, ``cost``, ``audit`` and
    ``repaired_sha256`` of the lines ``role:text``.

    Null roles and texts count as one blank. Rows that are wholly equal are counted before they are exchanged. A null
    conv_id is a chat of its own. A row with an empty role has no initial and cannot be kept. Other columns are not
    read. An empty table gives no rows. The lines of a chat are hashed in order, which SHA-256 leaves no choice in; a
    task that does so holds one batch of rows.
    """
    kind = turns.schema["conv_id"].dataType
    blank = F.lit(" ")
    rows = turns.select(
        F.col("conv_id").isNotNull().alias("known"),
        F.coalesce(F.col("conv_id").cast("string"), blank).alias("id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"),
        (F.col("copies") if "copies" in turns.columns else F.lit(1)).cast("bigint").alias("copies"),
    )
    rows = rows.groupBy("known", "id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    placed = ranking.running_totals(rows, order, ["known", "id"])
    placed = keep(placed.withColumn("_key", content_key(F.col("role"), F.col("text"))).select("*", "_key.*"), "turns")
    # Only rows that have an equal one in their chat are joined.
    chat = ["known", "id"]
    again = placed.groupBy(*chat, "h", "l").agg(F.min("_before").alias("_first"), F.count(F.lit(1)).alias("_n"))
    seen = placed.join(again.where("_n > 1").drop("_n"), [*chat, "h", "l"], "left")
    visible = F.regexp_extract("text", rf"([^{SPACE}])[{SPACE}]*\z", 1)
    marked = seen.select(
        *chat,
        F.floor(F.col("_before") / SEGMENT).alias("segment"),
        F.ceil(F.col("_total") / SEGMENT).alias("segments"),
        "_before",
        "turn",
        "role",
        "text",
        "copies",
        (visible == "").alias("blank"),
        F.coalesce(F.col("_before") > F.col("_first"), F.lit(False)).alias("duplicate"),
        (~visible.isin(".", "!", "?")).alias("truncated"),
    )
    cut = marked.repartition(*chat, "segment").sortWithinPartitions(*chat, "segment", "_before")
    parts = keep(
        small_batches(cut).mapInArrow(
            _search_segments,
            "known boolean, id string, segment bigint, segments bigint, cells array<struct<entry:int,leave:int,cost:bigint,audit:string>>, "
            "faults array<bigint>, first_turn bigint, last_turn bigint, turns bigint, first string, last string, sha string",
        ),
        "segments",
    )
    done = keep(_joined(parts), "chats")
    long = done.where("sha IS NULL")
    picked = long.select(*chat, F.posexplode("picks").alias("segment", "_pick")).select(*chat, F.col("segment").cast("bigint"), "_pick.*")
    lines = marked.where("segments > 1").join(picked, [*chat, "segment"])
    lines = lines.repartition(*chat).sortWithinPartitions(*chat, "_before")
    hashed = small_batches(lines.select(*chat, "segment", "role", "text", "copies", "entry", "audit")).mapInArrow(
        _hash_chats, "known boolean, id string, sha string"
    )
    short = done.where("sha IS NOT NULL").drop("picks")
    all_done = short.unionByName(long.drop("picks", "sha").join(hashed, chat))
    return all_done.select(
        F.when(F.col("known"), F.col("id")).cast(kind).alias("conv_id"),
        "gaps",
        "blank",
        "duplicate",
        "truncated",
        "illegal",
        "cost",
        "audit",
        F.col("sha").alias("repaired_sha256"),
    )


def every_chat(found: DataFrame, turns: DataFrame) -> DataFrame:
    """``found`` with zeros for the chats of ``turns`` that it has no row of."""
    ids = turns.select("conv_id").distinct().withColumnRenamed("conv_id", "_id")
    joined = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        F.col("_id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"),
    )


def _runs(batches, keys: list[str]):
    """Dictionaries of the rows of Arrow batches, with whether a row begins a new run of equal ``keys``."""
    before = None
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        for k in range(batch.num_rows):
            row = {name: values[k] for name, values in columns.items()}
            key = tuple(row[name] for name in keys)
            yield key != before, row
            before = key


def _search_segments(batches):
    held: list[dict] = []
    out: list[dict] = []
    for new, row in _runs(batches, ["known", "id", "segment"]):
        if new and held:
            out.append(_segment(held))
            held = []
            if len(out) >= 512:
                yield _as_batch(out)
                out = []
        held.append(row)
    if held:
        out.append(_segment(held))
    if out:
        yield _as_batch(out)


_CELL = pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _as_batch(rows: list[dict]) -> pa.RecordBatch:
    typed = {"cells": _CELL, "faults": pa.list_(pa.int64())}
    typed |= dict.fromkeys(["first_turn", "last_turn"], pa.int64()) | {"sha": pa.string()}
    arrays = [pa.array([r[name] for r in rows], typed.get(name)) for name in rows[0]]
    return pa.RecordBatch.from_arrays(arrays, names=list(rows[0]))


def _segment(rows: list[dict]) -> dict:
    """The faults of a segment and its cheapest edits: of a whole chat, or for every entry and exit state."""
    steps: list[Row] = []
    texts: list[tuple[str, str, int]] = []
    blank = duplicate = truncated = illegal = turns = 0
    last, seen = None, None
    first_turn = next((r["turn"] for r in rows if r["turn"] is not None), None)
    for r in rows:
        copies, initial = r["copies"], r["role"][:1]
        blank += copies if r["blank"] else 0
        again = 0 if r["blank"] else copies if r["duplicate"] else copies - 1
        duplicate += again
        cut = not r["blank"] and not r["duplicate"] and r["truncated"]
        truncated += cut
        illegal += (last is not None and last + initial not in LEGAL) + copies - 1
        last = initial
        if r["turn"] is not None and r["turn"] != seen:
            turns, seen = turns + 1, r["turn"]
        steps.append(Row(initial, r["blank"] or r["duplicate"], cut, copies - 1))
        texts.append((r["role"], r["text"], copies))
    out = {k: rows[0][k] for k in ("known", "id", "segment", "segments")}
    whole = rows[0]["segments"] == 1
    begins = (0,) if rows[0]["segment"] == 0 else range(4)
    if whole:
        found = [(0, -1, *search(steps))]
    else:
        found = [(e, x, *best) for e in begins for x in range(4) if (best := search(steps, e, (x,)))]
    out["cells"] = [dict(zip(("entry", "leave", "cost", "audit"), cell)) for cell in found]
    out["faults"] = [blank, duplicate, truncated, illegal]
    out |= {"first_turn": first_turn, "last_turn": seen, "turns": turns, "first": rows[0]["role"][:1], "last": last}
    out["sha"] = hashlib.sha256("\n".join(applied(found[0][3], texts)).encode()).hexdigest() if whole else None
    return out


def _joined(parts: DataFrame) -> DataFrame:
    """One row per chat: faults, cost, audit; ``picks`` (entry, audit) of every segment where there are several."""
    ordered = parts.repartition("known", "id").sortWithinPartitions("known", "id", "segment")
    fields = (
        "known boolean, id string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
        "cost bigint, audit string, picks array<struct<entry:int,audit:string>>, sha string"
    )
    return small_batches(ordered).mapInArrow(_join_segments, fields)


class Chat:
    """The segments of one chat joined so far.

    For every state the cheapest way to it: (cost, audit, steps), steps being (entry, audit) per segment. What all ways
    have in common is set aside, so that a way stays short however long the chat is.
    """

    def __init__(self, row: dict):
        self.known, self.id = row["known"], row["id"]
        self.ways: dict[int, tuple] = {0: (0, "", ())}
        self.audit: list[str] = []
        self.picks: list[tuple[int, str]] = []
        self.faults = [0, 0, 0, 0]
        self.turns, self.low, self.high, self.last, self.sha = 0, None, None, None, None

    def take(self, row: dict) -> None:
        ways: dict[int, tuple] = {}
        for cell in row["cells"]:
            if cell["entry"] in self.ways:
                cost, audit, steps = self.ways[cell["entry"]]
                way = (cost + cell["cost"], audit + cell["audit"], (*steps, (cell["entry"], cell["audit"])))
                if cell["leave"] not in ways or way[:2] < ways[cell["leave"]][:2]:
                    ways[cell["leave"]] = way
        shared = 0
        all_steps = [w[2] for w in ways.values()]
        while all(len(s) > shared for s in all_steps) and len({s[shared] for s in all_steps}) == 1:
            shared += 1
        common = all_steps[0][:shared]
        size = sum(len(a) for _, a in common)
        self.picks += common
        self.audit += [a for _, a in common]
        self.ways = {x: (cost, audit[size:], steps[shared:]) for x, (cost, audit, steps) in ways.items()}
        for k, n in enumerate(row["faults"]):
            self.faults[k] += n
        self.faults[3] += self.last is not None and self.last + row["first"] not in LEGAL
        self.last, self.sha = row["last"], row["sha"]
        if row["first_turn"] is not None:
            self.turns += row["turns"] - (self.high == row["first_turn"])
            self.low = row["first_turn"] if self.low is None else self.low
            self.high = row["last_turn"]

    def result(self) -> dict:
        cost, audit, steps = min((w for x, w in self.ways.items() if x in (*SOUND, -1)), key=lambda w: w[:2])
        names = ("blank", "duplicate", "truncated", "illegal")
        picks = None if self.sha is not None else [{"entry": e, "audit": a} for e, a in (*self.picks, *steps)]
        return {
            "known": self.known,
            "id": self.id,
            "gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns,
            **dict(zip(names, self.faults)),
            "cost": cost,
            "audit": "".join(self.audit) + audit,
            "picks": picks,
            "sha": self.sha,
        }


_PICKS = pa.list_(pa.struct([("entry", pa.int32()), ("audit", pa.string())]))


def _join_segments(batches):
    chat, out = None, []

    def as_batch():
        arrays = [pa.array([r[n] for r in out], {"picks": _PICKS, "sha": pa.string()}.get(n)) for n in out[0]]
        return pa.RecordBatch.from_arrays(arrays, names=list(out[0]))

    for new, row in _runs(batches, ["known", "id"]):
        if new:
            if chat:
                out.append(chat.result())
                if len(out) >= 1024:
                    yield as_batch()
                    out.clear()
            chat = Chat(row)
        chat.take(row)
    if chat:
        out.append(chat.result())
        yield as_batch()


def _hash_chats(batches):
    """The hash of the repaired lines of chats of several segments, one segment in memory at a time."""
    digest = held = chat = None
    begun = False

    def feed():
        nonlocal begun
        rows = [(r["role"], r["text"], r["copies"]) for r in held]
        for line in applied(held[0]["audit"], rows, held[0]["entry"]):
            digest.update((("\n" if begun else "") + line).encode())
            begun = True

    def result():
        return pa.RecordBatch.from_pylist([{"known": chat[0], "id": chat[1], "sha": digest.hexdigest()}])

    for new, row in _runs(batches, ["known", "id", "segment"]):
        if new:
            if held:
                feed()
            held = []
            if (row["known"], row["id"]) != chat:
                if chat:
                    yield result()
                chat, digest, begun = (row["known"], row["id"]), hashlib.sha256(), False
        held.append(row)
    if held:
        feed()
        yield result()

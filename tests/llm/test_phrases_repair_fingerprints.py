"""Collocations, chat repair and multiset fingerprints against brute force and SQL."""

import collections
import hashlib
import random
import re
import zlib
from functools import lru_cache

import check
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import chat_repair, collocations, multiset_hash, queries


@pytest.mark.parametrize("name", ["op11_collocations", "op12_chat_repair", "op13_multiset_hash"])
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.01" if name == "op11_collocations" else "/root/testdata/sf0.001"
    line = check.compare(spark, check.connect(sf), name, queries.QUERIES[name], queries.ORACLE[name], sf)
    assert line.startswith("ok"), line


# --- collocations ---------------------------------------------------------------------------------------
def brute_collocations(rows, least, first):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in good.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in good.items()):
                continue
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_collocations_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(collocations, "HELD", held)
    rng = random.Random(2)
    vocabulary = ["The", "of", "é", "STRASSE", "x-y", " nb", "日本"] + [f"w{i}" for i in range(12)]
    texts = []
    for _ in range(250):
        words = [rng.choice(vocabulary[: rng.choice([4, 19])]) for _ in range(rng.randrange(0, 60))]
        texts.append("".join(w + rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n", "\r", " ; "]) for w in words))
    rows = [(t, rng.choice(["en", "de", None, "und"])) for t in texts]
    rows += [(None, "en"), ("", "fr"), (" . ", None), ("alone", "it"), rows[0], rows[0], ("a " * 3000, "long"), ("a b. " * 700, "en")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, phrase string, n int")
    found = sorted(tuple(r) for r in collocations.collocations(docs, least=7, first=25).collect())
    assert found == brute_collocations(rows, 7, 25)
    assert len({r[0] for r in found}) >= 4
    assert collocations.collocations(docs, least=10**6).count() == 0
    for n in range(1, 5):
        few = spark.createDataFrame([(" ".join("abcd"[:n]), "en")], "text string, lang string")
        assert sorted(tuple(r) for r in collocations.collocations(few, least=1).collect()) == brute_collocations([(" ".join("abcd"[:n]), "en")], 1, 2000)
    assert collocations.collocations(docs.limit(0), least=1).count() == 0


# --- chat repair ----------------------------------------------------------------------------------------
def brute_repair(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, hash) of (role, text) rows in order, by suffix recursion."""
    faults, seen, steps = [0, 0, 0], set(), []
    for role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            faults[fault] += 1
        steps.append((role[:1], fault))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def least(i, last, inserts):
        options = [(0, "")] if i == len(steps) and last in ("", "a") else []
        for role in "ua":
            if (last, role) in after and inserts < 3:
                rest = least(i, role, inserts + 1)
                options += [(rest[0] + 3, "I" + rest[1])] if rest else []
        if i < len(steps):
            initial, fault = steps[i]
            moves = [("D", 4, last)]
            if fault not in (0, 1):
                extra = 3 if fault == 2 else 0
                moves += [("R", 3 + extra, r) for r in "ua" if (last, r) in after]
                moves += [("K", extra, initial)] if (last, initial) in after else []
            for letter, cost, state in moves:
                rest = least(i + 1, state, 0)
                options += [(rest[0] + cost, letter + rest[1])] if rest else []
        return min(options, default=None)

    cost, audit = least(0, "", 0)
    lines, at, last = [], 0, ""
    for letter in audit:
        role = {"u": "assistant"}.get(last, "user") if letter in "RI" else None
        if letter == "I":
            lines.append(f"{role}:")
        else:
            if letter != "D":
                role = role or rows[at][0]
                lines.append(f"{role}:{rows[at][1]}")
            at += 1
        last = last if letter == "D" else role[0]
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(steps, steps[1:]))
    return (*faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        out += [] if fate == 0 else [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def expected(original):
    chats = collections.defaultdict(list)
    for r in damage(original):
        chats[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in original}:
        rows = sorted(chats[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = {r[1] for r in rows if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *brute_repair([(r[2], r[3]) for r in rows]))
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("segment", [128, 3, 1])
def test_repair_equals_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(chat_repair, "SEGMENT", segment)
    rng = random.Random(segment)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \t", "Well.  ", "é", "One.\nTwo", None]
    rows = []
    for conv in range(220):
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "unknown"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, rng.choice(texts)))
    rows += [(None, 0, "user", "A null chat."), (500, None, None, None), (501, 3, "user", "Same."), (501, 3, "user", "Same.")]
    rows += [(502, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(60)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, audit string")
    found = chat_repair.every_chat(chat_repair.repair(chat_repair.damaged(table)), table)
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found.collect()} == expected(rows)
    assert chat_repair.every_chat(chat_repair.repair(table.limit(0)), table.limit(0)).count() == 0


def test_search_keeps_to_its_goals():
    rng = random.Random(9)
    for _ in range(300):
        rows = [chat_repair.Row(rng.choice("suatx"), rng.random() < 0.2, rng.random() < 0.3, rng.choice([0, 0, 2])) for _ in range(rng.randrange(7))]
        middle = rng.randrange(len(rows) + 1)
        whole = chat_repair.search(rows)
        parts = []
        for state in range(4):
            head, tail = chat_repair.search(rows[:middle], 0, (state,)), chat_repair.search(rows[middle:], state)
            if head and tail:
                parts.append((head[0] + tail[0], head[1] + tail[1]))
        assert whole == min(parts)
    long = [chat_repair.Row(rng.choice("ua"), rng.random() < 0.1, rng.random() < 0.1) for _ in range(5000)]
    assert chat_repair.search(long)[0] > 0


# --- fingerprints ---------------------------------------------------------------------------------------
def brute_fingerprint(text):
    total, lanes = 0, [0] * multiset_hash.LANES
    for line in text.split("\n"):
        parts = [line] if len(line) <= multiset_hash.LONG_LINE else re.sub(r"([.!?]) ", "\\1 \n", line).split("\n")
        for p in parts:
            weight = max(1, int(len(p) ** 0.5))
            first = hashlib.sha256(p.encode()).hexdigest()
            total += weight
            for t, digit in enumerate(first + hashlib.sha256(first.encode()).hexdigest()):
                lanes[t] += weight * int(digit, 16)
    return "".join(f"{x % 2**31:08x}" for x in (total, *lanes))


def prose(rng, lines):
    return "\n".join(" ".join(rng.choice(["Alpha", "beta,", "gamma.", "délta", "日本", "eps!"]) + str(rng.randrange(999)) for _ in range(rng.randrange(1, 60))) for _ in range(lines))


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [prose(rng, rng.randrange(1, 12)) for _ in range(40)] + ["", None, "\n", "x", "One. Two! " * 40, "é" * 400, "a\nb\na", "b\na\na"]
    rows = [(i * 3 - 5, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "no id", "c", 1), (None, None, "c", 1), (4, "second", "c", 1), (1, texts[2], "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, next string, n_chars int")
    found = multiset_hash.edited_halves(docs)
    hexed = [multiset_hash.as_hex(F.col(c)).alias(c) for c in ("found", "edited", "next")]
    found = found.select("doc_id", "n_chars", "edited_sha256", *hexed).collect()
    order = sorted({(r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest(), r[1] or "") for r in rows})
    wanted = []
    for k, (known, doc, _, text) in enumerate(order):
        after, half = order[(k + 1) % len(order)][3], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        prints = [brute_fingerprint(t) for t in (text, edited, after)]
        wanted.append((doc if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), *prints))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))
    assert multiset_hash.edited_halves(docs.limit(0)).count() == 0
    one = multiset_hash.edited_halves(docs.where("doc_id = 7")).first()
    assert one.found == one.next and one.n_chars == len(texts[4])


def test_fingerprints_add_remove_and_compare(spark):
    rng = random.Random(7)
    texts = []
    for i in range(60):
        lines = [f"Paragraph {rng.randrange(10**9)} " + "word " * rng.randrange(5, 25) for _ in range(40)]
        share = rng.randrange(41)
        other = lines[:share] + [f"Else {rng.randrange(10**9)} " + "word " * rng.randrange(5, 25) for _ in range(40 - share)]
        rng.shuffle(other)
        every = {"a": lines, "b": other, "turned": lines[::-1], "joined": [*lines, *other]}
        texts += [(i, share / 40, name, "\n".join(t)) for name, t in every.items()]
    made = multiset_hash.fingerprints(spark.createDataFrame(texts, "id int, share double, name string, text string"), ["id", "share", "name"])
    table = made.groupBy("id", "share").pivot("name", ["a", "b", "turned", "joined"]).agg(F.first("fingerprint"))
    a, b, joined = F.col("a"), F.col("b"), F.col("joined")
    found = table.select(
        "share",
        multiset_hash.likeness(a, b).alias("near"),
        (a == F.col("turned")).alias("same"),
        (multiset_hash.added(a, b) == joined).alias("sum"),
        (multiset_hash.removed(joined, b) == a).alias("back"),
    ).collect()
    assert len(found) == 60 and all(r.same and r.sum and r.back and abs(r.near - r.share) < 0.35 for r in found)
    assert sum(abs(r.near - r.share) for r in found) / len(found) < 0.1
    empty = multiset_hash.fingerprints(spark.createDataFrame([(1, ""), (2, None), (3, "x")], "k int, text string"), ["k"])
    prints = {r.k: r.fingerprint for r in empty.collect()}
    assert prints[1] == prints[2] != prints[3]
    pair = spark.createDataFrame([(prints[1], prints[2], prints[3])], "a struct<total:int,lanes:array<int>>, b struct<total:int,lanes:array<int>>, c struct<total:int,lanes:array<int>>")
    near = pair.select(multiset_hash.likeness(a, b), multiset_hash.likeness(a, F.col("c"))).first()
    assert near[0] == 1.0 and near[1] < 0.4


def test_fingerprints_stay_in_the_jvm(spark, sf):
    plan = queries.op13_multiset_hash(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

"""Toxicity: a learned lexicon whose misspellings an automaton finds, and windows that tell quotation from abuse."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.words import append_columns, slices, small_batches, split_words, starts_of
from corpusmill.session import keep

#: Labelled rows per class that the model is fitted on, lexicon size, rows and odds a term needs, terms a row is covered
#: by, clean words near a term that are remembered, words on either side of a hit that are its window.
ROWS_PER_CLASS, TERMS, LEAST_ROWS, LEAST_ODDS, COVER, EXCEPTIONS, WINDOW = 8000, 400, 3, 6.0, 3, 20000, 6
#: A term of this many letters may be misspelled by one edit. Stems are this long.
FUZZY_FROM, STEMS = 5, range(3, 8)
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’‚‹›¿¡…—–"
QUOTES = "\"«»“”„‹›"
REPORTING = frozenset(
    "said says saying wrote writes quoted quote quotes called calls reported sagte schrieb nannte zitat zitierte dit "
    "écrit appelé cité citation dijo escribió llamó citó cita".split()
)
ADDRESS = frozenset("you your yours you're youre ur du dich dein deine ihr sie tu toi ton vous votre tú ti usted eres".split())
FEATURES = 7


class Lexicon:
    """Terms and stems (``*`` at the end) in a trie, searched with a Levenshtein automaton.

    The automaton of a word and the trie are walked together: a state is a node of the trie and the fewest edits with
    which the letters read so far lead there. States of the first letters are shared between words.
    """

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.stem: list[int] = [-1]
        for i, term in enumerate(terms):
            node = 0
            for letter in term.rstrip("*"):
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                node = self.children[node][letter]
            (self.stem if term.endswith("*") else self.word)[node] = i
        self.start = self._close({0: 0})
        self.shared: dict[str, tuple[dict[int, int], int, int]] = {"": (self.start, -1, -1)}

    def _close(self, states: dict[int, int]) -> dict[int, int]:
        """With the letters of the term that the word may leave out."""
        for node, edits in list(states.items()):
            if edits == 0:
                for child in self.children[node].values():
                    states.setdefault(child, 1)
        return states

    def _step(self, states: dict[int, int], letter: str) -> dict[int, int]:
        out: dict[int, int] = {}
        for node, edits in states.items():
            children = self.children[node]
            match = children.get(letter)
            if match is not None and out.get(match, 2) > edits:
                out[match] = edits
            if edits == 0:
                out.setdefault(node, 1)
                for child in children.values():
                    out.setdefault(child, 1)
        return self._close(out) if 0 in out.values() else out

    def _after(self, prefix: str) -> tuple[dict[int, int], int, int]:
        """The states after ``prefix``, the stem it starts with and the one it starts with misspelled (or -1)."""
        found = self.shared.get(prefix)
        if found is None:
            found = self._advance(*self._after(prefix[:-1]), prefix[-1])
            if len(self.shared) > 200_000:
                self.shared = {"": (self.start, -1, -1)}
            self.shared[prefix] = found
        return found

    def _advance(self, states, stem, near, letter):
        # A misspelled stem has to end in its own last letter: without that, any word of a shorter prefix would be one.
        for node, edits in states.items():
            term = self.stem[self.children[node].get(letter, 0)]
            if edits == 1 and term >= 0 and len(self.terms[term]) > FUZZY_FROM and (near < 0 or term < near):
                near = term
        states = self._step(states, letter) if states else states
        if stem < 0:
            for node, edits in states.items():
                if edits == 0 and self.stem[node] >= 0:
                    stem = self.stem[node]
        return states, stem, near

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the best term that ``word`` is (a stem: starts with), or misspells by one edit; else None."""
        states, stem, near = self._after(word[:4])
        for letter in word[4:]:
            if stem >= 0 or not states:
                break
            states, stem, near = self._advance(states, stem, near, letter)
        if stem >= 0:
            return stem, 0
        best = (near, 1) if near >= 0 else None
        for node, edits in states.items():
            term = self.word[node]
            if term >= 0 and (edits == 0 or len(self.terms[term]) >= FUZZY_FROM):
                if best is None or (edits, term) < (best[1], best[0]):
                    best = (term, edits)
        return best


@dataclass
class ToxicityModel:
    terms: list[str] = field(default_factory=list)
    exact: list[float] = field(default_factory=list)
    fuzzy: list[float] = field(default_factory=list)
    exceptions: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))


def normal(word: str) -> str:
    return word.strip(EDGES).lower()


def _terms_of(words) -> set[str]:
    out = set()
    for word in words:
        if len(word) >= 3:
            out.add(word)
            out.update(f"{word[:k]}*" for k in STEMS if k < len(word))
    return out


def _mine(rows: DataFrame) -> DataFrame:
    """(term, toxic rows, clean rows) of the words and stems of labelled texts, by distinct text rows."""

    def run(batches):
        for part in slices(batches):
            codes, dictionary, counts = split_words(part.column("text"))
            words = [normal(w) for w in dictionary.to_pylist()]
            at, toxic = starts_of(counts), part.column("toxic").to_pylist()
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for i, label in enumerate(toxic):
                seen[label].update(_terms_of({words[c] for c in set(codes[at[i] : at[i + 1]].tolist())}))
            terms = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), *(pa.array([seen[k][t] for t in terms], pa.int64()) for k in (1, 0))],
                names=["term", "t", "n"],
            )

    counted = rows.mapInArrow(run, "term string, t bigint, n bigint")
    return counted.groupBy("term").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))


def choose_terms(found: list[tuple[str, int, int]], toxic: int, clean: int, limit: int = 4 * TERMS) -> dict[str, float]:
    """The lexicon: words and stems with their log odds, the most telling first.

    A stem stands for its words only where no single longer stem or word makes up most of its rows; the words and
    stems that it covers are left out.
    """
    rows = {term: t for term, t, _ in found}
    most: dict[str, int] = {}
    for term, t in rows.items():
        bare = term.rstrip("*")
        for k in STEMS:
            if k < len(bare):
                most[bare[:k]] = max(most.get(bare[:k], 0), t)
    stems = {b for x, t in rows.items() if x.endswith("*") and most.get(b := x[:-1], 0) < 0.6 * t}
    out: dict[str, float] = {}
    for term, t, n in found:  # by evidence
        bare = term.rstrip("*")
        covered = any(bare[:k] in stems for k in STEMS if k < len(bare))
        if covered or (term.endswith("*") and bare not in stems) or (not term.endswith("*") and bare in stems):
            continue
        out[term] = min(8.0, math.log((t + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1)))
        if len(out) == limit:
            break
    return out


def _present(rows: DataFrame, terms: list[str]) -> DataFrame:
    """(terms) of every toxic text: the numbers of the terms that are in it."""

    def run(batches):
        place = {t: i for i, t in enumerate(terms)}
        for part in slices(batches):
            codes, dictionary, counts = split_words(part.column("text"))
            own = [[place[t] for t in _terms_of([normal(w)]) if t in place] for w in dictionary.to_pylist()]
            at = starts_of(counts)
            found = [sorted({t for c in set(codes[at[i] : at[i + 1]].tolist()) for t in own[c]}) for i in range(len(counts))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["terms"])

    return rows.where("toxic = 1").select("text").mapInArrow(run, "terms array<int>")


def cover(rows: list[list[int]], weights: np.ndarray, limit: int = TERMS) -> list[int]:
    """Terms picked one by one, each with the most weight over rows that hold fewer than ``COVER`` picked terms.

    Words that only come with others, as those of copied texts do, are not picked.
    """
    held = np.zeros((len(rows), len(weights)), dtype=bool)
    for i, terms in enumerate(rows):
        held[i, terms] = True
    held = held[held.any(axis=1)]
    need, out = np.full(len(held), COVER), []
    while len(out) < min(limit, len(weights)):
        fresh = held[need > 0].sum(axis=0)
        gain = np.where(fresh >= LEAST_ROWS, fresh * weights, 0.0)
        gain[out] = 0.0
        best = int(gain.argmax())
        if gain[best] <= 0:
            break
        out.append(best)
        need -= held[:, best]
    return out


def _hits(lexicon: Lexicon, words: list[str], exceptions=frozenset()) -> dict[int, tuple[int, int]]:
    out = {}
    for code, raw in enumerate(words):
        if len(word := normal(raw)) >= 3 and (hit := lexicon.find(word)) and not (hit[1] and word in exceptions):
            out[code] = hit
    return out


def _variants(rows: DataFrame, terms: list[str]) -> DataFrame:
    """(word, term, half, toxic rows, clean rows) of the words one edit from a term."""

    def run(batches):
        lexicon = Lexicon(terms)
        for part in slices(batches):
            codes, dictionary, counts = split_words(part.column("text"))
            words = dictionary.to_pylist()
            hits = {c: (normal(words[c]), hit[0]) for c, hit in _hits(lexicon, words).items() if hit[1]}
            near = np.isin(codes, np.fromiter(hits, np.int64, len(hits)))
            row = np.repeat(np.arange(len(counts)), counts)[near]
            toxic, half = part.column("toxic").to_pylist(), part.column("half").to_pylist()
            seen = Counter()
            for r, key in {(r, hits[c]) for r, c in zip(row.tolist(), codes[near].tolist())}:
                seen[(*key, half[r], toxic[r])] += 1
            yield pa.RecordBatch.from_pylist(
                [{"word": w, "term": t, "half": h, "t": n * x, "n": n * (1 - x)} for (w, t, h, x), n in seen.items()],
                schema=pa.schema([("word", pa.string()), ("term", pa.int64()), ("half", pa.int64()), ("t", pa.int64()), ("n", pa.int64())]),
            )

    found = rows.mapInArrow(run, "word string, term bigint, half bigint, t bigint, n bigint")
    return found.groupBy("word", "term", "half").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))


def _ordinary(near: DataFrame, toxic: int, clean: int) -> DataFrame:
    """(word, clean rows) of the words near a term that in half 0, of so many rows a class, are not commoner in toxic rows."""
    seen = near.where("half = 0").groupBy("word").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    return seen.where((F.col("n") > 0) & (F.col("t") * clean <= F.col("n") * toxic)).select("word", "n")


def _context(words: list[str], at: int) -> str:
    """``quoted``, ``addressed`` or ``plain``, from the window around a hit."""
    before, after = words[max(0, at - WINDOW) : at], words[at + 1 : at + 1 + WINDOW]
    marks = sum(c in QUOTES for w in before for c in w) + sum(c in QUOTES for c in words[at][: len(words[at]) // 2])
    closes = any(c in QUOTES for w in [words[at], *after] for c in w)
    if (marks % 2 and closes) or (closes and any(normal(w) in REPORTING for w in before)):
        return "quoted"
    return "addressed" if any(normal(w) in ADDRESS for w in before + after) else "plain"


def features(texts: pa.Array, lexicon: Lexicon, model: ToxicityModel) -> np.ndarray:
    """Per text: strongest and summed weight of hits outside quotations, summed quoted, addressed and misspelled
    weight, the summed weight of different terms, and the share of words that are hits."""
    codes, dictionary, counts = split_words(texts)
    words = dictionary.to_pylist()
    hits = _hits(lexicon, words, model.exceptions)
    out = np.zeros((len(counts), FEATURES))
    marked = np.isin(codes, np.fromiter(hits, np.int64, len(hits)))
    at = starts_of(counts)
    position = np.flatnonzero(marked)
    row = np.searchsorted(at, position, side="right") - 1
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(row)]):
        r = int(row[begin])
        first, last = at[r], at[r + 1]
        terms, sums = {}, {"plain": 0.0, "quoted": 0.0, "addressed": 0.0}
        for p in position[begin:end].tolist():
            term, edits = hits[int(codes[p])]
            weight = model.fuzzy[term] if edits else model.exact[term]
            low, high = max(first, p - WINDOW), min(last, p + 1 + WINDOW)
            where = _context([words[c] for c in codes[low:high].tolist()], p - low)
            sums[where] += weight
            if edits:
                out[r, 4] += weight
            if where != "quoted":
                out[r, 0] = max(out[r, 0], weight)
                out[r, 6] += weight > 0
                terms[term] = max(weight, terms.get(term, 0.0))
        out[r, 1:4] = np.log1p([sums["plain"] + sums["addressed"], sums["quoted"], sums["addressed"]])
        out[r, 4], out[r, 5], out[r, 6] = math.log1p(out[r, 4]), sum(terms.values()), out[r, 6] / max(1, last - first) * 10
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression with a squared penalty, by Newton's method; the last one is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows_per_class: int = ROWS_PER_CLASS,
    seed: int = 9,
) -> ToxicityModel:
    """Learn lexicon, weights and regression from whole texts of at most ``rows_per_class`` labelled rows per class.

    The rows with the smallest id hashes are taken. Null ids, labels and texts, and ids that only one of the tables
    has, are not used; of an id labelled more than once the largest label counts, of one with several texts the
    smallest text. Without toxic rows the model has
    no terms and gives every text the share of toxic rows, 0 where there are none.

    Half of the sample shows which near spellings are clean words, the other half weighs the rest of them.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.where("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    chosen = known.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rows_per_class)
    chosen = chosen.select("id", "toxic", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(2)).alias("half"))
    texts = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id", "toxic", "half").agg(F.min("text").alias("text"))
    sample = keep(sample.select("text", "toxic", "half"), "labelled")
    sizes = {(r.toxic, r.half): r.n for r in sample.groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = (sum(n for (t, _), n in sizes.items() if t == k) for k in (1, 0))
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    model = ToxicityModel()
    model.weights[-1] = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
    if not toxic:
        return model
    odds = (F.col("t") + 0.5) / (toxic + 1) / ((F.col("n") + 0.5) / (clean + 1))
    telling = _mine(sample).where((F.col("t") >= LEAST_ROWS) & (odds >= LEAST_ODDS))
    evidence = (F.col("t") * F.log(odds)).alias("evidence")
    found = telling.select("term", "t", "n", evidence).orderBy(F.desc("evidence"), "term").limit(10 * TERMS).collect()
    terms = choose_terms([(r.term, r.t, r.n) for r in found], toxic, clean)
    names, odds_of = list(terms), np.array(list(terms.values()))
    picked = cover([r.terms for r in _present(sample, names).collect()], odds_of) if names else []
    model.terms, model.exact = [names[i] for i in picked], [float(odds_of[i]) for i in picked]
    near = _variants(sample, model.terms)
    ordinary = _ordinary(near, sizes.get((1, 0), 0), sizes.get((0, 0), 0))
    model.exceptions = frozenset(r.word for r in ordinary.orderBy(F.desc("n"), "word").limit(EXCEPTIONS).collect())
    left = near.where("half = 1").join(F.broadcast(ordinary.select("word")), "word", "left_anti")
    seen = {r.term: (r.t, r.n) for r in left.groupBy("term").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect()}
    half = [1 + sizes.get((1, 1), 0), 1 + sizes.get((0, 1), 0)]
    for i, weight in enumerate(model.exact):
        t, n = seen.get(i, (0, 0))
        learned = math.log((t + 0.5) / half[0]) - math.log((n + 0.5) / half[1])
        model.fuzzy.append(min(0.75 * weight, max(0.0, learned)) if t + n else 0.5 * weight)

    def measure(batches):
        lexicon = Lexicon(model.terms)
        for part in slices(batches):
            x = features(part.column("text"), lexicon, model)
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"])

    table = sample.mapInArrow(measure, "toxic int, x array<double>").toArrow().to_pandas()
    table = table.iloc[sorted(range(len(table)), key=lambda i: (table["toxic"][i], *table["x"][i]))]
    x, y = np.array(table["x"].tolist()).reshape(-1, FEATURES), table["toxic"].to_numpy(dtype=float)
    weight = np.where(y == 1, share / max(1, toxic), (1 - share) / max(1, clean)) * len(y)
    model.weights = _logistic(x, y, weight)
    return model


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``toxic`` (1 if that is at least ``cut``, else 0).

    Whole texts count; null, empty and white texts have no hits and get the score of a text without any. Equal texts
    get equal scores. Columns of the same names are replaced, all others kept.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TERMS and EXCEPTIONS
    made: list[Lexicon] = []

    def run(texts: pa.Array):
        model = sent.value
        if not made:
            made.append(Lexicon(model.terms))
        x = features(texts, made[0], model)
        p = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -60, 60)))
        return [pa.array(p), pa.array((p >= cut).astype(np.int32))]

    return append_columns(docs, run, "toxicity double, toxic int", text_col)

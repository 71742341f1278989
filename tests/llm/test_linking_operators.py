"""Near-duplicates, search, packing and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import embedding_dedup, graph, graph_search, packing, queries, simhash


def joined(links, nodes):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components_of_chains_hubs_and_cycles(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(900, 901), (901, 902), (902, 900), (5, 5)]
    links += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(260)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    linked = [(a, b) for a, b in links if a != b]
    assert found == joined(linked, {x for p in linked for x in p})


def test_blocks_hold_every_pair_once(spark):
    members = spark.range(400).select((F.col("id") % 7 == 0).cast("bigint").alias("cell"), F.col("id").alias("node"))
    rows = graph.in_blocks(members, "cell", "node", block_rows=50).toArrow()
    pairs = []
    for table, starts in graph.pieces(rows.to_batches(max_chunksize=37), "cell"):
        node, i, j, block = (table.column(c).to_numpy() for c in ("node", "_i", "_j", "_block"))
        for a, b in graph.pairs_of(starts, len(node), i, j, block, 100):
            pairs += [(min(x, y), max(x, y)) for x, y in zip(node[a].tolist(), node[b].tolist())]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(x, y) for x in range(400) for y in range(x + 1, 400) if (x % 7 == 0) == (y % 7 == 0)}


def test_simhash_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(f"W{rng.randrange(300)}" for _ in range(rng.randrange(1, 200))) for _ in range(150)]
    texts += [t.replace("W7", "w8", 1) + " x" for t in texts[:60]] + [texts[3], texts[3], "", None, "  ", "one", "one two", "é" * 9]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3], (None, "nobody else", "c")], "doc_id bigint, text string, fingerprint string")
    found = simhash.near_duplicates(docs, simhash.single_table(64, 2)).select("doc_id", simhash.as_hex(F.col("fingerprint")), "component_id").collect()
    assert len(found) == len(rows) + 2
    prints = {}
    for i, t, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))] if words else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = joined(links, prints)
    assert {(r[0], r[1], r[2]) for r in found if r[0] is not None} == {(i, f"{p:016x}", roots[i]) for i, p in prints.items()}
    assert simhash.near_duplicates(docs.limit(0), simhash.single_table()).count() == 0


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 24))
    vectors = [base[i % 60] + rng.standard_normal(24) * rng.choice([0, 0.02, 0.2]) for i in range(300)]
    vectors += [base[0] + rng.standard_normal(24) * 0.02 for _ in range(200)]
    rows = [(i, [float(x) for x in v], int(i % 4) if i < 300 else 0) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(1100, rows[0][1], None), (1101, rows[0][1][:20], 0), (1102, rows[0][1], 0)]
    table = spark.createDataFrame([(*r, "c") for r in rows], "vec_id bigint, embedding array<double>, label int, kept string")
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(table).collect()}
    good = [(i, np.array(v) / np.linalg.norm(v), k) for i, v, k in rows if i < 1000 or i in (1101, 1102)]
    links = [(a, b) for a, x, j in good for b, y, k in good if a < b and j == k and len(x) == len(y) and x @ y >= 0.98]
    roots, counts = joined(links, [r[0] for r in rows]), dict.fromkeys([r[0] for r in rows], 0)
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in found.items()} == {i: (counts[i], roots[i], roots[i] == i) for i in counts}
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_search_recall_ties_and_odd_rows(spark, sf):
    rows = queries.op5_graph_search(spark, sf).collect()
    table = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    asked = [i for i in table if i % 20 == 0]
    hits = 0
    for q in asked:
        best = sorted((-(table[i] @ table[q]), i) for i in table if i != q)[:20]
        own = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, len(best) + 1))
        assert all(abs(s - table[i] @ table[q]) < 1e-12 for _, i, s in own)
        hits += len({i for _, i in best} & {i for _, i, _ in own}) / len(best)
    assert hits / len(asked) >= 0.9
    odd = [(i, [1.0, 2.0], 0) for i in range(40)] + [(50, None, 0), (51, [0.0, 0.0], 0), (52, [float("nan"), 1.0], 0), (None, [1.0, 2.0], 0), (60, [1.0, 2.0, 3.0], 0), (0, [1.0, 2.0], 0)]
    few = spark.createDataFrame(odd, "vec_id bigint, embedding array<float>, rank int")
    index = graph_search.build_index(few)
    found = graph_search.search(index, few.where("vec_id IN (0, 39, 50, 60)"), k=20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == sorted(
        [(0, n, n) for n in range(1, 21)] + [(39, n, n - 1) for n in range(1, 21)]
    )
    assert graph_search.search(index, few.limit(0)).count() == 0
    assert graph_search.search(graph_search.build_index(few.limit(0)), few).count() == 0


@pytest.mark.parametrize("counts", ["mixed", "hot", "few", "none"])
def test_packing_covers_every_token(spark, counts):
    rng = np.random.default_rng(2)
    lengths = {"mixed": rng.integers(0, 5000, 800), "hot": np.full(700, 1500), "few": [3, 2049], "none": []}[counts]
    rows = [(i, int(n), "c") for i, n in enumerate(lengths)] + ([(-1, None, "c"), (-2, -5, "c"), (0, 1500, "c")] if counts == "hot" else [])
    docs = spark.createDataFrame(rows, "doc_id bigint, tokens bigint, pieces string")
    cuts = packing.possible_cuts(F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)))
    packed = packing.pack(docs.withColumn("cuts", cuts), "tokens").collect()
    assert len(packed) == len(rows)
    sequences = {}
    for r in packed:
        at = 0
        for p in r.pieces:
            assert p.start == at and p.length > 0 and (p.start, p.length) == tuple(r.cuts[p.cut])
            at += p.length
            sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert at == max(0, r.tokens or 0)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.01 * sum(max(0, r.tokens or 0) for r in packed)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = random.Random(8)
    words = [" ".join(rng.choice("the of and to in is was on re at".split()) + rng.choice(["", "er", "ing", "ed", "ly"]) for _ in range(300)) for _ in range(6)]
    planted = [(10**6 + i, t, "en", "p", 1) for i, t in enumerate(words)]
    planted += [(10**6 + 100 + i, "  " + t.title().replace(" ", "  "), "en", "p", 1) for i, t in enumerate(words)] + [(10**6 + 200, words[0], "en", "p", 1)]
    planted += [(10**6, words[0], "en", "p", 1), (10**6 + 300, "12 34 %%", "en", "p", 1), (10**6 + 301, None, None, None, None)]
    every = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    kept = corpus_pipeline.known_language(spark, every, "/root/testdata/sf0.001")
    assert kept.columns == docs.columns and kept.where("doc_id >= 1000300").count() == 0
    assert kept.count() >= every.count() - 5
    clean = corpus_pipeline.not_toxic(spark, every, "/root/testdata/sf0.001")
    assert clean.columns == docs.columns and clean.where("doc_id BETWEEN 1000000 AND 1000200").count() == 14
    single = corpus_pipeline.one_of_each(spark, every, "/root/testdata/sf0.001")
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.where("doc_id BETWEEN 1000000 AND 1000299").collect()) == [10**6 + i for i in range(6)]
    done = corpus_pipeline.packed(spark, single, "/root/testdata/sf0.001")
    assert done.select("doc_id").distinct().count() == single.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, every.limit(0), "/root/testdata/sf0.001").count() == 0


def test_one_of_each_equals_brute_force(spark):
    rng = random.Random(11)
    docs, word = [], lambda: f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}"
    for family in range(60):
        docs.append([word() for _ in range(rng.randrange(30, 800))])
        for _ in range(3):  # edits one after another, a few words each
            text = list(docs[-1])
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(len(text))] = word()
            docs.append(text)
    docs += [["one", "two"], ["One", "two"], ["one"], ["x"] * 300, ["x"] * 5, [], [" "]]
    rows = [(i, " ".join(t)) for i, t in enumerate(docs)] + [(10**6, None), (3, " ".join(docs[3])), (None, "nobody has this text")]
    prints = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))] if words else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = joined(links, range(len(rows)))
    assert 0 < sum(prints[a] != prints[b] for a, b in links) and 70 < len(set(roots.values())) < len(rows) - 20
    single = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    found = [r.doc_id for r in single.collect()]
    smallest = [min((rows[i][0] for i in roots if roots[i] == top and rows[i][0] is not None), default=None) for top in set(roots.values())]
    assert sorted(found, key=str) == sorted(smallest, key=str)

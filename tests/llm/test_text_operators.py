"""Language model, encoding, toxicity, language and formatting against brute force, round trips and held-out rows."""

import collections
import hashlib
import math
import random
import re

import check
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import bpe, chat_format, language_id, ngram_lm, queries, toxicity, url_filter

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "   ", None, "<|endoftext|>hi<|startoftext|>", "don't we'll I'M", "ΣΑΣ ΌΣΟΣ", "İstanbul ǅ ß ẞ", "á ë́ Å",
    "日本語テキスト 한국어 ab12cd345", "x\x1cy\x1dz \x85 nb\xa0sp", "🙂🙂🙂 👩‍👩‍👧 !!!???", "a" * 5000, "ab" * 300 + "'" + "c" * 70,
    "é" * 100, "A<b> <|endof text|>", "'s's'S ''t", "ª º ² ½ Ⅷ ⅷ ﬁ", "\x00\x01 \x7f",
]


@pytest.mark.parametrize("name", ["op3_url_filter", "op9_chat_format"])
def test_against_sql(spark, sf, name):
    line = check.compare(spark, check.connect(sf), name, queries.QUERIES[name], queries.ORACLE[name], sf)
    assert line.startswith("ok"), line


def test_language_model_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["the", "Of", "and", "x1", "é", "to\u00a0y"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice([6, 66])]) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    rows = [(i, t, "clash") for i, t in enumerate([None, "", " \t\n", *texts, texts[5], texts[5]])]
    rows += [(7, texts[4], "x"), (None, "a null id", "x")]
    fitted = []
    old = ngram_lm._fit
    monkeypatch.setattr(ngram_lm, "_fit", lambda *a: fitted.append(old(*a)) or fitted[-1])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    learn = F.col("doc_id") % 5 != 1
    found = ngram_lm.score(docs, learn).collect()
    cut = re.compile(r"[^\x20\x09-\x0D]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [["<s>", "<s>", *cut.findall((t or "").translate(lower)), None] for _, t, _ in rows]
    seen = [collections.Counter() for _ in range(3)]
    context = [collections.Counter() for _ in range(3)]
    for (i, _, _), s in zip(rows, tokens):
        if i is not None and i % 5 != 1:
            for k in range(2, len(s)):
                for n in range(3):
                    seen[n][tuple(s[k - n : k + 1])] += 1
                    context[n][tuple(s[k - n : k])] += 1
    total, size = sum(seen[0].values()), len(seen[0])
    expected = []
    for (i, _, _), s in zip(rows, tokens):
        base = sum(math.log10((seen[0][(w,)] + 0.5) / (total + 0.5 * (size + 1))) for w in s[2:])
        score = 0.0
        for k in range(2, len(s)):
            p = 1 / (size + 1)
            for n in range(3):
                if h := context[n][tuple(s[k - n : k])]:
                    share = fitted[0].by_order[n][h.bit_length()]
                    p = share * seen[n][tuple(s[k - n : k + 1])] / h + (1 - share) * p
            score += math.log10(p)
        learned = i is not None and i % 5 != 1
        expected.append((i, learned, len(s) - 2, sum(seen[0][(w,)] > 0 for w in s[2:]), total, round(base, 6), round(score, 6)))
    got = [(*r[:5], round(r[5], 6), round(r[6], 6)) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_language_model_without_rows_and_without_training(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert ngram_lm.score(docs.limit(0), F.lit(True)).count() == 0
    row = ngram_lm.score(docs, F.lit(False)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_counts_and_keys_survive_packing():
    counts = np.array([0, 1, 254, 255, 256, 10**12, 3])
    assert (ngram_lm._expand_counts(ngram_lm._squeeze_counts(counts), 7) == counts).all()
    keys = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (ngram_lm._expand_keys(ngram_lm._squeeze_keys(keys), 1000) == keys).all()


def test_encoding_equals_the_library(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    mixed = ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x20, 0x7F), rng.randrange(0x370, 0x500)])) for _ in range(50)) for _ in range(300)]
    texts = [*ODD, *mixed, mixed[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    rows = bpe.decode(bpe.encode(docs, PATH), PATH).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for row, text in zip(rows, texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == ids, text
        assert row.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_encoding_query(spark, sf):
    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op2_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        told = library.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert tuple(row)[1:] == (len(ids), digest, hashlib.sha256(told.encode()).hexdigest())


def test_url_rules_lists_and_odd_rows(spark):
    urls = ["http://a.b.org/x", "HTTP://WWW.Spam.net:80/p//?utm_a=1&q=2#f", "https://spam.net/p?q=2", None, "no url", "x://org", "x://org/", ""]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate([*urls, urls[0]])] + [(None, "z://q/", "c")], "page_id bigint, url string, verdict string")
    rules = [url_filter.Rule("block", "org", "/"), url_filter.Rule("allow", "b.org", "/x")]
    listed = spark.createDataFrame([("http://spam.net/p/?q=2",), (None,), ("bad",)], "url string")
    found = {r.page_id: r for r in url_filter.judge_urls(pages, listed, rules).collect()}
    assert [found[i].verdict for i in range(9)] == ["allow", "block", "block", "allow", "allow", "allow", "block", "allow", "allow"]
    assert [found[i].rule for i in range(9)] == ["b.org/x", None, None, None, None, None, "org/", None, "b.org/x"]
    assert (found[3].host, found[3].path, found[1].listed, found[None].verdict) == ("", "", True, "allow")
    assert url_filter.judge_urls(pages, listed.limit(0), []).where("verdict = 'block'").count() == 0
    assert url_filter.judge_urls(pages.limit(0), listed, rules).count() == 0


def test_bloom_filter_lets_every_listed_url_pass(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.format_string("http://h%d.net/p", "id").alias("url"))
    found = url_filter.judge_urls(pages, pages.where("page_id % 3 = 0").select("url"), [])
    assert found.where((F.col("verdict") == "block") != (F.col("page_id") % 3 == 0)).count() == 0


def test_chats_read_back(spark):
    marks = ["<|im_end|>\n", "<|im_start|>user\n", "<|im_next|>", "<|lt|>|", "<", "|im_end|>", "<|", "<<||>", "\n"]
    rows = [(1, t, "assistant" if t % 3 else "user", m + "é" + m, "x") for t, m in enumerate(marks)]
    rows += [(2, 0, None, None, "x"), (2, 0, None, None, "x"), (2, None, "a<|n|>\nb", "", "x"), (None, 1, "assistant", "hi", "x")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    chats = chat_format.format_chats(turns)
    out = chats.select("*", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("pieces")).alias("loss"))
    found = {r.conv_id: r for r in out.collect()}
    assert [tuple(t) for t in found[1].turns] == [(r[2], r[3]) for r in rows if r[0] == 1]
    assert found[1].loss == "".join(r[3] for r in rows if r[0] == 1 and r[2] == "assistant")
    assert [tuple(t) for t in found[2].turns] == [("a<|n|>\nb", ""), ("", ""), ("", "")]
    assert found[None].loss == "hi" and found[1].formatted == "".join(p.text for p in found[1].pieces)
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_languages_held_out_and_rejected(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op10_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("accepted").cast("int"))).first()
    assert right[0] > 0.98 and right[1] > 0.99
    model = language_id.train(docs)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 %%", "x"), (4, "the " * 50_000, "x")], "doc_id bigint, text string, score string")
    rows = {r.doc_id: r for r in language_id.classify(odd, model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and not rows[1].accepted and rows[4].accepted
    assert language_id.classify(odd.limit(0), model).count() == 0
    nothing = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.classify(odd, nothing).collect()} == {"und"}


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    terms = ["idiot", "moron", "scum", "worthless", "idaho"]
    lexicon, rng = toxicity.Lexicon([*terms, "lowei*"]), random.Random(1)
    for _ in range(4000):
        word = list(rng.choice(terms))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice([[], ["o"], ["x"]])
        word = "".join(word)
        near = [(d, i) for i, t in enumerate(terms) if (d := distance(word, t)) == 0 or (d == 1 and len(t) >= 5)]
        assert lexicon.find(word) == ((min(near)[1], min(near)[0]) if near else None), word
    assert lexicon.find("loweiung") == (5, 0) and lexicon.find("lowe") is None


def test_toxicity_held_out_misspelled_quoted_and_empty(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op6_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    caught = [r.predicted for r in rows if r.toxic]
    assert sum(caught) >= 0.85 * len(caught) and sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows)
    model = toxicity.ToxicityModel(["idiot"], [8.0], [4.0], frozenset(), np.array([1.0, 1, -1, 0, 0, 0, 0, -6]))
    texts = [None, "", "you idiot", "you idyot", 'she said "idiot" to us', "a fine day", "word " * 60_000 + "idiot"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, toxic string")
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert [found[i].toxic for i in range(7)] == [0, 0, 1, 0, 0, 0, 1]
    assert found[2].toxicity > found[3].toxicity > found[4].toxicity and found[0].toxicity == found[1].toxicity
    plain = toxicity.train(docs, labels.limit(0))
    assert {r.toxic for r in toxicity.score(docs, plain).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_misspelled_stems_are_found():
    found = [(w, 40, 0) for w in ("idiot", "idiots", "idiotic")] + [("idiot*", 120, 0), ("idio*", 120, 0), ("idi*", 120, 0)]
    terms = list(toxicity.choose_terms(sorted(found, key=lambda x: -x[1]), 200, 200))
    assert terms == ["idiot*"]
    lexicon = toxicity.Lexicon([*terms, "scu*"])
    assert {lexicon.find(w) for w in ("idyotic", "idot", "idots", "iddiots", "xidiotic", "diotic")} == {(0, 1)}
    assert lexicon.find("idiotic") == (0, 0) and lexicon.find("scum") == (1, 0)
    assert {lexicon.find(w) for w in ("idio", "idyll", "idiom", "ixyot", "scx", "skum")} == {None}


def test_a_misspelling_in_one_clean_row_is_no_exception(spark):
    rows = [("idyot", 0, 0, 30, 1), ("idyot", 0, 1, 0, 9), ("idiom", 0, 0, 0, 1), ("idiots", 0, 0, 2, 90), ("idoit", 0, 0, 5, 0)]
    near = spark.createDataFrame(rows, "word string, term bigint, half bigint, t bigint, n bigint")
    assert {(r.word, r.n) for r in toxicity._ordinary(near, 100, 4000).collect()} == {("idiom", 1), ("idiots", 90)}
    fillers = [f"v{i % 7} w{i % 11} x{i}" for i in range(400)]
    texts = [(i, f"{f} you idiot" if i % 3 else f"{f} you idyot") if i < 60 else (i, f) for i, f in enumerate(fillers)]
    texts += [(1000 + i, f"he wrote idyot {i}") for i in range(2)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i, _ in texts], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    assert "idyot" not in model.exceptions


def test_training_takes_one_row_of_an_id(spark, monkeypatch):
    rows = [(1, f"same id {i % 50}", "ab"[i % 2]) for i in range(400)] + [(2, "two", "b"), (3, "three", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    seen = []
    bags, kept = language_id._bags, toxicity.keep
    monkeypatch.setattr(language_id, "_bags", lambda x: seen.append(x.count()) or bags(x))
    monkeypatch.setattr(toxicity, "keep", lambda x, name: seen.append(x.count()) or kept(x, name))
    language_id.train(docs, epochs=1)
    toxicity.train(docs, spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "doc_id bigint, toxic int"))
    assert seen == [3, 3]

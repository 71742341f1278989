"""Corpus statistics, output reports and text overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.catalog import base as b
from corpusmill.catalog import stem_sql
from corpusmill.catalog.base import query, r6
from corpusmill.functions import features as ft
from corpusmill.functions import fixed
from corpusmill.functions import text as tx
from corpusmill.functions.stemming import stemmed
from corpusmill.operators import corpus, generation, grading, overlap, sentences, stats
from corpusmill.plans import jobs


# --- n-grams, vocabulary, proxies -------------------------------------------------------------------
def _gram_rows(text: str, max_n: int = 4) -> str:
    return " UNION ALL ".join(
        f"SELECT {n} AS n, unnest({b.grams('w', n)}) AS g FROM (SELECT {b.words(text)} AS w FROM documents) x" for n in range(1, max_n + 1)
    )


def _distinct_sql(text: str) -> str:
    return f"""SELECT n::BIGINT AS n, sum(c)::BIGINT AS total, count(*) AS "distinct", {r6('count(*)::DOUBLE/sum(c)')} AS ratio
 FROM (SELECT n, g, count(*) AS c FROM ({_gram_rows(text)}) a GROUP BY n, g) t GROUP BY n"""


@query("distinct_ngrams", _distinct_sql("lower(text)"))
def distinct_ngrams(spark, sf):
    """distinct-1 to distinct-4 of the corpus, ignoring case."""
    return corpus.distinct_ngrams(b.documents(spark, sf))


@query("distinct_ngrams_cased", _distinct_sql("text"))
def distinct_ngrams_cased(spark, sf):
    """The case-sensitive variant."""
    return corpus.distinct_ngrams(b.documents(spark, sf), lower=False)


@query("distinct_ngrams_sketch")
def distinct_ngrams_sketch(spark, sf):
    """Distinct-n from mergeable sketches (approximate, so without a SQL twin)."""
    return corpus.distinct_ngrams(b.documents(spark, sf), approximate=True)


VOCAB = f"SELECT t, count(*) AS c FROM (SELECT unnest({b.alnum('lower(text)')}) AS t FROM documents) a GROUP BY t"
VOCAB_ROW = "sum(c)::BIGINT AS tokens, count(*) AS vocabulary, count(*)::DOUBLE/sum(c) AS vocab_diversity, log2(sum(c)) - sum(c*log2(c))/sum(c) AS entropy"


@query(
    "vocabulary_entropy",
    f"SELECT tokens, vocabulary, {r6('vocab_diversity')} AS vocab_diversity, {r6('entropy')} AS entropy FROM (SELECT {VOCAB_ROW} FROM ({VOCAB}) v) t",
)
def vocabulary_entropy(spark, sf):
    """Vocabulary diversity and Shannon entropy."""
    return corpus.vocabulary(b.documents(spark, sf))


_SET = f"list_distinct({b.content(b.alnum('lower(x)'))})"
def _proxy_rows(sents: str, source: str = "documents") -> str:
    return f"""SELECT doc_id, {b.flesch('len(w)', 'len(s)', 'y')} AS ease, CASE WHEN len(s)>1 THEN {b.len_std('l')} END AS variation,
 CASE WHEN len(s)>1 THEN list_sum(p)/len(p) END AS coherence, {b.grammar('text', 'len(w)', 's', 'w')} AS grammar FROM (
 SELECT doc_id, text, w, y, s, list_transform(s, lambda x: len({b.words('x')})) AS l,
  list_transform(range(1, len(k)), lambda i: {b.jac('k[i]', 'k[i+1]')}) AS p FROM (
 SELECT *, list_transform(s, lambda x: {_SET}) AS k FROM (
 SELECT doc_id, text, {b.words('lower(text)')} AS w, {b.syll('text')} AS y, {sents} AS s FROM {source}) a) c) d"""


PROXY_ROWS = _proxy_rows(b.sents("text"))
PROXIES = "coalesce(avg(ease),0) AS avg_readability, coalesce(avg(variation),0) AS sentence_variation, coalesce(avg(coherence),0) AS coherence_proxy"
PROXY_NAMES = ("avg_readability", "sentence_variation", "coherence_proxy", "grammar_score")


@query(
    "corpus_quality_proxies",
    f"WITH p AS ({PROXY_ROWS}) SELECT {', '.join(f'{r6(n)} AS {n}' for n in PROXY_NAMES)} FROM (SELECT {PROXIES}, coalesce(avg(grammar),0) AS grammar_score FROM p) t",
)
def corpus_quality_proxies(spark, sf):
    """Mean readability, sentence variation, coherence and grammar of the whole corpus."""
    return corpus.quality_proxies(b.documents(spark, sf))


@query(
    "corpus_grammar_sample",
    f"""WITH p AS ({PROXY_ROWS}) SELECT {', '.join(f'{r6(n)} AS {n}' for n in PROXY_NAMES)} FROM (SELECT {PROXIES},
 (SELECT coalesce(avg(grammar),0) FROM (SELECT grammar FROM p ORDER BY doc_id LIMIT 100) q) AS grammar_score FROM p) t""",
)
def corpus_grammar_sample(spark, sf):
    """The same with grammar on the first hundred texts, the sampling variant."""
    return corpus.quality_proxies(b.documents(spark, sf), key="doc_id", grammar_sample=100)


LEARNED = b.learned("SELECT text FROM documents")


@query("sentence_abbreviations", f"WITH {LEARNED} SELECT word, with_period, without, {r6('score')} AS score FROM abbreviations WHERE score >= 0.3")
def sentence_abbreviations(spark, sf):
    """Abbreviations learned from the documents."""
    return sentences.abbreviation_scores(b.documents(spark, sf)).where(F.col("score") >= sentences.ABBREVIATION)


@query("sentence_starters", f"WITH {LEARNED} SELECT word, after_end, times, {r6('score')} AS score FROM starters WHERE score >= 30")
def sentence_starters(spark, sf):
    """Words that begin sentences, learned from the documents."""
    docs = b.documents(spark, sf)
    scores = sentences.starter_scores(docs, sentences.abbreviations(docs))
    return scores.where(F.col("score") >= sentences.STARTER)


@query(
    "learned_sentences",
    f"""WITH {LEARNED} SELECT doc_id, len(s) AS sentences, md5(array_to_string(list_transform(s, lambda z: regexp_replace(z, '[{b.WS}]+', ' ', 'g')), '|')) AS sentences_md5
 FROM (SELECT doc_id, {b.learned_sents('text')} AS s FROM documents, learned) t""",
)
def learned_sentences(spark, sf):
    """Every document cut where sentences end, as learned from all documents."""
    docs = b.documents(spark, sf)
    cut = docs.select("doc_id", sentences.learn(docs).sentences(F.col("text")).alias("s"))
    same = F.transform("s", lambda s: F.regexp_replace(s, f"{tx.SPACE}+", " "))
    return cut.select("doc_id", F.size("s").alias("sentences"), F.md5(F.array_join(same, "|")).alias("sentences_md5"))


@query(
    "learned_quality_proxies",
    f"""WITH {LEARNED}, p AS ({_proxy_rows(b.learned_sents('text'), 'documents, learned')})
 SELECT {', '.join(f'{r6(n)} AS {n}' for n in PROXY_NAMES)} FROM (SELECT {PROXIES}, coalesce(avg(grammar),0) AS grammar_score FROM p) t""",
)
def learned_quality_proxies(spark, sf):
    """The corpus proxies on learned sentences."""
    docs = b.documents(spark, sf)
    return corpus.quality_proxies(docs, ends=sentences.learn(docs))


# --- losses ----------------------------------------------------------------------------------------
LOSS = "SELECT doc_id, CASE WHEN n_chars % 97 = 0 THEN 'inf'::DOUBLE WHEN n_chars % 89 = 0 THEN 'nan'::DOUBLE ELSE (n_chars % 700)/100e0 END AS loss, n_chars // 4 AS n_tokens, lang, source FROM documents"


def losses(spark, sf):
    """Per-row losses derived from the documents, some of them not finite."""
    n = F.col("n_chars")
    loss = F.when(n % 97 == 0, float("inf")).when(n % 89 == 0, float("nan")).otherwise((n % 700) / 100)
    return b.table(spark, sf, "documents").select("doc_id", loss.alias("loss"), F.floor(n / 4).alias("n_tokens"), "lang", "source")


@query("finite_losses", f"SELECT doc_id, {r6('loss')} AS loss FROM ({LOSS}) t WHERE NOT isnan(loss) AND NOT isinf(loss)")
def finite_losses(spark, sf):
    """Rows with a finite loss."""
    return losses(spark, sf).where(stats.finite(F.col("loss"))).select("doc_id", "loss")


@query(
    "token_perplexity",
    f"SELECT {r6('exp(sum(loss*n_tokens)/sum(n_tokens))')} AS perplexity FROM ({LOSS}) t WHERE NOT isnan(loss) AND NOT isinf(loss)",
)
def token_perplexity(spark, sf):
    """Token-weighted perplexity."""
    return stats.token_perplexity(losses(spark, sf).where(stats.finite(F.col("loss"))))


@query(
    "perplexity_summary",
    f"""SELECT lang, count(*) AS n, {r6('avg(p)')} AS perplexity, {r6('stddev_pop(p)')} AS perplexity_std, {r6('median(p)')} AS perplexity_median
 FROM (SELECT lang, exp(loss) AS p FROM ({LOSS}) t WHERE NOT isnan(loss) AND NOT isinf(loss)) u GROUP BY lang""",
)
def perplexity_summary(spark, sf):
    """Mean, spread and median perplexity per group, finite rows only."""
    return stats.perplexity_summary(losses(spark, sf), ["lang"])


# --- lengths ---------------------------------------------------------------------------------------
TOKENS = f"SELECT len({b.toks('text')}) AS length FROM documents"


@query(
    "token_length_histogram",
    f"""SELECT low::BIGINT AS low, high::BIGINT AS high, count(length) AS n, {r6('count(length)*100e0/max(total)')} AS percent FROM
 (VALUES {", ".join(f"({lo},{hi})" for lo, hi in zip(fixed.LENGTH_EDGES, fixed.LENGTH_EDGES[1:]))}) e(low, high)
 CROSS JOIN (SELECT count(*) AS total FROM documents) c LEFT JOIN ({TOKENS}) t ON length>=low AND (length<high OR (high={fixed.LENGTH_EDGES[-1]} AND length=high)) GROUP BY low, high""",
)
def token_length_histogram(spark, sf):
    """Rows per token-length interval."""
    rows = b.documents(spark, sf).select(F.size(tx.tokens(F.col("text"))).alias("length"))
    return stats.edge_histogram(rows, "length")


@query(
    "length_profile",
    f"""SELECT 'length' AS metric, count(*) AS n, {r6('avg(length)')} AS mean, {r6('stddev_pop(length)')} AS std, {r6('min(length)::DOUBLE')} AS min,
 {r6('max(length)::DOUBLE')} AS max, {r6('median(length)')} AS median FROM ({TOKENS}) t""",
)
def length_profile(spark, sf):
    """Token-length summary of a dataset."""
    return jobs.length_profile(b.documents(spark, sf), "doc_id")[0]


# --- model outputs ---------------------------------------------------------------------------------
PROMPTS_SQL = "(VALUES " + ", ".join(
    f"({i}, '{c}', {b.text_list(e)})" for i, (c, _, e, _) in enumerate(fixed.ANALYSIS_PROMPTS)
) + ") p(prompt_id, category, expected_elements)"
TEMPERATURES = [0.7 + i * ((1.0 - 0.7) / 4) for i in range(4)] + [1.0]
OUTPUTS = f"""SELECT doc_id, text, category, expected_elements, [{", ".join(f"{t!r}::DOUBLE" for t in TEMPERATURES)}][(doc_id // 6) % 5 + 1] AS temperature
 FROM documents JOIN {PROMPTS_SQL} ON doc_id % 6 = prompt_id"""


def outputs(spark, sf):
    """Documents as outputs: each belongs to one cell of the prompt grid."""
    grid = generation.prompt_grid(grading.prompt_table(spark), 5)
    docs = b.documents(spark, sf).select(
        "doc_id",
        F.col("text").alias("generated"),
        (F.col("doc_id") % 6).cast("int").alias("prompt_id"),
        (F.floor(F.col("doc_id") / 6) % 5).cast("int").alias("variant"),
    )
    return docs.join(grid, ["prompt_id", "variant"])


@query("prompt_grid", f"SELECT doc_id, category, len(expected_elements) AS n_elements, {r6('temperature')} AS temperature FROM ({OUTPUTS}) t")
def prompt_grid(spark, sf):
    """Outputs with their prompt and evenly spaced temperature."""
    return outputs(spark, sf).select("doc_id", "category", F.size("expected_elements").alias("n_elements"), "temperature")


COVERAGE = "len(list_filter(expected_elements, lambda e: contains(lower(text), lower(e))))::DOUBLE/len(expected_elements)"
METRIC_ROWS = rf"""SELECT doc_id, category, temperature, length(text) AS length_chars, n AS length_words, len(s) AS length_sentences,
 {b.flesch('n', 'len(s)', 'y')} AS flesch_reading_ease, {b.kincaid('n', 'len(s)', 'y')} AS flesch_kincaid_grade, {b.uniq('k')} AS vocabulary_diversity,
 cov AS expected_elements_ratio, (contains(text,'```') OR contains(text,'def ')) AS has_code_block, regexp_matches(text, '(?m)^\s*[\d\-*]\s*') AS has_list,
 contains(text, chr(10)||chr(10)) AS has_paragraphs, {b.proper('text')} AS ends_properly, {b.open_end('text', False)} AS incomplete_sentence,
 CASE WHEN len(s)>1 THEN 1-{b.uniq('s')} ELSE 0e0 END AS sentence_repetition, CASE WHEN len(k)>3 THEN 1-{b.uniq(b.grams('k', 3))} ELSE 0e0 END AS trigram_repetition
 FROM (SELECT *, len({b.words('text')}) AS n, {b.sents('text')} AS s, {b.toks('lower(text)')} AS k, {b.syll('text')} AS y, {COVERAGE} AS cov FROM ({OUTPUTS}) o) t"""
DOUBLES = ("flesch_reading_ease", "flesch_kincaid_grade", "vocabulary_diversity", "expected_elements_ratio", "sentence_repetition", "trigram_repetition")


def _metrics(spark, sf):
    return generation.output_metrics(outputs(spark, sf), ["doc_id", "category", "temperature"])


@query(
    "output_metrics",
    f"SELECT doc_id, category, {r6('temperature')} AS temperature, "
    + ", ".join(f"{r6(m)} AS {m}" if m in DOUBLES else m for m in generation.OUTPUT_METRICS)
    + f" FROM ({METRIC_ROWS}) m",
)
def output_metrics(spark, sf):
    """All metrics of every output."""
    return _metrics(spark, sf)


@query("expected_coverage", f"SELECT doc_id, {r6(COVERAGE)} AS coverage FROM ({OUTPUTS}) t")
def expected_coverage(spark, sf):
    """Share of the expected elements found."""
    return outputs(spark, sf).select("doc_id", ft.element_coverage(F.col("generated"), F.col("expected_elements")).alias("coverage"))


@query(
    "output_report",
    "WITH m AS (" + METRIC_ROWS + ") "
    + " UNION ALL ".join(
        f"SELECT category, '{m}' AS metric, {r6('avg(v)')} AS mean, {r6('stddev_pop(v)')} AS std, {r6('CASE WHEN bool_and(v IN (0,1)) THEN avg(v) END')} AS ratio"
        f" FROM (SELECT category, {m}::INT::DOUBLE AS v FROM m) t WHERE v IS NOT NULL GROUP BY category"
        if m.startswith(("has_", "ends_", "incomplete"))
        else f"SELECT category, '{m}' AS metric, {r6('avg(v)')} AS mean, {r6('stddev_pop(v)')} AS std, {r6('CASE WHEN bool_and(v IN (0,1)) THEN avg(v) END')} AS ratio"
        f" FROM (SELECT category, {m}::DOUBLE AS v FROM m) t WHERE v IS NOT NULL GROUP BY category"
        for m in generation.OUTPUT_METRICS
    ),
)
def output_report(spark, sf):
    """Mean, spread and 0/1 ratio of each metric per category."""
    return generation.analysis_report(_metrics(spark, sf))


@query(
    "overall_output_metrics",
    f"""SELECT count(*) AS total_samples, {r6('avg(length_words)')} AS avg_length_words, {r6('avg(vocabulary_diversity)')} AS avg_vocabulary_diversity,
 {r6('avg(ends_properly::INT)')} AS coherence_rate, {r6('avg(expected_elements_ratio)')} AS expected_elements_coverage FROM ({METRIC_ROWS}) m""",
)
def overall_output_metrics(spark, sf):
    """Five means over all outputs."""
    return generation.overall_metrics(_metrics(spark, sf))


@query("outputs_per_category", f"SELECT category, count(*) AS n FROM ({OUTPUTS}) t GROUP BY category")
def outputs_per_category(spark, sf):
    """Outputs per category."""
    return stats.count_by(outputs(spark, sf), "category")


@query(
    "diversity_by_temperature",
    f"""SELECT {r6('round(temperature, 2)')} AS temperature, {r6('avg(vocabulary_diversity)')} AS avg_vocabulary_diversity
 FROM ({METRIC_ROWS}) m GROUP BY round(temperature, 2)""",
)
def diversity_by_temperature(spark, sf):
    """Mean diversity per rounded temperature."""
    return stats.mean_by_rounded(_metrics(spark, sf), "temperature", "vocabulary_diversity")


COMPOSITE = "(vocabulary_diversity*0.3e0 + expected_elements_ratio*0.4e0 + ends_properly::INT*0.3e0)"


@query("composite_output_scores", f"SELECT doc_id, {r6(COMPOSITE)} AS composite_score FROM ({METRIC_ROWS}) m")
def composite_output_scores(spark, sf):
    """Composite score of every output."""
    return generation.composite_scores(_metrics(spark, sf), ["doc_id"])


FLAG_ROWS = rf"""SELECT category, len(w) AS length, (contains(text,'```') OR contains(text,'def ') OR contains(text,'function ')) AS has_code_blocks,
 (contains(text,'•') OR contains(text,'- ') OR contains(text,'* ') OR contains(text, chr(10)||'1.')) AS has_bullet_points,
 regexp_matches(text, '\p{{Nd}}') AS has_numbers, {b.proper('text')} AS ends_properly, (len(w)>10 AND {b.uniq('w')}<0.5e0) AS repetitive
 FROM (SELECT category, text, {b.words('lower(text)')} AS w FROM ({OUTPUTS}) o) t"""


@query(
    "sample_report",
    f"""SELECT category, count(*) AS count, {r6('avg(length)')} AS avg_length, {r6('stddev_pop(length)')} AS std_length, min(length) AS min_length, max(length) AS max_length,
 {", ".join(f"{r6(f'avg({f}::INT)*100')} AS {f}" for f in generation.INDICATORS)} FROM ({FLAG_ROWS}) t GROUP BY category""",
)
def sample_report(spark, sf):
    """Length statistics and indicator rates per category."""
    return generation.sample_report(generation.quality_indicators(outputs(spark, sf), ["category"]))


@query(
    "length_by_category",
    f"SELECT category, count(*) AS count, {r6('avg(length)')} AS avg_length, {r6('stddev_pop(length)')} AS std_length, min(length) AS min_length, max(length) AS max_length FROM ({FLAG_ROWS}) t GROUP BY category",
)
def length_by_category(spark, sf):
    """Word counts per category."""
    return stats.group_stats(generation.quality_indicators(outputs(spark, sf), ["category"]), "category", "length")


@query("indicator_rates", f"SELECT category, {', '.join(f'{r6(f"avg({f}::INT)*100")} AS {f}' for f in generation.INDICATORS)} FROM ({FLAG_ROWS}) t GROUP BY category")
def indicator_rates(spark, sf):
    """Percentage of outputs with each indicator."""
    return stats.group_rates(generation.quality_indicators(outputs(spark, sf), ["category"]), "category", generation.INDICATORS)


# --- overlap ---------------------------------------------------------------------------------------
# A document is compared with the benchmark item of its number, the others with their own first line.
OVERLAP = """SELECT doc_id AS id, d.text AS prediction, coalesce(benchmark.text, split_part(d.text, chr(10), 1)) AS reference
 FROM documents d LEFT JOIN benchmark ON item_id = doc_id"""


def overlap_pairs(spark, sf):
    items = b.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("_item"))
    docs = b.documents(spark, sf).select("doc_id", "text")
    return docs.join(items, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("prediction"),
        F.coalesce("_item", F.split_part("text", F.lit("\n"), F.lit(1))).alias("reference"),
    )


def _rouge_tok(t: str) -> str:
    return f"regexp_extract_all(lower({t}), '[a-z0-9]+')"


def _bleu_tok(t: str) -> str:
    spaced = f"' '||replace(replace({t}, '-'||chr(10), ''), chr(10), ' ')||' '"
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        spaced = f"replace({spaced}, '{entity}', '{char}')"
    for pattern, to in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        spaced = f"regexp_replace({spaced}, '{pattern}', '{to}', 'g')"
    return b.words(f"({spaced})")


def _stemmed_sql(raw: str) -> str:
    """CTE ``tok``: the token lists of ``raw`` with every word as its stem, in order."""
    words = f"SELECT unnest(pt) AS word FROM {raw} UNION ALL SELECT unnest(rt) FROM {raw}"
    sides = " UNION ALL ".join(
        f"SELECT id, '{side}' AS side, unnest({side}) AS word, unnest(range(len({side}))) AS i FROM {raw}" for side in ("pt", "rt")
    )
    return f"""{stem_sql.stems(words)}, placed AS (SELECT id, side, list(stem ORDER BY i) AS w FROM ({sides}) z JOIN stems USING (word) GROUP BY id, side),
 tok AS MATERIALIZED (SELECT x.id, coalesce(p.w, []) AS pt, coalesce(r.w, []) AS rt FROM {raw} x
  LEFT JOIN placed p ON p.id = x.id AND p.side = 'pt' LEFT JOIN placed r ON r.id = x.id AND r.side = 'rt')"""


def _match_sql(tokenizer, max_n: int, where: str, stem: bool = False, name: str = "") -> str:
    """CTEs over ``pairs`` ending in ``cell`` (id, n, m, tp, tr), each with ``name`` before its own."""
    tok = f"{name}tok"
    side = " UNION ALL ".join(
        f"SELECT id, {n} AS n, unnest({b.grams(col, n)}) AS g, {int(col == 'pt')} AS p FROM {tok}"
        for n in range(1, max_n + 1)
        for col in ("pt", "rt")
    )
    cut = f"(SELECT id, {tokenizer('prediction')} AS pt, {tokenizer('reference')} AS rt FROM pairs {where})"
    made = f"raw AS MATERIALIZED {cut}, {_stemmed_sql('raw')}" if stem else f"{tok} AS MATERIALIZED {cut}"
    return f"""{made},
 {name}cnt AS (SELECT id, n, g, sum(p) AS cp, count(*)-sum(p) AS cr FROM ({side}) s GROUP BY id, n, g),
 {name}cell AS (SELECT id, n, sum(least(cp,cr))::DOUBLE AS m, sum(cp)::DOUBLE AS tp, sum(cr)::DOUBLE AS tr FROM {name}cnt GROUP BY id, n)"""


def _f_sql(m: str, p: str, r: str) -> str:
    return f"coalesce(2*({m}/nullif({p},0))*({m}/nullif({r},0))/nullif({m}/nullif({p},0)+{m}/nullif({r},0),0),0)"


NS = ", ".join(f"coalesce(max(CASE WHEN n={n} THEN {_f_sql('m', 'tp', 'tr')} END),0) AS rouge{n}" for n in (1, 2))


def _rouge_sql(stem: bool) -> str:
    return f"""pairs AS ({OVERLAP}), {_match_sql(_rouge_tok, 2, "WHERE reference <> ''", stem)},
 f AS (SELECT tok.id, {NS} FROM tok LEFT JOIN cell USING (id) GROUP BY tok.id)"""


ROUGE = _rouge_sql(stem=True)
LONGEST = f"""{stem_sql.subsequence("tok")}, fl AS (SELECT id, {_f_sql("lcs", "len(pt)", "len(rt)")} AS rougeL FROM (SELECT id, pt, rt, lcs::DOUBLE AS lcs FROM tok LEFT JOIN lcs USING (id)) x)"""


@query("rouge_n", f"WITH {ROUGE} SELECT id, {r6('rouge1')} AS rouge1, {r6('rouge2')} AS rouge2 FROM f")
def rouge_n(spark, sf):
    """ROUGE-1 and ROUGE-2 of every pair, on stems."""
    return overlap.rouge_n(overlap_pairs(spark, sf), "id")


@query("rouge_n_unstemmed", f"WITH {_rouge_sql(stem=False)} SELECT id, {r6('rouge1')} AS rouge1, {r6('rouge2')} AS rouge2 FROM f")
def rouge_n_unstemmed(spark, sf):
    """The same on the words themselves."""
    return overlap.rouge_n(overlap_pairs(spark, sf), "id", stem=False)


@query("rouge_l", f"WITH {ROUGE}, {LONGEST} SELECT id, {r6('rougeL')} AS rougeL FROM fl")
def rouge_l(spark, sf):
    """ROUGE-L of every pair, on stems."""
    return overlap.rouge_l(overlap_pairs(spark, sf), "id")


@query(
    "word_stems",
    f"WITH {stem_sql.stems("SELECT unnest(" + _rouge_tok('text') + ") AS word FROM documents")} SELECT word, stem FROM stems",
)
def word_stems(spark, sf):
    """Every different word of the documents with its stem."""
    words = b.documents(spark, sf).select(F.explode(tx.rouge_tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", F.get(stemmed(F.array("word")), 0).alias("stem"))


_PREC = [f"coalesce(sum(CASE WHEN n={n} THEN m END)/nullif(sum(CASE WHEN n={n} THEN tp END),0),0) AS p{n}" for n in range(1, 5)]
BLEU = f"""{_match_sql(_bleu_tok, 4, "", name="b")}, bl AS (SELECT {", ".join(_PREC)}, sum(CASE WHEN n=1 THEN tp END)::BIGINT AS tl, sum(CASE WHEN n=1 THEN tr END)::BIGINT AS rl FROM bcell),
 bs AS (SELECT *, CASE WHEN least(p1,p2,p3,p4)>0 THEN exp((ln(p1)+ln(p2)+ln(p3)+ln(p4))/4)*CASE WHEN tl::DOUBLE/rl>1 THEN 1e0 ELSE exp(1-rl::DOUBLE/tl) END ELSE 0e0 END AS bleu FROM bl)"""


@query(
    "corpus_bleu",
    f"WITH pairs AS ({OVERLAP}), {BLEU} SELECT {', '.join(f'{r6(f"p{n}")} AS precision_{n}' for n in range(1, 5))}, tl AS translation_length, rl AS reference_length, {r6('bleu')} AS bleu FROM bs",
)
def corpus_bleu(spark, sf):
    """BLEU-4 pooled over all pairs."""
    return overlap.corpus_bleu(overlap_pairs(spark, sf), "id")


def _self_bleu_sql(source: str, key: str, text: str) -> str:
    grams = " UNION ALL ".join(f"SELECT place, {n} AS n, unnest({b.grams('w', n)}) AS g FROM st" for n in range(1, 5))
    ref = "r.place <> c.place AND (r.place <= 10 OR c.place <= 10)"
    return f"""smp AS (SELECT row_number() OVER (ORDER BY h, k) AS place, t FROM (SELECT {b.hash32(42, key)} AS h, {key} AS k, {text} AS t FROM {source} ORDER BY h, k LIMIT 100) a),
 st AS MATERIALIZED (SELECT place, {_bleu_tok('t')} AS w FROM smp WHERE place <= 50),
 sg AS MATERIALIZED (SELECT place, n, g, count(*) AS c FROM ({grams}) x GROUP BY place, n, g),
 clip AS (SELECT c.place, c.n, c.g, c.c, coalesce(max(r.c) FILTER (WHERE {ref}),0) AS rc FROM sg c LEFT JOIN (SELECT * FROM sg WHERE place<=11) r USING (n, g) GROUP BY c.place, c.n, c.g, c.c),
 sums AS (SELECT place, {", ".join(f"coalesce(sum(least(c,rc)) FILTER (WHERE n={n})::DOUBLE/nullif(sum(c) FILTER (WHERE n={n}),0),0) AS p{n}" for n in range(1, 5))} FROM clip GROUP BY place),
 shortest AS (SELECT c.place, len(c.w) AS tl, min(len(r.w)) AS rl FROM st c JOIN (SELECT * FROM st WHERE place<=11) r ON {ref} GROUP BY c.place, c.w),
 selfb AS (SELECT place, CASE WHEN least(p1,p2,p3,p4)>0 THEN exp((ln(p1)+ln(p2)+ln(p3)+ln(p4))/4)*CASE WHEN tl::DOUBLE/rl>1 THEN 1e0 ELSE exp(1-rl::DOUBLE/tl) END ELSE 0e0 END AS bleu
  FROM shortest LEFT JOIN sums USING (place))"""


@query("self_bleu_scores", f"WITH {_self_bleu_sql('documents', 'doc_id', 'text')} SELECT place, {r6('bleu')} AS bleu FROM selfb")
def self_bleu_scores(spark, sf):
    """BLEU of fifty sampled texts against ten others each."""
    return overlap.self_bleu_scores(b.documents(spark, sf), "doc_id")


@query("self_bleu", f"WITH {_self_bleu_sql('documents', 'doc_id', 'text')} SELECT {r6('1-avg(bleu)')} AS self_bleu FROM selfb")
def self_bleu(spark, sf):
    """Diversity between sampled texts."""
    return overlap.self_bleu(b.documents(spark, sf), "doc_id")


QUALITY_ROW = f"""WITH {ROUGE}, {LONGEST}, {BLEU},
 {_self_bleu_sql('documents', 'doc_id', 'text')},
 dn AS (SELECT n, count(*)::DOUBLE/sum(c) AS ratio FROM (SELECT n, g, count(*) AS c FROM ({_gram_rows('text')}) a GROUP BY n, g) t GROUP BY n),
 ratios AS (SELECT len({b.words('prediction')})/greatest(len({b.words('reference')}), 1)::DOUBLE AS x FROM pairs WHERE reference <> '')
 SELECT (SELECT {r6('avg(rouge1)')} FROM f) AS rouge1, (SELECT {r6('avg(rouge2)')} FROM f) AS rouge2, (SELECT {r6('avg(rougeL)')} FROM fl) AS rougeL,
 (SELECT {r6('bleu')} FROM bs) AS bleu, (SELECT {r6('avg(x)')} FROM ratios) AS avg_length_ratio, (SELECT {r6('stddev_pop(x)')} FROM ratios) AS std_length_ratio,
 {', '.join(f"(SELECT {r6('ratio')} FROM dn WHERE n={n}) AS distinct_{n}" for n in range(1, 5))},
 (SELECT {r6('1-avg(bleu)')} FROM selfb) AS self_bleu"""


@query("generation_quality", QUALITY_ROW)
def generation_quality(spark, sf):
    """The whole overlap report in one row."""
    return overlap.generation_quality(overlap_pairs(spark, sf), "id")


LCS_FREE = f"WITH {ROUGE} SELECT {r6('avg(rouge1)')} AS rouge1, {r6('avg(rouge2)')} AS rouge2, count(*) AS n FROM f"


@query("mean_rouge", LCS_FREE)
def mean_rouge(spark, sf):
    """Mean ROUGE-1 and ROUGE-2 over pairs with a reference."""
    rows = overlap.rouge_n(overlap_pairs(spark, sf), "id")
    return rows.agg(F.avg("rouge1").alias("rouge1"), F.avg("rouge2").alias("rouge2"), F.count("*").alias("n"))


# --- composites ------------------------------------------------------------------------------------
EVAL = f"""p AS ({PROXY_ROWS}), q AS (SELECT {PROXIES}, coalesce(avg(grammar),0) AS grammar_score FROM p),
 d AS (SELECT n, count(*)::DOUBLE/sum(c) AS ratio FROM (SELECT n, g, count(*) AS c FROM ({_gram_rows('lower(text)')}) a GROUP BY n, g) t GROUP BY n),
 dr AS (SELECT {", ".join(f"max(CASE WHEN n={n} THEN ratio END) AS distinct_{n}" for n in range(1, 5))} FROM d),
 v AS (SELECT {VOCAB_ROW} FROM ({VOCAB}) x),
 l AS (SELECT exp(sum(loss*n_tokens)/sum(n_tokens)) AS perplexity FROM ({LOSS}) t WHERE NOT isnan(loss) AND NOT isinf(loss)),
 g AS (SELECT avg(acc) AS task_performance FROM (SELECT source, avg((n_chars % 3 > 0)::INT) AS acc FROM documents GROUP BY source) t),
 r AS (SELECT *, (grammar_score + least(avg_readability/100,1) + coherence_proxy)/3 AS quality_score, (distinct_2 + vocab_diversity + least(entropy/10,1))/3 AS diversity_score
  FROM dr, v, q, l, g)"""
EVAL_NAMES = [f"distinct_{n}" for n in range(1, 5)] + ["vocab_diversity", "entropy", *PROXY_NAMES, "perplexity", "task_performance", "quality_score", "diversity_score"]


@query(
    "corpus_evaluation",
    f"WITH {EVAL} SELECT {', '.join(f'{r6(n)} AS {n}' for n in EVAL_NAMES)}, {r6('quality_score*0.4e0+task_performance*0.4e0+diversity_score*0.2e0')} AS overall_score FROM r",
)
def corpus_evaluation(spark, sf):
    """The full corpus report with perplexity, task accuracy and composite scores."""
    graded = b.table(spark, sf, "documents").select(F.col("source").alias("task_type"), (F.col("n_chars") % 3 > 0).alias("correct"))
    loss = losses(spark, sf).where(stats.finite(F.col("loss")))
    return jobs.evaluate_corpus(b.documents(spark, sf), loss, graded)


@query(
    "composite_without_tasks",
    f"WITH {EVAL} SELECT {r6('quality_score')} AS quality_score, {r6('diversity_score')} AS diversity_score, {r6('(quality_score*0.4e0+diversity_score*0.2e0)/0.6e0')} AS overall_score FROM r",
)
def composite_without_tasks(spark, sf):
    """The composite when no task was graded: the weights of the present parts are renormalised."""
    return jobs.evaluate_corpus(b.documents(spark, sf)).select("quality_score", "diversity_score", "overall_score")


@query(
    "family_composite",
    f"""WITH {EVAL}, f AS (SELECT (quality_score + 0.5e0)/2 AS quality, task_performance, coalesce(NULL::DOUBLE, 0.5e0) AS robustness FROM r)
 SELECT {r6('quality')} AS quality, {r6('task_performance')} AS tasks, {r6('robustness')} AS robustness, {r6('quality*0.25e0+task_performance*0.25e0+robustness*0.2e0')} AS overall FROM f""",
)
def family_composite(spark, sf):
    """Families of scores with fixed weights; a missing member counts 0.5, a missing weight 0.25."""
    graded = b.table(spark, sf, "documents").select(F.col("source").alias("task_type"), (F.col("n_chars") % 3 > 0).alias("correct"))
    row = jobs.evaluate_corpus(b.documents(spark, sf), None, graded).withColumns(
        {"judge": F.lit(None).cast("double"), "consistency": F.lit(None).cast("double")}
    )
    families = {"quality": ["quality_score", "judge"], "tasks": ["task_performance"], "robustness": ["consistency"]}
    return corpus.family_composite(row, families, {"robustness": 0.20}).select(*families, "overall")

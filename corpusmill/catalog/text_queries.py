"""Formatting and scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.catalog import base as b
from corpusmill.catalog import stem_sql
from corpusmill.catalog.base import query, r6
from corpusmill.functions import features as ft
from corpusmill.functions import fixed, hyphenation
from corpusmill.functions import text as tx
from corpusmill.operators import corpus, formats, ranking

TURN = "CASE role WHEN 'system' THEN 'System: '||text||chr(10)||chr(10) WHEN 'user' THEN '### Instruction:'||chr(10)||text||chr(10)||chr(10) WHEN 'assistant' THEN '### Response:'||chr(10)||text||chr(10)||chr(10) END"
CHAT_SQL = f"SELECT conv_id, regexp_replace(string_agg({TURN}, '' ORDER BY turn), '[{b.WS}]+$', '') AS text FROM conversations GROUP BY conv_id"
CHAT_ROLES = {"system": "System: ", "user": "### Instruction:\n", "assistant": "### Response:\n"}


@query("first_n_rows", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 100")
def first_n_rows(spark, sf):
    """First rows in id order."""
    return ranking.first_rows(b.documents(spark, sf).select("doc_id", "lang", "source"), 100, "doc_id")


@query(
    "row_index",
    "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id)-1 AS source_index FROM documents",
)
def row_index(spark, sf):
    """Dense index within each source."""
    return ranking.row_index(b.documents(spark, sf), "doc_id", ["source"])


@query("chat_training_text", f"SELECT conv_id, text, len({b.words('text')}) AS length FROM ({CHAT_SQL}) t")
def chat_training_text(spark, sf):
    """Chats with system, instruction and response headers."""
    made = formats.chat_text(b.conversations(spark, sf), CHAT_ROLES)
    return made.select("conv_id", "text", tx.word_count(F.col("text")).alias("length"))


@query(
    "chat_array_text",
    f"SELECT conv_id, text, md5(text) AS text_md5 FROM ({CHAT_SQL}) t",
)
def chat_array_text(spark, sf):
    """The array form of a chat: one array of from/value turns per chat, formatted without a shuffle."""
    names = F.create_map(*[F.lit(x) for x in ("user", "human", "assistant", "gpt", "system", "system")])
    chats = b.conversations(spark, sf).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", names[F.col("role")].alias("from"), F.col("text").alias("value")))).alias("conversations")
    )
    made = chats.select("conv_id", formats.chat_array_text(F.col("conversations"), formats.TRAINING_ROLES, "from", "value").alias("text"))
    return made.withColumn("text_md5", F.md5("text"))


DIALOGUE = "CASE role WHEN 'user' THEN 'User: '||text||chr(10)||chr(10) WHEN 'assistant' THEN 'Assistant: '||text||chr(10)||chr(10) END"


@query(
    "chat_dialogue_text",
    f"""SELECT conv_id, text, 'conversation' AS type, len({b.words('text')}) AS length FROM
 (SELECT conv_id, regexp_replace(string_agg({DIALOGUE}, '' ORDER BY turn), '[{b.WS}]+$', '') AS text FROM conversations GROUP BY conv_id) t
 WHERE text <> ''""",
)
def chat_dialogue_text(spark, sf):
    """User/Assistant dialogues; chats without such turns are rejected."""
    return formats.dialogue_text(b.conversations(spark, sf))


SYSTEM_PAIRS = f"""SELECT * FROM ({b.EXCHANGES}) x
 LEFT JOIN (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS system FROM conversations WHERE role='system' GROUP BY conv_id) s USING (conv_id)"""
PAIR = "'### Instruction:'||chr(10)||coalesce(instruction,'')||chr(10)||chr(10)||'### Response:'||chr(10)||coalesce(response,'')"


def _system_pairs(spark, sf):
    turns = b.conversations(spark, sf)
    return formats.exchanges(turns).join(formats.system_text(turns), "conv_id", "left")


@query(
    "pair_training_text",
    f"""SELECT conv_id, turn, CASE WHEN coalesce(system,'')<>'' THEN 'System: '||system||chr(10)||chr(10)||{PAIR} ELSE {PAIR} END AS with_system,
 {PAIR} AS without_system, CASE WHEN coalesce(instruction,'')<>'' AND coalesce(response,'')<>'' THEN {PAIR} END AS complete_only
 FROM ({SYSTEM_PAIRS}) t""",
)
def pair_training_text(spark, sf):
    """The three pair layouts: system header, none, and rejecting incomplete pairs."""
    ask, answer = F.col("instruction"), F.col("response")
    return _system_pairs(spark, sf).select(
        "conv_id",
        "turn",
        formats.pair_text(ask, answer, F.col("system")).alias("with_system"),
        formats.pair_text(ask, answer).alias("without_system"),
        formats.pair_text(ask, answer, reject_empty=True).alias("complete_only"),
    )


def _cut_sql(chars: int, limit: int, kind: str) -> str:
    return f"""SELECT doc_id, text, '{kind}' AS type, len({b.words('text')}) AS length, source FROM (
 SELECT doc_id, source, CASE WHEN len(w)>{limit} THEN array_to_string(w[1:{limit}],' ') ELSE text END AS text
 FROM (SELECT doc_id, source, text, {b.words('text')} AS w FROM documents WHERE length(text)>={chars}) a) t"""


@query("educational_text", _cut_sql(100, 1000, "educational"))
def educational_text(spark, sf):
    """At least 100 characters, at most 1000 words, tagged."""
    made = b.documents(spark, sf).withColumn("text", formats.educational_text(F.col("text")))
    return formats.tagged(made, "educational", F.col("source"), ["doc_id"])


@query("web_text", _cut_sql(200, 800, "web_educational"))
def web_text(spark, sf):
    """At least 200 characters, at most 800 words, tagged."""
    made = b.documents(spark, sf).withColumn("text", formats.web_text(F.col("text")))
    return formats.tagged(made, "web_educational", F.col("source"), ["doc_id"])


@query(
    "field_fallback",
    """SELECT doc_id, md5(coalesce(i, p, '')) AS instruction_md5, md5(coalesce(r, o, c, '')) AS response_md5 FROM (
 SELECT doc_id, CASE WHEN lang='en' THEN split_part(text, chr(10), 1) END AS i, CASE WHEN lang<>'de' THEN source END AS p,
  CASE WHEN lang='fr' THEN text END AS r, CASE WHEN lang='en' THEN upper(source) END AS o, CASE WHEN lang<>'es' THEN lang END AS c
 FROM documents) t""",
)
def field_fallback(spark, sf):
    """instruction, else prompt; response, else output, else completion; else empty."""
    lang = F.col("lang")
    rows = b.documents(spark, sf).select(
        "doc_id",
        F.when(lang == "en", F.split_part("text", F.lit("\n"), F.lit(1))).alias("instruction"),
        F.when(lang != "de", F.col("source")).alias("prompt"),
        F.when(lang == "fr", F.col("text")).alias("response"),
        F.when(lang == "en", F.upper("source")).alias("output"),
        F.when(lang != "es", lang).alias("completion"),
    )
    return formats.resolve_pair(rows).select(
        "doc_id", F.md5("instruction").alias("instruction_md5"), F.md5("response").alias("response_md5")
    )


@query(
    "prompt_and_reference",
    f"""SELECT conv_id, parts[1]||'### Response:'||chr(10) AS prompt, {b.strip('parts[2]')} AS reference FROM (
 SELECT conv_id, string_split(text, '### Response:') AS parts FROM ({CHAT_SQL}) a
 WHERE contains(text, '### Instruction:') AND contains(text, '### Response:')) t""",
)
def prompt_and_reference(spark, sf):
    """Training text taken apart at its markers."""
    made = formats.chat_text(b.conversations(spark, sf), CHAT_ROLES)
    return formats.prompt_and_reference(made).select("conv_id", "prompt", "reference")


@query(
    "prompt_prefix_strip",
    f"SELECT doc_id, {b.strip('substr(text, length(split_part(text, chr(10), 1))+1)')} AS answer FROM documents",
)
def prompt_prefix_strip(spark, sf):
    """Output without its prompt (the first line)."""
    prompt = F.split_part("text", F.lit("\n"), F.lit(1))
    return b.documents(spark, sf).select("doc_id", formats.without_prompt(F.col("text"), prompt).alias("answer"))


@query(
    "label_counts",
    f"""SELECT doc_id, len(labels) AS n_labels, len(list_filter(labels, lambda x: x <> -100)) AS n_counted FROM (
 SELECT doc_id, list_transform({b.words('text')}, lambda w: CASE WHEN length(w)<=2 THEN -100 ELSE length(w) END) AS labels FROM documents) t""",
)
def label_counts(spark, sf):
    """Labels that count towards the loss; words of two letters stand in for ignored positions."""
    from corpusmill.operators import stats

    labels = F.transform(tx.words(F.col("text")), lambda w: F.when(F.length(w) <= 2, -100).otherwise(F.length(w)))
    rows = b.documents(spark, sf).select("doc_id", labels.alias("labels"))
    return rows.select("doc_id", F.size("labels").alias("n_labels"), stats.ignored_label_count(F.col("labels")).alias("n_counted"))


RUN_NAME = "CASE doc_id % 4 WHEN 0 THEN 'ultra_high_10k_' WHEN 1 THEN 'high_100k_' WHEN 2 THEN 'medium_1M_' ELSE 'random_' END || source || '_' || lang"


@query(
    "run_labels",
    f"""SELECT doc_id, experiment, CASE WHEN contains(experiment,'10k') THEN 10000 WHEN contains(experiment,'100k') THEN 100000
 WHEN contains(experiment,'1M') THEN 1000000 END::BIGINT AS dataset_size, CASE WHEN contains(experiment,'ultra') THEN 'ultra_high'
 WHEN contains(experiment,'high') THEN 'high' WHEN contains(experiment,'medium') THEN 'medium' END AS quality_level
 FROM (SELECT doc_id, {RUN_NAME} AS experiment FROM documents) t""",
)
def run_labels(spark, sf):
    """Size and level read from run names."""
    return formats.run_labels(b.documents(spark, sf).select("doc_id", F.expr(RUN_NAME).alias("experiment")))


@query(
    "text_preview",
    "SELECT doc_id, CASE WHEN length(text)>500 THEN substr(text,1,500)||'...' ELSE text END AS preview FROM documents",
)
def text_preview(spark, sf):
    """The first 500 characters."""
    return b.documents(spark, sf).select("doc_id", tx.preview(F.col("text")).alias("preview"))


# --- scalar functions ------------------------------------------------------------------------------
@query(
    "text_lengths",
    f"""SELECT doc_id, length(text) AS chars, len({b.words('text')}) AS words, len({b.sents('text')}) AS sentences,
 len({b.toks('lower(text)')}) AS tokens FROM documents""",
)
def text_lengths(spark, sf):
    """Characters, words, sentences and tokens."""
    t = F.col("text")
    return b.documents(spark, sf).select(
        "doc_id",
        F.length(t).alias("chars"),
        tx.word_count(t).alias("words"),
        F.size(tx.sentences(t)).alias("sentences"),
        F.size(tx.tokens(F.lower(t))).alias("tokens"),
    )


@query(
    "token_lengths",
    f"""SELECT doc_id, n AS tokens, least(n, 2048) AS truncated, (ceil(least(n,2048)/8e0)*8)::BIGINT AS padded
 FROM (SELECT doc_id, len({b.toks('text')}) AS n FROM documents) t""",
)
def token_lengths(spark, sf):
    """Token count, truncated to 2048, padded to a multiple of 8."""
    rows = b.documents(spark, sf).select("doc_id", F.size(tx.tokens(F.col("text"))).alias("tokens"))
    cut, padded = formats.padded_lengths(F.col("tokens"))
    return rows.select("doc_id", "tokens", cut.alias("truncated"), padded.alias("padded"))


@query(
    "ngram_ratios",
    f"""SELECT doc_id, len({b.grams('w', 2)}) AS bigrams, {r6(b.uniq('w'))} AS unigram_ratio, {r6(b.uniq(b.grams('w', 2)))} AS bigram_ratio,
 {r6(b.uniq(b.grams('w', 3)))} AS trigram_ratio, {r6(b.uniq(b.grams('w', 4)))} AS fourgram_ratio, md5(array_to_string({b.grams('w', 3)}, '|')) AS trigrams_md5
 FROM (SELECT doc_id, {b.words('text')} AS w FROM documents) t""",
)
def ngram_ratios(spark, sf):
    """Distinct share of the n-grams of each text."""
    rows = b.documents(spark, sf).select("doc_id", tx.words(F.col("text")).alias("w"))
    w = F.col("w")
    return rows.select(
        "doc_id",
        F.size(tx.ngrams(w, 2)).alias("bigrams"),
        tx.distinct_ratio(w).alias("unigram_ratio"),
        tx.distinct_ratio(tx.ngrams(w, 2)).alias("bigram_ratio"),
        tx.distinct_ratio(tx.ngrams(w, 3)).alias("trigram_ratio"),
        tx.distinct_ratio(tx.ngrams(w, 4)).alias("fourgram_ratio"),
        F.md5(F.array_join(tx.ngrams(w, 3), "|")).alias("trigrams_md5"),
    )


@query(
    "pattern_matches",
    f"""SELECT conv_id, turn, regexp_matches(t, '{"|".join("(" + p + ")" for p in fixed.INSTRUCTION_PATTERNS)}') AS is_directive,
 {" + ".join(f"regexp_matches(t, '(?m){p}')::BIGINT" for p in fixed.TEMPLATE_PATTERNS)} AS template_hits
 FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations) a""",
)
def pattern_matches(spark, sf):
    """Instruction patterns (any) and template patterns (count)."""
    return b.conversations(spark, sf).select("conv_id", "turn", F.lower("text").alias("t")).select(
        "conv_id",
        "turn",
        tx.any_pattern("t", fixed.INSTRUCTION_PATTERNS).alias("is_directive"),
        tx.pattern_hits("t", fixed.TEMPLATE_PATTERNS).alias("template_hits"),
    )


KEYWORDS = {
    "vague": fixed.VAGUE_WORDS,
    "topics": fixed.COMMON_TOPICS,
    "complex": fixed.COMPLEX_INDICATORS,
    "steps": fixed.STEP_INDICATORS,
    "technical": fixed.TECHNICAL_INDICATORS,
    "knowledge": fixed.KNOWLEDGE_INDICATORS,
}


@query(
    "keyword_counts",
    f"""SELECT doc_id, {", ".join(f"{b.count_has('t', words)}::BIGINT AS {name}" for name, words in KEYWORDS.items())}
 FROM (SELECT doc_id, lower(text) AS t FROM documents) a""",
)
def keyword_counts(spark, sf):
    """Presence counts for the six keyword lists."""
    rows = b.documents(spark, sf).select("doc_id", F.lower("text").alias("t"))
    return rows.select("doc_id", *[tx.contains_count("t", w).alias(n) for n, w in KEYWORDS.items()])


@query(
    "readability",
    f"""SELECT doc_id, {r6(b.flesch('n', 's', 'y'))} AS flesch_reading_ease, {r6(b.kincaid('n', 's', 'y'))} AS flesch_kincaid_grade FROM (
 SELECT doc_id, len({b.words('text')}) AS n, len({b.sents('text')}) AS s, {b.syll('text')} AS y FROM documents) t""",
)
def readability(spark, sf):
    """Flesch reading ease and Flesch-Kincaid grade."""
    t = F.col("text")
    rows = b.documents(spark, sf).select(
        "doc_id", tx.word_count(t).alias("n"), F.size(tx.sentences(t)).alias("s"), tx.syllables(t).alias("y")
    )
    parts = (F.col("n"), F.col("s"), F.col("y"))
    return rows.select(
        "doc_id",
        ft.flesch_reading_ease(*parts).alias("flesch_reading_ease"),
        ft.flesch_kincaid_grade(*parts).alias("flesch_kincaid_grade"),
    )


ENGLISH = hyphenation.english_patterns()


@query(
    "pattern_readability",
    f"""WITH {stem_sql.syllables(ENGLISH, "SELECT text FROM documents")},
 sums AS (SELECT doc_id, sum(n)::BIGINT AS y FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM documents) a JOIN syllables USING (w) GROUP BY doc_id)
 SELECT doc_id, coalesce(y, 0) AS syllables, {r6(b.flesch('n', 's', 'y'))} AS flesch_reading_ease, {r6(b.kincaid('n', 's', 'y'))} AS flesch_kincaid_grade FROM (
 SELECT doc_id, len({b.words('text')}) AS n, len({b.sents('text')}) AS s, coalesce(y, 0) AS y FROM documents LEFT JOIN sums USING (doc_id)) t""",
)
def pattern_readability(spark, sf):
    """Both grades on syllables by hyphenation patterns."""
    t = F.col("text")
    counted = hyphenation.syllables(t, hyphenation.Patterns(ENGLISH))
    rows = b.documents(spark, sf).select(
        "doc_id", tx.word_count(t).alias("n"), F.size(tx.sentences(t)).alias("s"), counted.alias("syllables")
    )
    parts = (F.col("n"), F.col("s"), F.col("syllables"))
    return rows.select(
        "doc_id",
        "syllables",
        ft.flesch_reading_ease(*parts).alias("flesch_reading_ease"),
        ft.flesch_kincaid_grade(*parts).alias("flesch_kincaid_grade"),
    )


@query(
    "sentence_style",
    f"""SELECT doc_id, {r6(f"coalesce({b.caps('s')}::DOUBLE/nullif(len(s),0),0)")} AS capital_ratio, {r6(b.len_std('l'))} AS length_std,
 {r6(f"{b.len_std('l')}/(coalesce(list_sum(l)::DOUBLE/nullif(len(l),0),0)+1)")} AS length_variation FROM (
 SELECT doc_id, s, list_transform(s, lambda x: len({b.words('x')})) AS l FROM (SELECT doc_id, {b.sents('text')} AS s FROM documents) a) t""",
)
def sentence_style(spark, sf):
    """Capitalised sentences and spread of sentence lengths."""
    rows = b.documents(spark, sf).select("doc_id", "text", tx.sentences(F.col("text")).alias("s"))
    rows = rows.withColumn("l", ft.sentence_lengths(F.col("s")))
    rows = rows.withColumn("m", ft.length_moments(F.col("l")))
    return rows.select(
        "doc_id",
        F.coalesce(ft.capital_ratio(F.col("text"), F.size("s")), F.lit(0.0)).alias("capital_ratio"),
        ft.length_std(F.col("m")).alias("length_std"),
        ft.length_variation(F.col("m")).alias("length_variation"),
    )


@query(
    "endings_and_structure",
    rf"""SELECT doc_id, {b.proper('text')} AS ends_properly, {b.open_end('text')} AS ends_open, {b.open_end('text', False)} AS incomplete,
 contains(text, chr(10)||chr(10)) AS has_paragraphs, contains(text, chr(10)) AS has_lines, regexp_matches(text, '(?m)^\s*[\d\-*]\s*') AS has_list,
 regexp_matches(text, '(?m)^\s*[\d•\-*]\s*') AS has_bullets, (contains(text,'•') OR contains(text,'- ') OR contains(text,'* ') OR contains(text, chr(10)||'1.')) AS has_marks,
 (contains(text,'```') OR contains(text,'def ')) AS has_code, (contains(text,'```') OR contains(text,'def ') OR contains(text,'function ')) AS has_function,
 (contains(text,'```') OR regexp_matches(text, 'def\s+\w+|function\s+\w+')) AS has_definition, regexp_matches(text, '\p{{Nd}}') AS has_digit,
 (len(w)>10 AND {b.uniq('w')}<0.5e0) AS repetitive FROM (SELECT doc_id, text, {b.words('lower(text)')} AS w FROM documents) t""",
)
def endings_and_structure(spark, sf):
    """Every flag variant, by name."""
    t = F.col("text")
    rows = b.documents(spark, sf).select("doc_id", "text", tx.words(F.lower("text")).alias("w"))
    return rows.select(
        "doc_id",
        ft.ends_properly(t).alias("ends_properly"),
        ft.ends_open(t).alias("ends_open"),
        ft.ends_open(t, with_the=False).alias("incomplete"),
        ft.has_paragraphs(t).alias("has_paragraphs"),
        ft.has_paragraphs(t, blank_line=False).alias("has_lines"),
        ft.has_list(t).alias("has_list"),
        ft.has_list(t, bullets=True).alias("has_bullets"),
        ft.has_list_marks(t).alias("has_marks"),
        ft.has_code(t).alias("has_code"),
        ft.has_code_or_function(t).alias("has_function"),
        ft.has_code_definition(t).alias("has_definition"),
        ft.has_digit(t).alias("has_digit"),
        ft.is_repetitive(F.col("w")).alias("repetitive"),
    )


@query(
    "repetition",
    f"""SELECT doc_id, {r6(f"CASE WHEN len(s)>1 THEN 1-{b.uniq('s')} ELSE 0e0 END")} AS sentence_repetition,
 {r6(f"CASE WHEN len(k)>3 THEN 1-{b.uniq(b.grams('k', 3))} ELSE 0e0 END")} AS trigram_repetition
 FROM (SELECT doc_id, {b.sents('text')} AS s, {b.toks('lower(text)')} AS k FROM documents) t""",
)
def repetition(spark, sf):
    """Repeated sentences and trigrams."""
    rows = b.documents(spark, sf).select(
        "doc_id", tx.sentences(F.col("text")).alias("s"), tx.tokens(F.lower("text")).alias("k")
    )
    return rows.select(
        "doc_id",
        ft.sentence_repetition(F.col("s")).alias("sentence_repetition"),
        ft.trigram_repetition(F.col("k")).alias("trigram_repetition"),
    )


_CONTENT = b.content("list_filter(" + b.toks("lower(text)") + r", lambda w: regexp_full_match(w,'[\p{L}\p{N}]{3,}'))")


@query(
    "information_density",
    f"""SELECT doc_id, {r6("CASE WHEN len(c)=0 THEN 0.3e0 ELSE least(1e0, list_unique(c)::DOUBLE/len(c)*1.5e0) END")} AS density
 FROM (SELECT doc_id, {_CONTENT} AS c FROM documents) t""",
)
def information_density(spark, sf):
    """Distinct share of content words."""
    rows = b.documents(spark, sf).select("doc_id", ft.content_tokens(F.lower("text")).alias("c"))
    return rows.select("doc_id", ft.information_density(F.col("c")).alias("density"))


@query(
    "length_ratio",
    f"""SELECT idx, {r6(f"CASE WHEN instruction<>'' THEN len({b.words('response')})::DOUBLE/greatest(len({b.words('instruction')}),1) END")} AS length_ratio
 FROM ({b.CHAT_PAIRS}) t""",
)
def length_ratio(spark, sf):
    """Response words per instruction word."""
    return b.chat_pairs(spark, sf).select("idx", ft.length_ratio(F.col("response"), F.col("instruction")).alias("length_ratio"))


_SET = f"list_distinct({b.content(b.alnum('lower(x)'))})"


@query(
    "sentence_coherence",
    f"""SELECT doc_id, {r6("CASE WHEN len(p)>0 THEN list_sum(p)/len(p) END")} AS coherence FROM (
 SELECT doc_id, list_transform(range(1, len(s)), lambda i: {b.jac('s[i]', 's[i+1]')}) AS p FROM (
 SELECT doc_id, list_transform({b.sents('text')}, lambda x: {_SET}) AS s FROM documents) a) t""",
)
def sentence_coherence(spark, sf):
    """Mean overlap of neighbouring sentences."""
    rows = b.documents(spark, sf).select("doc_id", tx.sentences(F.col("text")).alias("s"))
    rows = rows.select("doc_id", ft.sentence_words(F.col("s")).alias("w"))
    return rows.select("doc_id", ft.coherence(F.col("w")).alias("coherence"))


GRAMMAR = f"""SELECT doc_id, source, {b.grammar('text', 'len(w)', 's', 'w')} AS g,
 coalesce((length(text)-length(translate(text, '.!?;:,', '')))::DOUBLE/nullif(length(text),0),0) AS p FROM (
 SELECT doc_id, source, text, {b.words('lower(text)')} AS w, {b.sents('text')} AS s FROM documents) a"""


@query("grammar_score", f"SELECT doc_id, {r6('p')} AS punctuation_ratio, {r6('g')} AS grammar FROM ({GRAMMAR}) t")
def grammar_score(spark, sf):
    """Punctuation share and grammar score."""
    rows = b.documents(spark, sf).withColumn("punctuation_ratio", ft.punctuation_ratio(F.col("text")))
    return corpus.grammar_rows(rows, "text", ["doc_id", "punctuation_ratio"])


@query(
    "top_grammar",
    f"SELECT doc_id, source, {r6('g')} AS grammar FROM ({GRAMMAR}) t ORDER BY g DESC, doc_id LIMIT 20",
)
def top_grammar(spark, sf):
    """The twenty best documents by grammar score."""
    rows = corpus.grammar_rows(b.documents(spark, sf), "text", ["doc_id", "source"])
    return ranking.top_k(rows, 20, "grammar", "doc_id")


@query(
    "length_scores",
    f"""SELECT doc_id, CASE WHEN n<3 THEN 0.3e0 WHEN n>100 THEN 0.7e0 WHEN n BETWEEN 5 AND 50 THEN 1e0 ELSE 0.85e0 END AS as_instruction,
 CASE WHEN n<5 THEN 0.2e0 WHEN n>1000 THEN 0.7e0 WHEN n BETWEEN 20 AND 500 THEN 1e0 ELSE 0.8e0 END AS as_response
 FROM (SELECT doc_id, len({b.words('text')}) AS n FROM documents) t""",
)
def length_scores(spark, sf):
    """Piecewise length scores."""
    rows = b.documents(spark, sf).select("doc_id", tx.word_count(F.col("text")).alias("n"))
    return rows.select(
        "doc_id",
        ft.instruction_length_score(F.col("n")).alias("as_instruction"),
        ft.response_length_score(F.col("n")).alias("as_response"),
    )


@query(
    "generation_scores",
    f"""SELECT doc_id, {r6("list_unique(w)::DOUBLE/nullif(len(w),0)")} AS diversity, CASE WHEN {b.strip('text')}<>'' THEN
 CASE WHEN {b.proper('text')} THEN 1e0 ELSE 0.5e0 END END AS coherence FROM (SELECT doc_id, text, {b.words('text')} AS w FROM documents) t""",
)
def generation_scores(spark, sf):
    """Distinct words and the two-level ending score."""
    rows = b.documents(spark, sf).select("doc_id", "text", tx.words(F.col("text")).alias("w"))
    return rows.select(
        "doc_id", ft.generation_diversity(F.col("w")).alias("diversity"), ft.generation_coherence(F.col("text")).alias("coherence")
    )

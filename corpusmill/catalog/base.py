"""The registry, table access and SQL fragments shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import fixed
from corpusmill.operators import formats
from corpusmill.sources.tables import spread_out

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; its doubles are rounded and its integers widened for comparison."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(function(spark, sf_dir))

        run.__doc__ = function.__doc__
        run.__name__ = function.__name__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def comparable(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # Non-finite and very large values stay as they are: floor() gives a BIGINT.
            c = F.when(F.abs(c) < 9e12, F.floor(c * 1e6 + 0.5) / 1e6).otherwise(c.cast("double"))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    """The documents, dealt to all cores when the scan alone would leave some idle."""
    return spread_out(table(spark, sf_dir, "documents"))


def conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def chat_pairs(spark, sf_dir) -> DataFrame:
    """Every user turn of every chat with its answer; ``idx`` is chat:turn."""
    idx = F.concat_ws(":", "conv_id", "turn").alias("idx")
    return formats.exchanges(conversations(spark, sf_dir)).select(idx, "instruction", "response")


def document_pairs(spark, sf_dir) -> DataFrame:
    """Every document as a response, its first line as the instruction."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("idx"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("instruction"),
        F.col("text").alias("response"),
    )


# --- SQL fragments ---------------------------------------------------------------------------------
WS = fixed.SPACE_CLASS


def r6(expr: str) -> str:
    return f"floor(({expr})*1e6+0.5e0)/1e6"


def text_list(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


STOPS = text_list(fixed.STOP_WORDS)


def words(t: str) -> str:
    return f"regexp_extract_all({t}, '[^{WS}]+')"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sents(t: str) -> str:
    return (
        f"list_filter(string_split(regexp_replace({strip(t)}, '([.!?])[{WS}]+', '\\1'||chr(1), 'g'), chr(1)),"
        " lambda s: s<>'')"
    )


#: Row ``learned`` (ab, st): abbreviations and sentence starters, counted on the column ``text`` of a table.
_CORE = "regexp_replace({0}, '^[^\\p{{L}}\\p{{N}}]+', '')"
_OWN = "CASE WHEN {0} <= 0 OR {1} <= 0 THEN 0e0 ELSE {0}*ln({2}) + {1}*ln(1-({2})) END"


def learned(source: str) -> str:
    """CTEs ending in ``learned`` over the texts of ``source`` (text)."""
    near = f"SELECT w[i] AS word, CASE WHEN i > 1 THEN w[i-1] ELSE '' END AS before FROM (SELECT w, unnest(range(1, len(w)+1)) AS i FROM (SELECT {words("coalesce(text, '')")} AS w FROM ({source}) q) a) b"
    gain = "2*((c*ln(0.99e0) + m*ln(1-0.99e0)) - (c*ln(p) + m*ln(1-p)))"
    ends = "ends_with(core, '.') AND NOT ends_with(core, '..')"
    alone = "(ab*ln(ab/a) + CASE WHEN ab < a THEN (a-ab)*ln(1-ab/a) ELSE 0e0 END)"
    apart = "CASE WHEN n > a AND b > ab AND b-ab < n-a THEN (b-ab)*ln((b-ab)/(n-a)) + (n-a-b+ab)*ln(1-(b-ab)/(n-a)) ELSE 0e0 END"
    rate = "CASE WHEN b < n THEN {0}*ln(b/n) + ({1})*ln(1-b/n) END"
    return rf"""near AS MATERIALIZED ({near}),
 cores AS MATERIALIZED (SELECT regexp_replace({_CORE.format('word')}, '[^\p{{L}}\p{{N}}.]+$', '') AS core FROM near),
 types AS (SELECT lower(CASE WHEN {ends} THEN left(core, len(core)-1) ELSE core END) AS word, {ends} AS e FROM cores),
 ended AS (SELECT word, count(*) FILTER (e) AS with_period, count(*) FILTER (NOT e) AS without FROM types GROUP BY word),
 sized AS (SELECT word, with_period, without, with_period::DOUBLE AS c, without::DOUBLE AS m, (SELECT avg(e::INT) FROM types) AS p,
  len(word)-len(replace(word,'.','')) AS d FROM ended WHERE with_period > 0 AND regexp_matches(word, '^\p{{L}}([\p{{L}}.]*\p{{L}})?$')),
 abbreviations AS MATERIALIZED (SELECT word, with_period, without, {gain}*exp(-(len(word)-d+1))*(d+1)*pow(len(word)-d+1, -m) AS score FROM sized),
 ab AS (SELECT coalesce(list(word), []) AS ab FROM abbreviations WHERE score >= 0.3),
 follows AS (SELECT lower(regexp_extract(word, '^\p{{L}}+')) AS word, regexp_matches(before, '[.!?]$')
   AND NOT (ends_with(before, '.') AND list_contains(ab, left(lower({_CORE.format('before')}), len({_CORE.format('before')})-1))) AS e FROM near, ab),
 starting AS (SELECT word, count(*) FILTER (e) AS after_end, count(*) AS times FROM follows GROUP BY word),
 counted AS (SELECT word, after_end, times, after_end::DOUBLE AS ab, times::DOUBLE AS b, (SELECT sum(e::INT)::DOUBLE FROM follows) AS a, (SELECT count(*)::DOUBLE FROM follows) AS n FROM starting),
 starters AS MATERIALIZED (SELECT word, after_end, times, CASE WHEN ab*n > a*b THEN
  2*({alone} + {apart} - ({rate.format('ab', 'a-ab')}) - ({rate.format('(b-ab)', 'n-a-b+ab')})) ELSE 0e0 END AS score FROM counted WHERE word <> '' AND a > 0),
 learned AS (SELECT ab, (SELECT coalesce(list(word), []) FROM starters WHERE score >= 30) AS st FROM ab)"""


def learned_sents(t: str) -> str:
    """Sentences of a text under the columns ``ab`` and ``st``: pieces of the plain rule put together again."""
    last = f"regexp_extract(a[len(a)], '[^{WS}]+$')"
    core = _CORE.format(last)
    capital = r"regexp_matches(x[1], '^\p{Lu}')"
    short = rf"(list_contains(ab, left(lower({core}), len({core})-1)) OR (regexp_matches({core}, '^\p{{L}}\.$') AND {capital}))"
    starter = rf"({capital} AND list_contains(st, lower(regexp_extract(x[1], '^\p{{L}}+'))))"
    joins = rf"""((ends_with({core}, '.') AND {short} AND NOT {starter}) OR (regexp_matches({core}, '^\p{{Nd}}+\.$') AND regexp_matches(x[1], '^\p{{Ll}}'))
 OR (ends_with({last}, '...') AND NOT {capital}))"""
    return f"""CASE WHEN len({sents(t)}) < 2 THEN {sents(t)} ELSE list_reduce(list_transform({sents(t)}, lambda s: [s]),
 lambda a, x: CASE WHEN {joins} THEN a[:-2] || [a[len(a)] || ' ' || x[1]] ELSE a || x END) END"""


def toks(t: str) -> str:
    return rf"regexp_extract_all({t}, '[\p{{L}}\p{{N}}]+|[^{WS}\p{{L}}\p{{N}}]')"


def alnum(t: str) -> str:
    return rf"list_filter({words(t)}, lambda w: regexp_full_match(w, '[\p{{L}}\p{{N}}]+'))"


def content(items: str) -> str:
    return f"list_filter({items}, lambda w: NOT list_contains({STOPS}, w))"


def syll(t: str) -> str:
    return (
        f"coalesce(list_sum(list_transform({words(f'lower({t})')}, "
        "lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+'))))), 0)"
    )


def grams(w: str, n: int, sep: str = " ") -> str:
    last = f"greatest(len({w})-{n - 1}, 0)"
    parts = ", ".join(f"{w}[{i}:{last}+{i - 1}]" for i in range(1, n + 1))
    joined = f"||'{sep}'||".join(f"z[{i}]" for i in range(1, n + 1))
    return f"CASE WHEN len({w})<{n} THEN []::VARCHAR[] ELSE list_transform(list_zip({parts}), lambda z: {joined}) END"


def uniq(items: str) -> str:
    return f"coalesce(list_unique({items})::DOUBLE/nullif(len({items}),0), 0)"


def caps(s: str) -> str:
    return rf"len(list_filter({s}, lambda s: regexp_matches(s, '^\p{{Lu}}')))"


def has(t: str, needle: str) -> str:
    return f"contains({t}, '{needle}')"


def count_has(t: str, needles) -> str:
    return "(" + " + ".join(f"contains({t}, '{n}')::INT" for n in needles) + ")"


def flesch(n: str, s: str, y: str) -> str:
    return f"(206.835e0 - 1.015e0*({n}::DOUBLE/nullif({s},0)) - 84.6e0*({y}::DOUBLE/nullif({n},0)))"


def kincaid(n: str, s: str, y: str) -> str:
    return f"(0.39e0*({n}::DOUBLE/nullif({s},0)) + 11.8e0*({y}::DOUBLE/nullif({n},0)) - 15.59e0)"


def hash32(seed: int, *ids: str) -> str:
    joined = "||':'||".join([f"'{seed}'", *[f"({i})::VARCHAR" for i in ids]])
    return f"('0x'||substr(md5({joined}),1,8))::BIGINT"


def proper(t: str) -> str:
    return f"regexp_matches({strip(t)}, '[.!?]$')"


def open_end(t: str, with_the: bool = True) -> str:
    return f"regexp_matches({strip(t)}, '(,|;|and|or{'|the' if with_the else ''})$')"


def jac(a: str, b: str) -> str:
    return (
        f"CASE WHEN len({a})=0 OR len({b})=0 THEN 0e0 ELSE "
        f"len(list_intersect({a},{b}))::DOUBLE/len(list_distinct(list_concat({a},{b}))) END"
    )


def len_std(lengths: str) -> str:
    sq = f"list_sum(list_transform({lengths}, lambda x: (x*x)::BIGINT))::BIGINT"
    sm = f"list_sum({lengths})::BIGINT"
    n = f"len({lengths})"
    return f"coalesce(sqrt(({n}*{sq}-{sm}*{sm})::DOUBLE/nullif({n}*{n},0)),0)"


def grammar(t: str, n: str, s: str, low_words: str) -> str:
    """Grammar score from a text, its word count, its sentences and its lower-case words."""
    punct = f"(length({t})-length(translate({t}, '.!?;:,', '')))::DOUBLE/nullif(length({t}),0)"
    return (
        f"least(0.3e0*coalesce({caps(s)}::DOUBLE/nullif(len({s}),0),0) + 0.2e0*least(coalesce({punct},0)*20,1e0) + "
        f"0.3e0*coalesce(greatest(0e0, 1e0-abs({n}::DOUBLE/nullif(len({s}),0)-17.5e0)/17.5e0),0) + "
        f"0.2e0*{uniq(low_words)}, 1e0)"
    )


EXCHANGES = """SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.turn, a.turn-1) AS turn, u.text AS instruction, a.text AS response
 FROM (SELECT * FROM conversations WHERE role='user') u FULL JOIN (SELECT * FROM conversations WHERE role='assistant') a
 ON u.conv_id=a.conv_id AND u.turn+1=a.turn"""
CHAT_PAIRS = f"SELECT conv_id||':'||turn AS idx, instruction, response FROM ({EXCHANGES}) x"
DOCUMENT_PAIRS = "SELECT doc_id AS idx, split_part(text, chr(10), 1) AS instruction, text AS response FROM documents"


def mean5(*parts: str) -> str:
    return "(" + " + ".join(f"({p})" for p in parts) + f")/{len(parts)}e0"


def scored_sql(source: str, learn: bool = False) -> str:
    """CTEs ending in ``scored`` (idx, four components, score) over ``source`` (idx, instruction, response).

    With ``learn`` a row ``learned`` says where sentences end.
    """
    of_ins = learned_sents("ins") if learn else sents("ins")
    of_res = f"list_transform({learned_sents('res')}, lambda s: lower(s))" if learn else sents("res_l")
    directive = "|".join(f"({p})" for p in fixed.INSTRUCTION_PATTERNS)
    ease = flesch("len(iw)", "len(isn)", "isy")
    clarity = mean5(
        "CASE WHEN len(iw)<3 THEN 0.3e0 WHEN len(iw)>100 THEN 0.7e0 WHEN len(iw) BETWEEN 5 AND 50 THEN 1e0 ELSE 0.85e0 END",
        f"CASE WHEN contains(ins,'?') OR regexp_matches(ins_l, '{directive}') THEN 1e0 ELSE 0.6e0 END",
        f"CASE WHEN {ease} IS NULL THEN 0.7e0 WHEN {ease}<30 THEN 0.6e0 WHEN {ease}>80 THEN 0.9e0 ELSE 0.7e0+({ease}-30)/200 END",
        f"greatest(0.4e0, 1e0-{count_has('ins_l', fixed.VAGUE_WORDS)}*0.2e0)",
        f"CASE WHEN len(isn)=0 THEN 0.6e0 ELSE 0.5e0+({caps('isn')}::DOUBLE/len(isn))*0.5e0 END",
    )
    spread = f"({len_std('rl')} / (list_sum(rl)::DOUBLE/len(rl) + 1))"
    quality = mean5(
        "CASE WHEN rn<5 THEN 0.2e0 WHEN rn>1000 THEN 0.7e0 WHEN rn BETWEEN 20 AND 500 THEN 1e0 ELSE 0.8e0 END",
        "least(1e0, 0.6e0 + CASE WHEN contains(res,chr(10)) THEN 0.2e0 ELSE 0e0 END"
        r" + CASE WHEN regexp_matches(res, '(?m)^\s*[\d•\-*]\s*') THEN 0.1e0 ELSE 0e0 END"
        r" + CASE WHEN (contains(res,'```') OR regexp_matches(res, 'def\s+\w+|function\s+\w+'))"
        " AND (contains(ins_l,'code') OR contains(ins_l,'function')) THEN 0.1e0 ELSE 0e0 END)",
        f"CASE WHEN len(rl)>2 THEN CASE WHEN {spread} BETWEEN 0.3e0 AND 0.7e0 THEN 1e0 ELSE 0.7e0 END ELSE 0.8e0 END",
        f"CASE WHEN {strip('res')}='' THEN 0e0 WHEN {open_end('res')} THEN 0.4e0 WHEN {proper('res')} THEN 1e0 ELSE 0.7e0 END",
        "CASE WHEN len(rc)=0 THEN 0.3e0 ELSE least(1e0, list_unique(rc)::DOUBLE/len(rc)*1.5e0) END",
    )
    templates = "(" + " + ".join(f"regexp_matches(res_l, '(?m){p}')::INT" for p in fixed.TEMPLATE_PATTERNS) + ")"
    diversity = (
        f"CASE WHEN len(bw)=0 THEN 0e0 ELSE (least(1e0, {uniq('bt')}*2) + {uniq('g2')} + {uniq('g3')} + "
        f"(1e0-least({count_has('both_l', fixed.COMMON_TOPICS)}*0.05e0, 0.3e0)) + greatest(0.5e0, 1e0-{templates}*0.1e0))"
        " / (3 + (len(bw)>=2)::INT + (len(bw)>=3)::INT) END"
    )
    clause = count_has("s", fixed.CLAUSE_WORDS)
    complexity = mean5(
        f"least(1e0, 0.5e0+{count_has('ins_l', fixed.COMPLEX_INDICATORS)}*0.25e0)",
        f"least(1e0, 0.4e0+{count_has('res_l', fixed.STEP_INDICATORS)}*0.15e0)",
        f"least(1e0, 0.5e0+{count_has('res_l', fixed.TECHNICAL_INDICATORS)}*0.1e0)",
        f"least(1e0, 0.6e0+{count_has('res_l', fixed.KNOWLEDGE_INDICATORS)}*0.2e0)",
        f"CASE WHEN len(rl)>3 THEN least(1e0, 0.5e0+(list_sum(list_transform(rls, lambda s: {clause}))::DOUBLE/len(rl))*0.5e0) ELSE 0.6e0 END",
    )
    w = fixed.DIMENSION_WEIGHTS
    total = " + ".join(f"{c}*{w[c]}e0" for c in w)
    return f"""src AS ({source}),
 t0 AS (SELECT idx, coalesce(instruction,'') AS ins, coalesce(response,'') AS res{', ab, st' if learn else ''} FROM src{', learned' if learn else ''}),
 t1 AS (SELECT *, lower(ins) AS ins_l, lower(res) AS res_l, lower(ins||' '||res) AS both_l FROM t0),
 t2 AS MATERIALIZED (SELECT *, {words('ins')} AS iw, {of_ins} AS isn, {syll('ins')} AS isy, len({words('res')}) AS rn,
  {of_res} AS rls, list_transform({of_res}, lambda s: len({words('s')})) AS rl,
  {content("list_filter(" + toks('res_l') + r", lambda w: regexp_full_match(w,'[\p{L}\p{N}]{3,}'))")} AS rc,
  {words('both_l')} AS bw, {toks('both_l')} AS bt FROM t1),
 t3 AS MATERIALIZED (SELECT *, {grams('bw', 2, '_')} AS g2, {grams('bw', 3, '_')} AS g3 FROM t2),
 t4 AS MATERIALIZED (SELECT idx, CASE WHEN ins='' THEN 0e0 ELSE {clarity} END AS clarity,
  CASE WHEN res='' THEN 0e0 ELSE {quality} END AS response_quality, {diversity} AS diversity, {complexity} AS complexity FROM t3),
 scored AS MATERIALIZED (SELECT *, {total} AS score FROM t4)"""

"""The stemmer and the longest common subsequence in SQL, written apart from their Spark forms."""

from __future__ import annotations

from corpusmill.functions import fixed, hyphenation


def _vowels(part: str) -> str:
    """The part with every y that is a vowel written as i."""
    return f"regexp_replace({part}, '(^y|[^aeiouy])y', '\\1i', 'g')"


def _measured(part: str, times: int) -> str:
    return f"regexp_matches({_vowels(part)}, '^[^aeiou]*{'[aeiou]+[^aeiou]+' * times}')"


def _short(part: str) -> str:
    return f"regexp_matches({_vowels(part)}, '[^aeiou][aeiou][^aeiouwxy]$|^[aeiou][^aeiou]$')"


def _rules(rules, condition) -> str:
    cases = []
    for suffix, to in rules:
        rest = f"left(w, len(w) - {len(suffix)})"
        cases.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {condition(rest, suffix)} THEN {rest} || '{to}' ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def stems(words: str) -> str:
    """CTEs ending in ``stems`` (word, stem) for the words of the query ``words`` (word)."""
    irregular = " ".join(f"WHEN '{form}' THEN '{stem}'" for stem, forms in fixed.STEM_IRREGULAR.items() for form in forms.split())
    past = "regexp_replace(w, '(ed|ing)$', '')"
    steps = [
        f"CASE WHEN ends_with(w, 'ies') AND len(w) = 4 THEN left(w, 3) ELSE {_rules(fixed.STEM_PLURALS, lambda r, s: 'true')} END",
        f"""CASE WHEN ends_with(w, 'ied') THEN left(w, len(w) - CASE WHEN len(w) = 4 THEN 1 ELSE 2 END)
 WHEN ends_with(w, 'eed') THEN CASE WHEN {_measured('left(w, len(w) - 3)', 1)} THEN left(w, len(w) - 1) ELSE w END
 WHEN NOT regexp_matches(w, '(ed|ing)$') OR NOT regexp_matches({_vowels(past)}, '[aeiou]') THEN w
 WHEN regexp_matches({past}, '(at|bl|iz)$') THEN {past} || 'e'
 WHEN len({past}) > 1 AND right({past}, 1) = left(right({past}, 2), 1) AND NOT regexp_matches({_vowels(past)}, '[aeiou]$')
  THEN CASE WHEN right({past}, 1) IN ('l', 's', 'z') THEN {past} ELSE left({past}, len({past}) - 1) END
 WHEN {_measured(past, 1)} AND NOT {_measured(past, 2)} AND {_short(past)} THEN {past} || 'e' ELSE {past} END""",
        f"CASE WHEN ends_with(w, 'y') AND len(w) > 2 AND NOT regexp_matches({_vowels('left(w, len(w) - 1)')}, '[aeiou]$') THEN left(w, len(w) - 1) || 'i' ELSE w END",
        f"CASE WHEN ends_with(w, 'alli') AND {_measured('left(w, len(w) - 4)', 1)} THEN left(w, len(w) - 2) ELSE w END",
        _rules(fixed.STEM_DOUBLE_SUFFIXES, lambda r, s: _measured(f"{r} || 'l'" if s == "logi" else r, 1)),
        _rules(fixed.STEM_SUFFIXES, lambda r, s: _measured(r, 1)),
        _rules(
            [(s, "") for s in fixed.STEM_LAST_SUFFIXES.split()],
            lambda r, s: _measured(r, 2) + (f" AND right({r}, 1) IN ('s', 't')" if s == "ion" else ""),
        ),
        f"CASE WHEN ends_with(w, 'e') AND ({_measured('left(w, len(w) - 1)', 2)} OR ({_measured('left(w, len(w) - 1)', 1)} AND NOT {_short('left(w, len(w) - 1)')})) THEN left(w, len(w) - 1) ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {_measured('left(w, len(w) - 1)', 2)} THEN left(w, len(w) - 1) ELSE w END",
    ]
    chain = [f"stem0 AS (SELECT DISTINCT word, word AS w FROM ({words}) q)"]
    chain += [f"stem{k} AS MATERIALIZED (SELECT word, {step} AS w FROM stem{k - 1})" for k, step in enumerate(steps, 1)]
    chain.append(
        f"stems AS MATERIALIZED (SELECT word, CASE WHEN len(word) <= 3 THEN word ELSE CASE word {irregular} ELSE w END END AS stem FROM stem{len(steps)})"
    )
    return ", ".join(chain)


FULL = (1 << 60) - 1


def subsequence(table: str) -> str:
    """CTEs ending in ``lcs`` (id, lcs) for the token lists ``pt`` and ``rt`` of a table: the reference as bits in words of 60."""
    hit = "(e[1] & e[2])"
    return f"""lfull AS (SELECT id, list_transform(range((len(rt) + 59) // 60), lambda k: (1::BIGINT << least(60, len(rt) - 60 * k)::INT) - 1) AS f FROM {table} WHERE len(rt) > 0),
 lref AS (SELECT id, unnest(rt) AS w, unnest(range(len(rt))) AS i FROM {table}),
 lmask AS (SELECT id, w, i // 60 AS limb, bit_or(1::BIGINT << (i % 60)::INT) AS m FROM lref GROUP BY ALL),
 lgrid AS (SELECT DISTINCT id, w, unnest(range(len(f))) AS limb FROM lmask JOIN lfull USING (id)),
 ldense AS (SELECT id, w, list(coalesce(m, 0) ORDER BY limb) AS m FROM lgrid LEFT JOIN lmask USING (id, w, limb) GROUP BY id, w),
 lpre AS (SELECT id, unnest(pt) AS w, unnest(range(len(pt))) AS j FROM {table}),
 lsteps AS (SELECT id, list(m ORDER BY j) AS ms FROM lpre JOIN ldense USING (id, w) GROUP BY id),
 lrun AS (SELECT id, f, list_reduce([f] || ms, lambda v, m: list_reduce([[0::BIGINT]] || list_transform(range(1, len(v) + 1), lambda k: [v[k], m[k]]),
   lambda s, e: [(e[1] + {hit} + s[1]) >> 60] || s[2:] || [((e[1] + {hit} + s[1]) & {FULL}) | (e[1] - {hit})])[2:]) AS v FROM lsteps JOIN lfull USING (id)),
 lcs AS (SELECT id, list_sum(list_transform(range(1, len(f) + 1), lambda k: bit_count(f[k]) - bit_count(v[k] & f[k])))::BIGINT AS lcs FROM lrun)"""


def syllables(patterns: list[str], source: str) -> str:
    """CTEs ending in ``syllables`` (w, n) for the words of ``source`` (text): patterns joined on every part of a word."""
    rows = ", ".join(f"('{letters}', {levels})" for letters, levels in map(hyphenation.parsed, patterns))
    longest = max(len(hyphenation.parsed(p)[0]) for p in patterns)
    return f"""pats(letters, levels) AS MATERIALIZED (VALUES {rows}),
 hwords AS MATERIALIZED (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM ({source}) q) a),
 starts AS (SELECT w, unnest(range(1, len(w) + 3)) AS i FROM hwords),
 subs AS (SELECT w, i, unnest(list_distinct([substr('.' || w || '.', i, n) FOR n IN range(1, {longest + 1})])) AS s FROM starts),
 hits AS (SELECT w, i, unnest(levels) AS level, unnest(range(len(levels))) AS k FROM subs JOIN pats ON s = letters),
 places AS (SELECT w, i + k - 2 AS spot, max(level) AS level FROM hits GROUP BY ALL),
 syllables AS MATERIALIZED (SELECT hwords.w, 1 + count(level) AS n FROM hwords LEFT JOIN places
  ON places.w = hwords.w AND level % 2 = 1 AND spot BETWEEN 1 AND len(hwords.w) - 1 GROUP BY hwords.w)"""

"""URL rules and lists: a blocked Bloom filter passes possible hits to an exact hash join. Spark expressions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import keep

#: Bits of the filter per listed URL, bits set per URL, and the largest filter that is broadcast.
BITS_PER_URL, PROBES, BROADCAST_BYTES = 16, 6, 32 << 20
#: Query parameters that do not change the page.
TRACKING = "utm_[a-z]+|gclid|fbclid|ref"


@dataclass(frozen=True)
class Rule:
    """Holds for ``host`` and all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; empty for null or no ``://``."""
    found = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit(""))


def canonical(url: Column) -> Column:
    """One spelling for the addresses of a page.

    Host without ``www.`` and default ports, path without trailing slashes, query without tracking parameters (the
    others keep their order), no scheme and no fragment. Null and texts without ``://`` have none (null).
    """
    name = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)$", "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(f"^(({TRACKING})(=|$)|$)")), "&")
    tail = F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept))
    return F.when(F.contains(url, F.lit("://")), F.concat(name, F.regexp_replace(path(url), "/+$", ""), tail))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), else null; of equally long ones the first given.

    One branch per rule: for lists a person writes. Long lists of URLs go into the Bloom filter.
    """
    out = None
    for rule in sorted(rules, key=lambda r: -len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    if out is None:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    return out


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), url), F.lit(blocks))


def _mask(url: Column) -> Column:
    """The bits of a URL in its block of 64."""
    bits = F.xxhash64(F.lit(2), url)
    out, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    for i in range(PROBES):
        at = F.shiftrightunsigned(bits, 10 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", one, at))
    return out


def bloom_filter(listed: DataFrame, url: str, count: int) -> tuple[DataFrame, int]:
    """(block, bits) of the non-empty 64-bit blocks of a Bloom filter for ``count`` URLs, and its number of blocks.

    Blocks are a power of two, so that the filter has ``BITS_PER_URL`` to twice as many bits per URL.
    """
    blocks = 1 << max(0, math.ceil(math.log2(max(1, count) * BITS_PER_URL / 64)))
    bits = listed.select(_block(F.col(url), blocks).alias("_block"), _mask(F.col(url)).alias("_bits"))
    return bits.groupBy("_block").agg(F.bit_or("_bits").alias("_bits")), blocks


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, canonical, rule, verdict, listed) of every row of ``pages``.

    The verdict is that of the longest rule that fits; without one, URLs whose canonical form is that of a URL in
    ``listed`` (column ``url``) are blocked and all others allowed.

    Rows that the filter rules out are never shuffled. The filter is broadcast up to ``BROADCAST_BYTES`` (its size
    follows from the number of listed URLs) and joined by block beyond; the exact join is a hash join on the
    canonical URL, whose large partitions Spark splits on the side of the pages.

    Null URLs and texts without ``://`` have empty host and path, fit no rule, are in no list and are allowed. The
    list may be empty and may repeat URLs or hold nulls. Null and repeated keys and rows stay as they are. Other
    columns are not read.
    """
    known = listed.select(canonical(F.col(url)).alias("canonical")).where("canonical IS NOT NULL").distinct()
    known = keep(known, "listed")
    filled, blocks = bloom_filter(known, "canonical", known.count())
    if blocks * 16 <= BROADCAST_BYTES:
        filled = F.broadcast(filled)
    rows = pages.select(F.col(key).alias(key), F.col(url).alias("_u"))
    parsed = rows.select(
        key, host(F.col("_u")).alias("host"), path(F.col("_u")).alias("path"), canonical(F.col("_u")).alias("canonical")
    )
    ruled = parsed.withColumn("_fit", matching_rule(F.col("host"), F.col("path"), rules))
    probed = ruled.withColumn("_block", _block(F.col("canonical"), blocks)).join(filled, "_block", "left")
    mask = _mask(F.col("canonical"))
    passed = F.coalesce(F.col("_bits").bitwiseAND(mask) == mask, F.lit(False))
    out = (key, "host", "path", "canonical", "_fit")
    ruled_out = probed.where(~passed).select(*out, F.lit(False).alias("listed"))
    exact = known.withColumn("_known", F.lit(True)).hint("shuffle_hash")
    possible = probed.where(passed).select(*out).join(exact, "canonical", "left")
    every = ruled_out.union(possible.select(*out, F.coalesce("_known", F.lit(False)).alias("listed")))
    return every.select(
        key,
        "host",
        "path",
        "canonical",
        F.col("_fit.rule").alias("rule"),
        F.coalesce("_fit.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed",
    )

"""Homomorphic multiset fingerprints of texts, in Spark expressions only.

A text is the multiset of its paragraphs. Every paragraph is hashed to a wide vector of small entries, and the vectors
are summed lane by lane modulo 2^31. The sum does not depend on the order of the paragraphs; the fingerprint of two
multisets together is the sum of theirs, so paragraphs can be put in (``added``) and taken out (``removed``) without
the rest of the text. As the entries are small and spread evenly around their mean, the fingerprints also tell how
much two texts have in common (``likeness``).

A fingerprint is a struct of ``total`` (the weights of all paragraphs) and ``lanes``, integers of 31 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import ranking
from corpusmill.session import keep

#: Lanes of a fingerprint: one for each hexadecimal digit of two SHA-256 digests.
LANES = 128
#: The largest entry, before the weight.
ENTRY = 15
#: A line of more code points than this is cut into its sentences.
LONG_LINE = 160
MODULUS = 1 << 31


def paragraphs(text: Column, long_line: int = LONG_LINE) -> Column:
    """The lines of a text; those of over ``long_line`` code points are cut after ``.``, ``!`` or ``?`` and a blank.

    Nothing is dropped: joined, the paragraphs are the text without its line feeds. An empty text has one, empty.
    """
    cut = F.transform(
        F.split(text, "\n"),
        lambda line: F.when(F.length(line) <= long_line, F.array(line)).otherwise(
            F.split(F.regexp_replace(line, "([.!?]) ", "$1 \n"), "\n")
        ),
    )
    return F.flatten(cut)


def fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text", long_line: int = LONG_LINE) -> DataFrame:
    """(keys, ``fingerprint``) of the text of every combination of ``keys``; a null text is empty.

    Rows of the same keys must have the same text, which counts once. A paragraph weighs the root of its length, at least one. Paragraphs become rows that are summed where they are, so
    that one row for each text and task is exchanged, or none if the texts come partitioned by the keys.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*keys, F.posexplode(paragraphs(text, long_line)).alias("_at", "_p"))
    weight = F.greatest(F.lit(1), F.floor(F.sqrt(F.length("_p")))).cast("bigint")
    rows = rows.select(*keys, "_at", weight.alias("_weight"), F.sha2("_p", 256).alias("_a"))
    rows = rows.select("*", F.sha2("_a", 256).alias("_b"))
    words = [
        F.conv(F.substring(digest, at, 16), 16, -10).cast("bigint").alias(f"_{digest}{at}")
        for digest in ("_a", "_b")
        for at in (1, 17, 33, 49)
    ]
    rows = rows.select(*keys, "_at", "_weight", *words)
    entries = [
        F.shiftright(f"_{digest}{at}", 60 - 4 * k).bitwiseAND(ENTRY) * F.col("_weight")
        for digest in ("_a", "_b")
        for at in (1, 17, 33, 49)
        for k in range(16)
    ]
    summed = rows.groupBy(*keys).agg(
        F.count_if(F.col("_at") == 0).alias("_rows"),
        F.sum("_weight").alias("_total"),
        *[F.sum(e).alias(f"_{i}") for i, e in enumerate(entries)],
    )

    def once(column: str) -> Column:
        return _modulo(F.expr(f"{column} div _rows"))

    lanes = F.array(*[once(f"_{i}") for i in range(LANES)])
    return summed.select(*keys, F.struct(once("_total").alias("total"), lanes.alias("lanes")).alias("fingerprint"))


def _modulo(x: Column) -> Column:
    return x.bitwiseAND(MODULUS - 1).cast("int")


def _combined(left: Column, right: Column, sign: int) -> Column:
    def one(x: Column, y: Column) -> Column:
        return _modulo(x.cast("bigint") + y.cast("bigint") * sign)

    lanes = F.zip_with(left["lanes"], right["lanes"], one)
    return F.struct(one(left["total"], right["total"]).alias("total"), lanes.alias("lanes"))


def added(left: Column, right: Column) -> Column:
    """The fingerprint of the paragraphs of both."""
    return _combined(left, right, 1)


def removed(left: Column, right: Column) -> Column:
    """The fingerprint of ``left`` without the paragraphs of ``right``, which must be among its own."""
    return _combined(left, right, -1)


def _dot(left: Column, right: Column) -> Column:
    """The inner product of two fingerprints, entries taken from their mean."""

    def centred(lane: Column, total: Column) -> Column:
        return lane.cast("double") * 2 - total.cast("double") * ENTRY

    products = F.zip_with(left["lanes"], right["lanes"], lambda x, y: centred(x, left["total"]) * centred(y, right["total"]))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def likeness(left: Column, right: Column) -> Column:
    """0 to 1: the share of their paragraphs that two texts have in common, weighted by length, estimated.

    1 for equal fingerprints. The standard error is about 1 / sqrt(``LANES``), 0.09. A paragraph that one text repeats
    counts with the square of its number.
    """
    both = _dot(left, left) + _dot(right, right)
    found = F.try_divide(2 * _dot(left, right), both)
    return F.when(left == right, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(found, F.lit(0.0)))))


def as_hex(fingerprint: Column) -> Column:
    """The total and the lanes, eight lowercase hexadecimal digits each."""
    digits = F.transform(F.concat(F.array(fingerprint["total"]), fingerprint["lanes"]), lambda x: F.lpad(F.hex(x), 8, "0"))
    return F.lower(F.array_join(digits, ""))


def edited_halves(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_chars``, ``edited_sha256``, ``found``, ``edited``, ``next``) of every document; three fingerprints.

    ``edited`` is that of the text with its last floor(n_chars / 2) code points replaced by as many first ones of the
    next document by id (after the last the first), ``next`` that of the next document. Null ids come first, equal ids
    by the SHA-256 of their texts; a null text is empty. Repeated rows (same id and text) are one document and one row.
    Other columns are not read. An empty table gives no rows.

    The order is found on (id, digest) alone. Texts are exchanged once, and of the next text only the part that is
    used moves a second time, to rows that stay where they are.
    """
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`"), F.lit(0).cast(kind)).alias("id"),  # a value that joins, and a flag
        F.col(f"`{id_col}`").isNotNull().alias("known"),
        F.sha2(text, 256).alias("key"),
        text.alias("text"),
    )
    own = ["known", "id", "key"]
    names = rows.groupBy(*own).agg(F.max(F.length("text")).alias("n"))
    ranked = ranking.running_totals(names, [F.col(c).asc() for c in own])
    before = ranked.select(
        F.pmod(F.col("_before") + 1, "_total").alias("_before"),
        *[F.col(c).alias(f"{c}_b") for c in own],
        F.floor(F.col("n") / 2).cast("int").alias("asked"),
    )
    asked = keep(ranked.select("_before", *own).join(before, "_before").drop("_before"), "neighbours")
    back = [F.col(f"{c}_b").alias(c) for c in own]
    texts = rows.groupBy(*own).agg(F.any_value("text").alias("text"))
    # Made from the placed texts on both sides of the exchange: less work than to move fingerprints once more.
    found = fingerprints(texts, own).withColumnRenamed("fingerprint", "found")
    after = texts.join(asked, own).join(found, own)
    after = after.select(*back, F.substring("text", F.lit(1), F.col("asked")).alias("head"), F.col("found").alias("next"))
    half = F.floor(F.length("text") / 2)
    changed = texts.join(after, own).select(
        *own,
        F.length("text").cast("bigint").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), (F.length("text") - half).cast("int")), "head").alias("edited"),
        "next",
    )
    named = changed.select(*own, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "next", "edited")
    edited = fingerprints(named, [*own, "n_chars", "edited_sha256", "next"], "edited").withColumnRenamed("fingerprint", "edited")
    return edited.join(found, own).select(
        F.when(F.col("known"), F.col("id")).alias(id_col), "n_chars", "edited_sha256", "found", "edited", "next"
    )

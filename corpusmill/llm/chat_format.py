"""Chat formatting with Spark expressions only: sorted turn structs, merged adjacent turns, one text per chat.

The template of a chat is, block after block, ``<|im_start|>`` role, line feed, the texts of the block with
``<|im_next|>`` between them, ``<|im_end|>``, line feed. A block holds adjacent turns of the same role. In roles and
texts ``<|`` is written ``<|lt|>|``, and in roles a line feed is written ``<|n|>``. So every ``<|`` in a formatted text
begins a mark or an escape, no text can hold a mark, and the escapes can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END, LINE = "<|im_start|>", "<|im_next|>", "<|im_end|>\n", "<|n|>"


def escape(text: Column) -> Column:
    """A text in which no mark of the template can stand."""
    return F.replace(text, F.lit("<|"), F.lit("<|lt|>|"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<|lt|>"), F.lit("<"))


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def format_chats(
    turns: DataFrame,
    chat: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """One row per chat: (chat, ``n_turns``, ``formatted``, ``pieces``).

    ``pieces`` is the loss mask: the formatted text cut into (text, loss) pieces in order, where loss marks the texts
    of ``trained_role``. Their texts joined are ``formatted``.

    Turns are ordered by turn number (null first), equal numbers by role and text; repeated rows stay. Null roles and
    texts count as empty. A null chat id is a chat of its own. Other columns are not read. A chat is one value, so
    its turns are gathered in one row, with Spark's limit of 2 GB for it.
    """
    rows = turns.select(
        F.col(chat).alias(chat),
        F.col(turn).alias("_t"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_r"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_x"),
    )
    chats = rows.groupBy(chat).agg(F.sort_array(F.collect_list(F.struct("_t", "_r", "_x"))).alias("_turns"))
    # A block starts where the role changes; a turn of the same role is added after a mark.
    near = F.transform(
        "_turns",
        lambda x, i: F.struct(
            x["_r"].alias("r"),
            x["_x"].alias("x"),
            ((i == 0) | (F.get("_turns", i - 1)["_r"] != x["_r"])).alias("first"),
            F.coalesce(F.get("_turns", i + 1)["_r"] != x["_r"], F.lit(True)).alias("last"),
        ),
    )
    pieces = F.flatten(
        F.transform(
            "_near",
            lambda x: F.array(
                F.struct(
                    F.when(x["first"], F.concat(F.lit(START), _role(x["r"]), F.lit("\n")))
                    .otherwise(F.lit(NEXT))
                    .alias("text"),
                    F.lit(False).alias("loss"),
                ),
                F.struct(escape(x["x"]).alias("text"), (x["r"] == trained_role).alias("loss")),
                F.struct(F.when(x["last"], F.lit(END)).otherwise(F.lit("")).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return (
        chats.withColumn("_near", near)
        .select(chat, F.size("_turns").cast("bigint").alias("n_turns"), pieces.alias("pieces"))
        .withColumn("formatted", F.array_join(F.col("pieces")["text"], ""))
        .select(chat, "n_turns", "formatted", "pieces")
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted chat, in order: the inverse of ``format_chats``."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")
    cut = F.transform(
        blocks,
        lambda b: F.struct(
            unescape(
                F.replace(F.substring_index(F.substr(b, F.lit(len(START) + 1)), "\n", 1), F.lit(LINE), F.lit("\n"))
            ).alias("role"),
            F.split(F.substr(b, F.locate("\n", b) + 1), r"<\|im_next\|>").alias("texts"),
        ),
    )
    return F.flatten(
        F.transform(
            cut,
            lambda b: F.transform(b["texts"], lambda x: F.struct(b["role"].alias("role"), unescape(x).alias("text"))),
        )
    )


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, escapes undone."""
    return unescape(F.array_join(F.filter(pieces, lambda p: p["loss"])["text"], ""))

"""Turn chats, pairs and raw text into one training-text schema, and take such text apart again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as tx

# Prefixes and roles of the two chat layouts; other roles are dropped.
TRAINING_ROLES = {"system": "System: ", "human": "### Instruction:\n", "gpt": "### Response:\n"}
DIALOGUE_ROLES = {"user": "User: ", "assistant": "Assistant: "}
INSTRUCTION_MARK = "### Instruction:"
RESPONSE_MARK = "### Response:"


def segment(role: Column, content: Column, prefixes: Mapping[str, str]) -> Column:
    """The formatted turn, NULL for a role without a prefix."""
    made = F.lit(None).cast("string")
    for name, prefix in prefixes.items():
        body = F.concat(F.lit(prefix), F.coalesce(content, F.lit("")), F.lit("\n\n"))
        made = F.when(role == name, body).otherwise(made)
    return made


def chat_array_text(turns: Column, prefixes: Mapping[str, str], role: str, content: str) -> Column:
    """Text of a chat held as an array of turns: no shuffle."""
    parts = F.transform(turns, lambda t: segment(t[role], t[content], prefixes))
    return tx.strip(F.array_join(parts, ""))


def chat_parts(
    turns: DataFrame,
    prefixes: Mapping[str, str],
    chat: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
    turns_per_part: int = 4096,
) -> DataFrame:
    """Chat text from one row per turn, as ordered parts of at most ``turns_per_part`` turns.

    The part number is part of the grouping key, so that even a chat with a large share of all turns
    is put together by many tasks and never collected as one list.
    """
    made = turns.select(
        chat,
        F.floor(F.col(turn) / turns_per_part).alias("part"),
        F.struct(F.col(turn).alias("turn"), segment(F.col(role), F.col(content), prefixes).alias("seg")).alias("s"),
    )
    return made.groupBy(chat, "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["seg"]), "").alias("text"),
        F.count("s.seg").alias("n_turns"),
    )


def chat_text(
    turns: DataFrame,
    prefixes: Mapping[str, str],
    chat: str = "conv_id",
    **names,
) -> DataFrame:
    """One text per chat. A chat of more than one part is joined from its finished parts; a text
    beyond Spark's 2 GB per value has to stay in ``chat_parts``."""
    parts = chat_parts(turns, prefixes, chat, **names)
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), ""
    )
    return parts.groupBy(chat).agg(tx.strip(joined).alias("text"), F.sum("n_turns").alias("n_turns"))


def dialogue_text(turns: DataFrame, chat: str = "conv_id", **names) -> DataFrame:
    """``User:``/``Assistant:`` text; chats without any such turn are rejected."""
    made = chat_text(turns, DIALOGUE_ROLES, chat, **names)
    return made.where(F.col("text") != "").select(
        chat, "text", F.lit("conversation").alias("type"), tx.word_count(F.col("text")).alias("length")
    )


def first_exchange(
    turns: DataFrame,
    chat: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
    asker: str = "user",
    answerer: str = "assistant",
) -> DataFrame:
    """The pair to score: first user and first assistant turn. ``min_by`` keeps one row per group and
    combines before the shuffle."""

    def first_of(name: str) -> Column:
        return F.min_by(F.when(F.col(role) == name, F.col(content)), F.when(F.col(role) == name, F.col(turn)))

    return turns.groupBy(chat).agg(
        first_of(asker).alias("instruction"), first_of(answerer).alias("response")
    )


def exchanges(
    turns: DataFrame,
    chat: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
    asker: str = "user",
    answerer: str = "assistant",
) -> DataFrame:
    """(chat, turn, ``instruction``, ``response``): one pair per user turn and the assistant turn right after it.

    A user turn without an answer has no response, an answer to nothing no instruction (its turn is the one before).
    Turns meet on (chat, turn), so that a chat of any length is spread over all tasks. Of repeated turns the smallest
    text counts; rows without a turn number belong to no exchange.
    """
    spoken = turns.where(F.col(role).isin(asker, answerer) & F.col(turn).isNotNull())
    asked = F.when(F.col(role) == answerer, F.col(turn) - 1).otherwise(F.col(turn))
    return spoken.groupBy(chat, asked.alias(turn)).agg(
        F.min(F.when(F.col(role) == asker, F.col(content))).alias("instruction"),
        F.min(F.when(F.col(role) == answerer, F.col(content))).alias("response"),
    )


def system_text(
    turns: DataFrame, chat: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text"
) -> DataFrame:
    """(chat, ``system``): the system turns of a chat in order, a line each. Chats without any do not appear."""
    in_order = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(content).alias("text"))))
    return (
        turns.where((F.col(role) == "system") & F.col(content).isNotNull())
        .groupBy(chat)
        .agg(F.array_join(F.transform(in_order, lambda t: t["text"]), "\n").alias("system"))
    )


def first_present(*columns: str) -> Column:
    """The first column that is not NULL, else an empty string (an empty string counts as present)."""
    return F.coalesce(*[F.col(c) for c in columns], F.lit(""))


def resolve_pair(df: DataFrame) -> DataFrame:
    """``instruction`` and ``response`` from whichever of the known column names a table has."""
    have = set(df.columns)
    ask = [c for c in ("instruction", "prompt") if c in have]
    answer = [c for c in ("response", "output", "completion") if c in have]
    return df.withColumns({"instruction": first_present(*ask), "response": first_present(*answer)})


def pair_text(
    instruction: Column,
    response: Column,
    system: Column | None = None,
    reject_empty: bool = False,
) -> Column:
    """Training text of a pair: with a system header when given, NULL for empty pairs when rejecting."""
    ask, answer = F.coalesce(instruction, F.lit("")), F.coalesce(response, F.lit(""))
    made = F.concat(F.lit(f"{INSTRUCTION_MARK}\n"), ask, F.lit(f"\n\n{RESPONSE_MARK}\n"), answer)
    if system is not None:
        made = F.when(
            F.coalesce(system, F.lit("")) != "", F.concat(F.lit("System: "), system, F.lit("\n\n"), made)
        ).otherwise(made)
    if reject_empty:
        made = F.when((ask != "") & (answer != ""), made)
    return made


def long_enough_text(text: Column, min_chars: int, max_words: int) -> Column:
    """NULL below ``min_chars``; cut to ``max_words`` words, re-joined with blanks, when longer."""
    parts = tx.words(text)
    # More than n words take more than 2n characters, so shorter texts are not split at all.
    too_long = (F.length(text) > 2 * max_words) & (F.size(parts) > max_words)
    cut = F.when(too_long, F.array_join(F.slice(parts, 1, max_words), " ")).otherwise(text)
    return F.when(F.length(text) >= min_chars, cut)


def educational_text(text: Column) -> Column:
    return long_enough_text(text, 100, 1000)


def web_text(text: Column) -> Column:
    return long_enough_text(text, 200, 800)


def tagged(df: DataFrame, kind: str, source: str | Column, keep: Sequence[str] = ()) -> DataFrame:
    """The mixing schema (text, type, length, source); rows whose formatter gave NULL are dropped."""
    label = F.lit(source) if isinstance(source, str) else source
    return df.where(F.col("text").isNotNull()).select(
        *keep,
        "text",
        F.lit(kind).alias("type"),
        tx.word_count(F.col("text")).alias("length"),
        label.alias("source"),
    )


def prompt_and_reference(df: DataFrame, text: str = "text") -> DataFrame:
    """Split training text at its response marker; rows without both markers are dropped.

    The reference is the first response segment, without what follows a second marker.
    """
    value = F.col(text)
    parts = F.split(value, RESPONSE_MARK)
    return df.where(F.contains(value, F.lit(INSTRUCTION_MARK)) & F.contains(value, F.lit(RESPONSE_MARK))).withColumns(
        {
            "prompt": F.concat(F.element_at(parts, 1), F.lit(f"{RESPONSE_MARK}\n")),
            "reference": tx.strip(F.element_at(parts, 2)),
        }
    )


def without_prompt(response: Column, prompt: Column) -> Column:
    """What an output says after as many characters as its prompt has."""
    return tx.strip(F.substring(response, F.length(prompt) + 1, F.length(response)))


def padded_lengths(n_tokens: Column, max_length: int = 2048, multiple: int = 8) -> tuple[Column, Column]:
    """Truncated token count and that count padded to a multiple."""
    cut = F.least(n_tokens, F.lit(max_length))
    return cut, (F.ceil(cut / multiple) * multiple).cast("int")


def run_labels(df: DataFrame, name: str = "experiment") -> DataFrame:
    """Data size and quality level that a run's name mentions; the first match wins."""
    run = F.col(name)

    def has(piece: str) -> Column:
        return F.contains(run, F.lit(piece))

    return df.withColumns(
        {
            "dataset_size": F.when(has("10k"), 10_000).when(has("100k"), 100_000).when(has("1M"), 1_000_000),
            "quality_level": F.when(has("ultra"), "ultra_high").when(has("high"), "high").when(has("medium"), "medium"),
        }
    )

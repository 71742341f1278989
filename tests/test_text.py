"""Text functions on hand-made rows; Python's own split and strip are the yardstick."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import features as ft
from corpusmill.functions import fixed
from corpusmill.functions import text as tx
from corpusmill.operators import formats

TEXTS = [
    "", " ", "one", "two words", "A no break space.", "tab\tand\x0bmore wide\x1cfile",
    "First one. second! Third?  Fourth", "\n\nLead and trail \n", "é\u0085à ö", "1. item\n2. item", "x" * 30,
]


def frame(spark, rows, schema="id int, t string"):
    return spark.createDataFrame(list(enumerate(rows)), schema)


def values(df):
    return [r[1] for r in df.orderBy("id").collect()]


def test_words_are_pythons(spark):
    df = frame(spark, TEXTS)
    assert values(df.select("id", tx.words(F.col("t")))) == [t.split() for t in TEXTS]
    assert values(df.select("id", tx.strip(F.col("t")))) == [t.strip() for t in TEXTS]


def test_space_class_is_pythons(spark):
    points = [i for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000]
    df = frame(spark, [chr(i) for i in points])
    got = values(df.select("id", F.col("t").rlike(rf"\A{tx.SPACE}\z")))
    assert [p for p, ok in zip(points, got) if ok] == [p for p in points if chr(p).isspace()]
    assert set(fixed.SPACE_CHARS) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_sentences(spark):
    df = frame(spark, ["", "One. two! Three?", "No end", "A.b c.  D", "  lead. x \n"])
    expected = [[], ["One.", "two!", "Three?"], ["No end"], ["A.b c.", "D"], ["lead.", "x"]]
    assert values(df.select("id", tx.sentences(F.col("t")))) == expected
    assert values(df.select("id", tx.sentences(tx.spaced(F.col("t")), plain=True))) == expected
    assert values(df.select("id", tx.capital_sentences(F.col("t")))) == [0, 2, 1, 2, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_ngrams_guard_short_arrays(spark, n):
    rows = ["", "a", "a b", "a b c", "a b c d e"]
    got = values(frame(spark, rows).select("id", tx.ngrams(tx.words(F.col("t")), n)))
    expected = [[" ".join(r.split()[i : i + n]) for i in range(len(r.split()) - n + 1)] for r in rows]
    assert got == expected


def test_syllables_and_readability(spark):
    df = frame(spark, ["The cat sat.", "hmm", ""])
    assert values(df.select("id", tx.syllables(F.col("t")))) == [3, 1, 0]
    ease = ft.flesch_reading_ease(tx.word_count(F.col("t")), F.size(tx.sentences(F.col("t"))), tx.syllables(F.col("t")))
    got = values(df.select("id", ease))
    assert got[0] == pytest.approx(206.835 - 1.015 * 3 - 84.6)
    assert got[2] is None


def test_endings(spark):
    rows = ["Done.", "Done! ", "wait,", "this and", "band", "over the", "open", ""]
    df = frame(spark, rows)
    assert values(df.select("id", ft.ends_properly(F.col("t")))) == [True, True] + [False] * 6
    assert values(df.select("id", ft.ends_open(F.col("t")))) == [False, False, True, True, True, True, False, False]
    assert values(df.select("id", ft.ends_open(F.col("t"), with_the=False)))[5] is False


def test_structure_flags(spark):
    rows = ["1. one\n2. two", "intro\n- point", "• dot", "```x```", "def f", "function go", "plain\n\ntwo"]
    df = frame(spark, rows)
    assert values(df.select("id", ft.has_list(F.col("t")))) == [True, True, False, False, False, False, False]
    assert values(df.select("id", ft.has_list(F.col("t"), bullets=True)))[2] is True
    assert values(df.select("id", ft.has_code(F.col("t")))) == [False] * 3 + [True, True, False, False]
    assert values(df.select("id", ft.has_code_definition(F.col("t")))) == [False] * 3 + [True, True, True, False]
    assert values(df.select("id", ft.has_paragraphs(F.col("t"))))[-1] is True


def test_length_std_of_equal_lengths_is_zero(spark):
    df = spark.createDataFrame([(0, [3, 3, 3]), (1, [1, 3]), (2, [])], "id int, l array<int>")
    rows = df.withColumn("m", ft.length_moments(F.col("l")))
    assert values(rows.select("id", ft.length_std(F.col("m")))) == [0.0, 1.0, 0.0]


def test_text_limits(spark):
    rows = ["x" * 99, "x" * 100, "x" * 199, "x" * 200, "w " * 800, "w " * 801, "w " * 1000, "w " * 1001]
    df = frame(spark, rows)
    education = values(df.select("id", formats.educational_text(F.col("t"))))
    web = values(df.select("id", formats.web_text(F.col("t"))))
    assert [v is None for v in education] == [True] + [False] * 7
    assert [v is None for v in web] == [True] * 3 + [False] * 5
    assert [len(v.split()) for v in web[4:]] == [800] * 4
    assert education[6] == rows[6] and education[7] == " ".join(["w"] * 1000)


def test_bleu_tokens_follow_13a(spark):
    df = frame(spark, ['Hello, world! 3.5% of 1,000-2', "a-\nb &amp; c"])
    assert values(df.select("id", tx.bleu_tokens(F.col("t")))) == [
        ["Hello", ",", "world", "!", "3.5", "%", "of", "1,000", "-", "2"],
        ["ab", "&", "c"],
    ]


def test_chat_texts(spark):
    turns = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi"), (1, 2, "assistant", "Hello"), (1, 3, "tool", "x"),
        (2, 0, "user", "Alone"), (3, 0, "tool", "dropped"),
    ]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    names = {"system": "System: ", "user": "### Instruction:\n", "assistant": "### Response:\n"}
    made = {r.conv_id: r.text for r in formats.chat_text(df, names).collect()}
    assert made[1] == "System: Be kind.\n\n### Instruction:\nHi\n\n### Response:\nHello"
    assert made[3] == ""
    split = {r.conv_id: r.text for r in formats.chat_text(df, names, turns_per_part=2).collect()}
    assert split == made
    dialogue = {r.conv_id: (r.text, r.length) for r in formats.dialogue_text(df).collect()}
    assert dialogue == {1: ("User: Hi\n\nAssistant: Hello", 4), 2: ("User: Alone", 2)}
    pair = {r.conv_id: (r.instruction, r.response) for r in formats.first_exchange(df).collect()}
    assert pair == {1: ("Hi", "Hello"), 2: ("Alone", None), 3: (None, None)}
    system = {r.conv_id: r.system for r in formats.system_text(df).collect()}
    assert system == {1: "Be kind."}
    parsed = formats.prompt_and_reference(formats.chat_text(df, names)).collect()
    assert [(r.prompt[-14:], r.reference) for r in parsed] == [("### Response:\n", "Hello")]


def test_exchanges_use_all_turns(spark):
    turns = [
        (1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (1, 4, "user", "d"),
        (1, 5, "assistant", "e"), (2, 0, "assistant", "f"), (2, 0, "assistant", "f"), (3, 0, "tool", "x"), (3, None, "user", "y"),
        (None, 1, "user", "g"), (None, 2, "assistant", None),
    ]
    turns += [(4, i, ("user", "assistant")[i % 2], str(i)) for i in range(10_000)]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    made = {(r.conv_id, r.turn): (r.instruction, r.response) for r in formats.exchanges(df).collect()}
    long = {k: v for k, v in made.items() if k[0] == 4}
    assert long == {(4, i): (str(i), str(i + 1)) for i in range(0, 10_000, 2)}
    assert {k: v for k, v in made.items() if k[0] != 4} == {
        (1, 1): ("a", "b"), (1, 3): ("c", None), (1, 4): ("d", "e"), (2, -1): (None, "f"), (None, 1): ("g", None),
    }
    assert formats.exchanges(df.limit(0)).count() == 0


def test_random_texts_match_python(spark):
    draw = random.Random(7)
    alphabet = ["a", "B", "é", " ", " ", "\n", " ", ".", "!", ",", "7", "\x1d"]
    rows = ["".join(draw.choices(alphabet, k=draw.randint(0, 60))) for _ in range(300)]
    df = frame(spark, rows)
    assert values(df.select("id", tx.words(F.col("t")))) == [r.split() for r in rows]
    alnum = [[w.lower() for w in r.split() if w.isalnum()] for r in rows]
    assert values(df.select("id", tx.alnum_words(F.lower("t")))) == alnum

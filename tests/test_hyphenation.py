"""Syllables by patterns: the algorithm on given patterns, its error on hand-counted words, columns and options."""

import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import hyphenation as hy
from corpusmill.functions import text as tx
from corpusmill.operators import generation

#: Words that the rules were made with, and others counted after that.
MADE_WITH = """make:1 table:2 water:2 beautiful:3 idea:3 nation:2 education:4 wanted:2 liked:1 boxes:2 makes:1 little:2 people:2
 computer:3 language:2 area:3 science:2 quiet:2 question:2 radio:3 video:3 create:2 reading:2 house:1 because:2 every:3 family:3
 important:3 government:3 information:4 strength:1 through:1 example:3 simply:2 candle:2 horses:2 watch:1 watches:2 played:1 needed:2
 university:5 hospital:3 september:3 alone:2 machine:2 banana:3 elephant:3 orange:2 window:2 happiness:3 carefully:3 musician:3
 serious:3 period:3 piano:3 giant:2 lion:2 actual:3 influence:3 fluid:2 poem:2 being:2 monkey:2 system:2 style:1 sky:1"""
COUNTED_AFTER = """bridge:1 bridges:2 mountain:2 river:2 decided:3 changed:1 changes:2 finished:2 started:2 opened:2 closed:1 smiled:1
 temperature:4 electricity:5 development:4 relationship:4 celebration:4 imagination:5 possible:3 terrible:3 uncle:2 circle:2 muscles:2
 breathe:1 clothes:1 judge:1 village:2 cabbage:2 promise:2 believe:2 receive:2 island:2 knowledge:2 wrestle:2 whistle:2 stories:2 cities:2
 carried:2 studied:2 variety:4 society:4 experience:5 audience:3 patient:2 ancient:2 social:2 official:3 medium:3 genius:3 museum:3 violin:3
 diary:3 science:2 client:2 trial:2 fuel:2 cruel:2 duet:2 quality:3 equal:2 guide:1 league:1 tongue:1 value:2 rescue:2 continue:3
 neighbor:2 daughter:2 enough:2 laughed:1 throughout:2 straight:1 stretch:1 splash:1 shrimp:1 twelve:1 eleven:3 seventy:3 hundred:2"""


def pairs(listed):
    return [(w, int(n)) for w, n in (p.split(":") for p in listed.split())]


def test_published_example():
    listed = ["1na", "2io", "4te.", "hy3ph", "he2n", "hena4", "hen5at", "1tio", "2ion"]
    assert hy.Patterns(listed, left=2, right=2).breaks("hyphenation") == [2, 6]
    assert hy.parsed("hen5at") == ("henat", [0, 0, 0, 5, 0, 0])
    assert hy.parsed(".ach4") == (".ach", [0, 0, 0, 0, 4])
    assert hy.Patterns([]).syllables("anything") == 1


def test_pattern_files():
    lines = ["UTF-8", "LEFTHYPHENMIN 2", "% a comment", ".ach4", "1na % of these", "hy3ph", "", "4te."]
    assert hy.read_patterns(lines) == [".ach4", "1na", "hy3ph", "4te."]


@pytest.mark.parametrize("listed, most", [(MADE_WITH, 0.07), (COUNTED_AFTER, 0.2)])
def test_error_on_counted_words(listed, most):
    patterns, words = hy.Patterns(hy.english_patterns()), pairs(listed)
    wrong = sum(patterns.syllables(w) != n for w, n in words) / len(words)
    vowel_groups = sum(max(1, len(re.findall("[aeiouy]+", w))) != n for w, n in words) / len(words)
    assert wrong <= most and wrong < vowel_groups / 1.5


def test_columns_and_the_output_report(spark):
    patterns = hy.Patterns(hy.english_patterns())
    texts = ["The little house, beautifully painted.", "", None, "1234 !?", "MAKE Table", "é ü"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, generated string")
    found = [r[0] for r in rows.orderBy("id").select(hy.syllables(F.col("generated"), patterns)).collect()]
    assert found == [sum(patterns.syllables(w) for w in re.findall(r"[^\W\d_]+", t.lower())) if t is not None else None for t in texts]
    assert found[1] == 0 and found[3] == 0 and found[4] == 3
    plain, fine = (generation.output_metrics(rows, ["id"], elements=None, patterns=p).orderBy("id").collect() for p in (None, patterns))
    assert plain[4].flesch_reading_ease < fine[4].flesch_reading_ease  # the vowel groups of "make" are two
    assert plain[4].flesch_kincaid_grade > fine[4].flesch_kincaid_grade
    assert [r.length_words for r in plain] == [r.length_words for r in fine]
    assert rows.select(tx.syllables(F.col("generated"))).first()[0] == 11

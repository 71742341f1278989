"""Distinct word n-grams of one text: counted as hashes, and as joined words where a word holds the mark that joins."""

import pytest

from corpusmill.operators import quality

TEXTS = ["", "one", "a b", "a b a b a", "a_b c a b_c x", "x a_b c", "é è é è é", "a  b\n a\tb", " ".join(f"w{i % 7} v{i % 3}" for i in range(200))]


@pytest.mark.parametrize("n, column", [(2, "_distinct_bigrams"), (3, "_distinct_trigrams")])
def test_distinct_grams_by_brute_force(spark, n, column):
    rows = spark.createDataFrame([(i, "", t) for i, t in enumerate(TEXTS)], "id int, instruction string, response string")
    found = {r.id: r[column] for r in quality._prepared(rows, "instruction", "response", None).select("id", column).collect()}
    for i, text in enumerate(TEXTS):
        words = text.split()
        assert found[i] == len({"_".join(words[k : k + n]) for k in range(len(words) - n + 1)})

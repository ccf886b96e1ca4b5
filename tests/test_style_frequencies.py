"""Frequencies inside a row: repeats and character entropy against plain Python, and the shape of the style block's plan."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkprint.functions import runs, text as tx
from inkprint.operators import stylometry

WORDS = [
    [], ["a"], ["a", "a"], ["b", "a", "b", "c", "b"], ["a", "aa", "aaa", "aa"], ["$1", "\\1", "$1", "\\"], ["é", "e", "é", "😀", "😀"],
    ["the"] * 300 + ["then"] * 2,
]
TEXTS = ["", "aab", "één ένα ένα", "1.5 + x² = ①", "\n\t\n", "😀😀 a", "~~^^``{}", "日本語 日本", "İI ΣΑΣ"]


def test_repeats(spark):
    df = spark.createDataFrame(list(enumerate(WORDS)), "i int, w array<string>")
    got = dict(df.select("i", runs.repeats("w")).collect())
    for i, words in enumerate(WORDS):
        assert sorted(got[i]) == sorted(n - 1 for n in Counter(words).values() if n > 1), words


def test_char_entropy_of_any_script(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = dict(df.select("i", runs.char_entropy("t")).collect())
    for i, t in enumerate(TEXTS):
        assert got[i] == pytest.approx(-sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()), abs=1e-9), t


def test_spaced(spark):
    texts = ["", " ", "a  b", "\n a\t b \x1c\n", "a b", " ", "a.\n\nB"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, (spaced, words) in zip(texts, df.select(tx.spaced(F.col("t")), tx.spaced_off(tx.spaced(F.col("t")))).collect()):
        ends = (" " if t[:1].isspace() else "") , (" " if t[-1:].isspace() else "")
        assert spaced == (ends[0] + " ".join(t.split()) + ends[1] if t.split() else ends[0])
        assert words == t.split()


def test_style_block_sorts_words_once_and_has_no_lambda_over_their_places(spark):
    """The block's time grows with its words: it may look at a word's place in the sorted words in no lambda (F17, F19, F22, F25 to F27)."""
    df = spark.createDataFrame([(1, "Some text. More text!")], "doc_id bigint, text string")
    plan = stylometry.style_features(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan

"""N-grams and TF-IDF against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from inkprint.functions.lexicons import STOP_WORDS
from inkprint.operators import ngrams
from inkprint.operators.ngrams import NgramVocabulary, top_ngrams
from inkprint.operators.tfidf import TfidfModel, top_terms

TEXTS = [
    "the cat sat on the mat", "aaa aaaa", "The cat. The CAT!", "", "x", "a\nb a\nb", "emoji 😀😀😀 end", "the the the the cat",
    "aba ababa", "cost $5.00 (five) cost $5.00 (five)",
]


def chars(text, n):
    return list(map("".join, shifted([c for c in text.lower() if c != " "], n)))


def words(text, n):
    return list(map(" ".join, shifted(text.lower().split(), n)))


def shifted(sequence, n):
    """The sequence beside itself, moved by 0 to n - 1 places."""
    return zip(*(sequence[shift:] for shift in range(n)))


MAKE = {"char": chars, "word": words}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")


@pytest.mark.parametrize("share", [0.0, 0.4, 1.0])
@pytest.mark.parametrize("kinds", [("char",), ("word",), ("char", "word")])
def test_top_ngrams(docs, kinds, share):
    """Whatever share of the texts names the candidates: none of them, some, or all."""
    got = {(r["kind"], r["n"], r["rank"]): (r["gram"], r["total"]) for r in top_ngrams(docs, kinds, k=8, share=share).collect()}
    want = {}
    for kind in kinds:
        for n in (2, 3):
            totals = Counter(g for t in TEXTS for g in MAKE[kind](t, n))
            best = sorted(totals.items(), key=lambda x: (-x[1], x[0].encode()))[:8]
            want.update({(kind, n, i + 1): b for i, b in enumerate(best)})
    assert got == want


def test_a_frequent_ngram_that_no_hint_names_is_found(spark, monkeypatch):
    """Hints come from other n-grams and four buckets hold everything else, so buckets must be opened."""
    rows = [(i, "zz top") for i in range(60)] + [(100 + i, "w%d x%d" % (i, i % 7)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    hints = {0: ["w1 x1", "w2 x2", "never seen"]}
    monkeypatch.setattr(ngrams, "_hints", lambda *_: (hints, {0: 4}))
    got = [(r["gram"], r["total"]) for r in top_ngrams(docs, ("word",), (2,), k=3).collect()]
    assert sorted(got) == [("w0 x0", 1), ("w1 x1", 1), ("zz top", 60)]


def test_few_buckets_cross_the_shuffle(spark):
    """Of 3,000 n-grams, only hinted ones and one row per bucket and task are shuffled; settled buckets are never opened."""
    rows = [(i, "a b " * 50 + "u%d v%d" % (i, i)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    grams = ngrams._grouped_grams(docs, [("word", 2)], "text")
    totals = ngrams.bucketed_totals(grams, {0: ["a b", "b a"]}, {0: 64}).collect()
    assert len(totals) == 66 and sum(r["total"] for r in totals) == 1500 * 101
    assert all(r["total"] < 1500 * 49 for r in totals if r["gram"] is None)


def test_counts_include_overlaps(docs, spark, tmp_path):
    vocabulary = NgramVocabulary.fit(docs, k=12)
    vocabulary.save(spark, str(tmp_path / "v"))
    assert NgramVocabulary.load(spark, str(tmp_path / "v")) == vocabulary
    grams = {(k, g) for k, _, g in vocabulary.grams}
    assert ("char", "aba") in grams or ("char", "aa") in grams
    for r in vocabulary.transform_long(docs).collect():
        assert r["count"] == MAKE[r["kind"]](TEXTS[r["doc_id"]], r["n"]).count(r["gram"]), r


def test_vocabulary_applies_to_new_texts(docs, spark):
    vocabulary = NgramVocabulary.fit(docs.filter("doc_id < 5"))
    other = spark.createDataFrame([(9, "nothing alike"), (10, None)], "doc_id bigint, text string")
    wide = vocabulary.transform(other)
    assert wide.columns == ["doc_id", "text", *vocabulary.column_names()]


def test_tfidf(docs, spark, tmp_path):
    def tokens(t):
        return [w for w in re.findall(r"\w{2,}", t.lower()) if w not in STOP_WORDS]

    totals = Counter(w for t in TEXTS for w in tokens(t))
    frequency = Counter(w for t in TEXTS for w in set(tokens(t)))
    best = sorted(totals, key=lambda w: (-totals[w], w))[:6]
    got = {r["term"]: (r["total"], r["doc_freq"]) for r in top_terms(docs, 6).collect()}
    assert got == {w: (totals[w], frequency[w]) for w in best}
    model = TfidfModel.fit(docs, 6)
    model.save(spark, str(tmp_path / "m"))
    assert TfidfModel.load(spark, str(tmp_path / "m")) == model
    assert list(model.terms) == sorted(best)
    weights = {(r["doc_id"], r["term"]): r["tfidf"] for r in model.transform_long(docs).collect()}
    want = {}
    for i, t in enumerate(TEXTS):
        raw = {w: c * (math.log((1 + len(TEXTS)) / (1 + frequency[w])) + 1) for w, c in Counter(tokens(t)).items() if w in best}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        want.update({(i, w): v / norm for w, v in raw.items()})
    assert weights == pytest.approx(want)


def test_only_open_kinds_and_sizes_are_read_again(spark, monkeypatch):
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choices("abcdef", [32, 16, 8, 4, 2, 1], k=6)) for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    passes, plain = [], ngrams._grouped_grams
    monkeypatch.setattr(ngrams, "_grouped_grams", lambda df, groups, text, only=None: passes.append(only) or plain(df, groups, text, only))
    got = {(r["kind"], r["n"], r["rank"]): (r["gram"], r["total"]) for r in ngrams.top_ngrams(df, share=1.0).collect()}
    assert passes[:2] == [None, None] and passes[2:] and 0 not in passes[2] and 3 in passes[2]
    for kind, n in (("char", 2), ("char", 3), ("word", 2), ("word", 3)):
        parts = [list(t.replace(" ", "")) if kind == "char" else t.split() for t in texts]
        counts = Counter(("" if kind == "char" else " ").join(p[i:i + n]) for p in parts for i in range(len(p) - n + 1))
        want = sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:5]
        assert [got[kind, n, r + 1] for r in range(5)] == want


def test_character_ngrams_are_counted_before_they_become_rows(spark, monkeypatch):
    """Empty and short texts, no text, letters beyond 16 bits, several chunks, and a size that does not fit a number."""
    texts = ["abab" * 500, "", "a", "ab", None, "Ä𝒳ß 𝒳ßẞ", "ca\nb", "𝒳", "\x00\x01\x00", "abc " * 300] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    groups = [("char", 1), ("char", 2), ("char", 3), ("char", 4)]
    monkeypatch.setattr(ngrams, "CHUNK", 1500)
    found = ngrams._grouped_grams(docs, groups, "text").collect()
    got = Counter()
    for r in found:
        got[r["g"], r["gram"]] += r["n"]
    want = Counter()
    for t in texts:
        s = (t or "").lower().replace(" ", "")
        want.update((n - 1, s[i:i + n]) for n in (1, 2, 3, 4) for i in range(len(s) - n + 1))
    assert got == want
    assert sum(r["g"] < 3 for r in found) < sum(v for (g, _), v in want.items() if g < 3) / 20

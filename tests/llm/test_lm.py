"""Scores against plain counting, the total of one, and the gain over single words."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.llm import lm


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def check_base(rows, found):
    train = [t for d, t in rows if not is_held_out(d)]
    counts = Counter(w for t in train for w in lm.tokens_of((t or "").encode()))
    total, types = sum(counts.values()) + len(train), len(counts) + bool(train)
    wanted = []
    for d, t in rows:
        words = lm.tokens_of((t or "").encode())
        base = sum(math.log10(counts[w] + 1) for w in words) + math.log10(len(train) + 1) - (len(words) + 1) * math.log10(total + types + 1)
        wanted.append((d is None, d or 0, len(words) + 1, sum(w in counts for w in words) + bool(train), total, base))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found)
    for a, b in zip(got, sorted(wanted)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
    assert len(got) == len(wanted)


@pytest.mark.parametrize("looked_up", [40, lm.LOOKED_UP])
def test_base_scores_match_plain_counting(odd_docs, documents, looked_up, monkeypatch):
    monkeypatch.setattr(lm.fit_vocabulary, "__defaults__", (looked_up,))
    docs = odd_docs.select("doc_id", "text", F.lit(1).alias("rare")).union(documents.select("doc_id", "text", F.lit(2)))
    found = lm.score_documents(docs).collect()
    check_base([(r["doc_id"], r["text"]) for r in docs.collect()], found)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in found)


def test_model_beats_single_words_on_held_out_text(spark):
    """Over the next larger test table; the smallest has too few rows to learn from."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = lm.score_documents(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]


def test_empty_and_untrained(spark):
    schema = "doc_id bigint, text string"
    assert lm.score_documents(spark.createDataFrame([], schema)).count() == 0
    held = next(d for d in range(100) if is_held_out(d))
    row = lm.score_documents(spark.createDataFrame([(held, "some words")], schema)).collect()
    check_base([(held, "some words")], row)


@pytest.mark.parametrize("least", [3, 50])
def test_probabilities_of_all_words_add_up_to_one(spark, documents, least, monkeypatch):
    """Over both levels, with words that have vectors inside their classes and with none or few."""
    monkeypatch.setattr(lm, "LEAST_COUNT", least)
    monkeypatch.setattr(lm, "WORDS", 200)
    train = documents.where(~lm.held_out())
    counts = lm.word_counts(train)
    vocabulary = lm.fit_vocabulary(counts, train.count())
    assert least == 50 or vocabulary.inner > 500
    rng = np.random.default_rng(1)
    lookup = lm.Lookup(vocabulary)
    model = lm.Model.start(vocabulary.symbol_counts, vocabulary.inner)
    model.inner[:] = rng.normal(0, 1, model.inner.shape)
    words, n = [bytes(r["word"]) for r in counts.collect()], {bytes(r["word"]): r["n"] for r in counts.collect()}
    places, symbols = lookup.symbols(words)
    first, second = model.tables()
    for a, b in ((lookup.begin, lookup.begin), (lookup.begin, 3), (5, 210), (0, 0)):
        pair = np.array([a]), np.array([b])
        level = np.exp(first[a] + second[b] + model.bias - model.log_normalisers(*pair))
        total = float(level[lookup.end])
        in_class = symbols > lm.WORDS
        total += float(level[symbols[~in_class]].sum())
        classes = symbols[in_class] - lm.WORDS - 1
        inner = model.inner_logs(np.repeat(pair[0], len(classes)), np.repeat(pair[1], len(classes)), classes, places[in_class], lookup)
        share = (np.array([n[w] for w, i in zip(words, in_class) if i]) + 1) / lookup.class_mass[classes]
        total += float((level[symbols[in_class]] * share * np.exp(inner)).sum())
        # The word that no class has seen.
        every = np.arange(vocabulary.classes)
        unseen = model.inner_logs(np.repeat(pair[0], len(every)), np.repeat(pair[1], len(every)), every, np.full(len(every), -1), lookup)
        total += float((level[lm.WORDS + 1 + every] / lookup.class_mass * np.exp(unseen)).sum())
        assert total == pytest.approx(1, abs=1e-3)


def test_words_with_vectors_follow_the_corpus(spark, documents):
    sizes = []
    for part in (documents.limit(40), documents):
        counts = lm.word_counts(part)
        vocabulary = lm.fit_vocabulary(counts, part.count())
        sizes.append(vocabulary.inner)
        assert vocabulary.inner == max(0, counts.where(f"n >= {lm.LEAST_COUNT}").count() - lm.WORDS)
        assert vocabulary.classes == max(lm.CLASSES, math.isqrt(vocabulary.inner))
    assert sizes[0] <= sizes[1]


def test_inner_vectors_learn_which_word_of_a_class_follows(spark, monkeypatch):
    """Two words of one class, as frequent as one another, each after its own word: only a vector can tell them apart."""
    monkeypatch.setattr(lm, "WORDS", 2)
    texts = ["left xing " * 20, "right ying " * 20] * 60
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(2)
    vocabulary = lm.fit_vocabulary(lm.word_counts(docs), docs.count())
    assert vocabulary.inner == 2 and lm.class_of(b"xing") == lm.class_of(b"ying")
    lookup, rng = lm.Lookup(vocabulary), np.random.default_rng(0)
    model = lm.Model.start(vocabulary.symbol_counts, vocabulary.inner)
    found = [lookup.symbols(t.encode().split()) for t in texts]
    w1, w2, w = lookup.contexts([s for _, s in found])
    for _ in range(20):
        model.train(w1, w2, w, lookup.targets([p for p, _ in found]), lookup, lm._noise(vocabulary), rng)
    model = lm.Model.unpack(model.pack(), vocabulary.size)
    places, symbols = lookup.symbols([b"left", b"right", b"xing", b"ying"])
    after = {}
    for context in (0, 1):
        for word in (2, 3):
            logs = model.inner_logs(symbols[[3 - context]], symbols[[context]], symbols[[word]] - lm.WORDS - 1, places[[word]], lookup)
            after[context, word] = float(logs[0])
    assert after[0, 2] > after[0, 3] + 0.5 and after[1, 3] > after[1, 2] + 0.5

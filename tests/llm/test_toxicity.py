"""Toxicity: gradients and pooling against plain loops, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np

from inkprint.llm import toxicity
from inkprint.llm.queries import op12_toxicity

INSULTS = {"en": ["slurrow", "slurren", "slurral"], "de": ["drekkung", "drekkend"]}


def corpus(n, seed=1):
    rng = random.Random(seed)
    plain = {"en": ["the", "of", "and", "house", "river", "with"], "de": ["der", "und", "nicht", "haus", "fluss", "mit"]}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        text = rng.choices(plain[lang], k=rng.randint(5, 60)) + ["x%d" % rng.randrange(10**6)]
        toxic = rng.random() < 0.25
        for _ in range(2 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(INSULTS[lang]))
        rows.append((i, " ".join(text).capitalize() + ".", lang, int(toxic)))
    return rows


def test_held_out_texts_with_unseen_forms(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[3], 1) for r in rows] + [(5, None, 0), (None, 1, 0)], "doc_id bigint, toxic int, quality int")
    model = toxicity.train(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    assert {k for k, r in found.items() if r["held_out"]} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())
    held = [r for r in rows if found[r[0]]["held_out"]]
    assert sum(found[r[0]]["predicted"] == r[3] for r in held) >= 0.97 * len(held)
    # A form of a known stem that no training text holds, and the same words without it.
    assert model.predict(b"the house of slurrment and slurrish river") > 0.5 > model.predict(b"the house of and river")
    again = toxicity.train(docs.repartition(3), labels)
    assert again.predict(b"the slurrow of") == model.predict(b"the slurrow of") and again.net.thresholds == model.net.thresholds


def test_held_out_labels_are_not_learned(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string")
    labels = [(r[0], r[3]) for r in rows]
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    schema = "doc_id bigint, toxic int"
    a, b = (toxicity.train(docs, spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert np.array_equal(a.net.rows, b.net.rows) and a.net.thresholds == b.net.thresholds


def test_odd_rows_and_missing_labels(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(odd_docs, none)
    found = toxicity.score_documents(odd_docs, model).collect()
    assert len(found) == odd_docs.count() and {r["predicted"] for r in found} == {0}
    one = spark.createDataFrame([(i, 1) for i in range(12)], "doc_id bigint, toxic int")
    assert {r["predicted"] for r in toxicity.score_documents(odd_docs, toxicity.train(odd_docs, one)).collect()} == {1}
    two = spark.createDataFrame([(i, i % 2) for i in range(12)] * 2, "doc_id bigint, toxic int")
    assert len(toxicity.score_documents(odd_docs, toxicity.train(odd_docs, two)).collect()) == len(found)
    assert toxicity.score_documents(odd_docs.where("false"), model).count() == 0
    toxicity.train(odd_docs.where("false"), none)


def test_blocks_pool_like_the_whole_text(monkeypatch):
    net = toxicity.ConvNet.start(3)
    text = " ".join("w%d" % (i * i % 97) for i in range(500)).encode()
    whole = net.pooled(net.embed(text))
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.allclose(net.pooled(net.embed(text)), whole, atol=1e-6)
    x = np.concatenate([net.embed(text), np.zeros((2, toxicity.DIMENSIONS), np.float32)])
    for k, w in enumerate(toxicity.WIDTHS):
        plain = [max(0, max(sum(x[i + j] @ net.kernels[k][j][:, f] for j in range(w)) for i in range(500))) for f in range(toxicity.FILTERS)]
        assert np.allclose(whole[k * toxicity.FILTERS:(k + 1) * toxicity.FILTERS], plain, atol=1e-5)


def test_training_lowers_the_loss_along_the_gradient():
    texts = [toxicity.text_rows(t) for t in [b"bad word here", b"good words here", b"", b"bad again"] * 10]
    labels = np.array([1.0, 0, 0, 1] * 10)
    net = toxicity.ConvNet.start(1).fit(texts, labels, np.ones(40))
    logits = np.array([net.logit(net.rows[t].sum(1)) for t in texts])
    assert (logits[labels == 1] > 0).all() and (logits[labels == 0] < 0).all()


def test_best_threshold_lies_in_the_widest_good_gap():
    cut = toxicity.best_threshold(np.array([-3.0, -2, 1, 4, 5]), np.array([0.0, 0, 0, 1, 1]), np.ones(5))
    assert cut == 2.5
    assert toxicity.calibrate(np.zeros(3), np.array([0.0, 1, 1]), np.ones(3), ["en", "en", "de"]).keys() == {""}


def test_query_over_the_table(spark):
    found = op12_toxicity(spark, "/root/testdata/sf0.1").collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(found) == 10_000
    held = [r for r in found if r["held_out"]]
    clean, toxic = ([r["predicted"] for r in held if labels.get(r["doc_id"]) == label] for label in (0, 1))
    assert sum(clean) <= 0.01 * len(clean) and sum(toxic) >= 0.9 * len(toxic)


def test_texts_of_any_length_are_learned(spark):
    rows = [(i, "slurrow " * 9000 + "x%d" % i if i % 4 == 0 else "the house of river %d" % i) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' AS lang").repartition(4)
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id bigint, toxic int"))
    assert model.predict(b"slurrow slurrow slurrow slurrow") > 0.5 > model.predict(b"the house of river")


def test_every_shard_counts_and_no_split_of_the_table_does(spark, monkeypatch):
    rows = corpus(900)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id bigint, toxic int")
    monkeypatch.setattr(toxicity, "START_TEXTS", 100)
    monkeypatch.setattr(toxicity, "SHARD_TEXTS", 60)
    monkeypatch.setattr(toxicity, "FAN_IN", 3)
    model = toxicity.train(docs, labels)
    again = toxicity.train(docs.union(docs.where("doc_id % 3 = 0")).repartition(5), labels)
    assert np.array_equal(model.net.rows, again.net.rows) and model.net.thresholds == again.net.thresholds
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    scores = model.predict_all([r[1].encode() for r in held])
    assert sum((s >= 0.5) == r[3] for s, r in zip(scores, held)) >= 0.95 * len(held)
    assert np.allclose(scores, [model.predict(r[1].encode()) for r in held], atol=1e-6)


def test_a_word_picks_the_same_rows_wherever_it_stands(monkeypatch):
    words = ["a", "Stem", "stemmed", "stems", "x" * 8, "x" * 9, "y" * 64, "y" * 65, "z" * 300, "\u6f22\u5b57"]
    alone = {w: toxicity.text_rows(w.encode()).tolist() for w in words}
    assert all(len(rows) == 1 and len(rows[0]) == toxicity.PICKS for rows in alone.values())
    assert alone["Stem"][0][1] == alone["stemmed"][0][1] == alone["stems"][0][1] and alone["stemmed"][0][2] != alone["stems"][0][2]
    assert len({rows[0][0] for rows in alone.values()}) == len(words)
    text = "... ".join(random.Random(1).choices(words, k=300)) + "!"
    for hashed in (toxicity.HASHED, 50):
        monkeypatch.setattr(toxicity, "HASHED", hashed)
        assert toxicity.text_rows(text.encode()).tolist() == [alone[w.rstrip("!")][0] for w in text.split("... ")]
    assert toxicity.text_rows(None).shape == (0, toxicity.PICKS)

"""Language identification: held-out accuracy and odd rows."""

import zlib

from inkprint.llm import language


def test_held_out_accuracy(documents):
    model = language.fit_language_model(documents, rows=40)
    found = {r["doc_id"]: r for r in language.predict_languages(documents, model).collect()}
    rows = documents.collect()
    assert len(found) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {r["doc_id"] for r in held} == {k for k, r in found.items() if r["held_out"]}
    assert sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_odd_rows_and_no_labels(odd_docs, documents):
    model = language.fit_language_model(odd_docs)
    found = language.predict_languages(odd_docs, model).collect()
    assert len(found) == odd_docs.count()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in found:
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, texts[r["doc_id"]] or "")))
    none = language.fit_language_model(odd_docs.where("false"))
    assert {r["lang_pred"] for r in language.predict_languages(odd_docs, none).collect()} == {"und"}
    assert language.predict_languages(odd_docs.where("false"), model).count() == 0
    assert language.filter_language(odd_docs).columns == odd_docs.columns


def test_levels_of_the_hierarchy():
    model = language.LanguageModel.fit([b"the of and", b"der die und", b"les des une", b"que los una"] * 3, ["en", "de", "fr", "es"] * 3)
    assert model.family_pairs == [("germanic", "romance")] and model.pairs == [("de", "en"), ("es", "fr")]
    assert model.predict("der und die".encode())[0] == "de" and model.predict(b"12 !")[0] == "und"
    one = language.LanguageModel.fit([b"abc"], ["xx"])
    assert one.predict(b"word") == ("xx", 1.0)


def test_copies_do_not_empty_the_sample(spark):
    rows = [(i, "der und die das nicht", "de") for i in range(4000)] + [(5000 + i, "les des une pas %s" % ("x" * i), "fr") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    model = language.fit_language_model(docs, rows=8)
    assert model.langs == ["de", "fr"] and model.predict(b"der und die")[0] == "de"


def test_whole_texts_are_learned(spark):
    header = "0 " * 3000
    rows = [(i, header + t + " %d" % i, lang) for i in range(40) for t, lang in [("der und die das nicht", "de"), ("les des une pas que", "fr")]]
    docs = spark.createDataFrame([(i, header + "a " * 5 + r[1][len(header):], r[2]) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string")
    model = language.fit_language_model(docs)
    assert model.predict(b"der und die das")[0] == "de" and model.predict(b"les des une pas")[0] == "fr"


def plain_prediction(model, text):
    """Features and votes in plain Python loops."""
    import math
    import re
    from collections import Counter

    folded = "".join(chr(c | 32) if chr(c).isascii() and chr(c).isalpha() else chr(c) if c >= 128 else " " for c in text)
    code = (" " + re.sub(" +", " ", folded) + " ").encode("latin-1")
    counts = Counter()
    for n in range(4):
        for i in range(len(code) - n):
            gram = code[i:i + n + 1]
            if n or gram != b" ":
                counts[(int.from_bytes(gram, "big") * 2654435761 + n * 40503) % 2**32 >> 32 - language.BITS] += 1
    norm = math.sqrt(sum(counts.values()))
    margins = [sum(w[i] * math.sqrt(n) / norm for i, n in counts.items()) + w[-1] for w in model.weights.astype(float)]

    def vote(names, pairs, margins):
        votes = {name: 0.0 for name in names}
        for (a, b), m in zip(pairs, margins):
            votes[a] += 1 / (1 + math.exp(-3 * m))
            votes[b] += 1 - 1 / (1 + math.exp(-3 * m))
        best = max(names, key=lambda n: votes[n])
        return best, votes[best] / max(1, len(names) - 1) if len(names) > 1 else 1.0

    n = len(model.family_pairs)
    family, p = vote(sorted({language.family_of(v) for v in model.langs}), model.family_pairs, margins[:n])
    own = [(pair, m) for pair, m in zip(model.pairs, margins[n:]) if language.family_of(pair[0]) == family]
    best, q = vote([v for v in model.langs if language.family_of(v) == family], [x for x, _ in own], [m for _, m in own])
    return best, p * q


def test_votes_match_plain_loops(documents):
    rows = [(r["text"].encode(), r["lang"]) for r in documents.limit(80).collect()]
    more = [(t + b" gij ook niet", "nl") if lang == "de" else (t + b" perche non", "it") for t, lang in rows[:30]]
    model = language.LanguageModel.fit([t for t, _ in rows + more], [lang for _, lang in rows + more])
    assert len(model.pairs) >= 4
    for text in [t for t, _ in rows[40:60]] + [b"a", b"The  End.", "été, ñandú!".encode(), b" x1y2 "]:
        lang, score = model.predict(text)
        want = plain_prediction(model, text)
        assert lang == want[0] and abs(score - want[1]) < 1e-4


def test_counts_of_all_rows(documents, spark):
    model = language.fit_language_counts(documents)
    again = language.fit_language_counts(documents.repartition(5))
    assert model.langs == again.langs and (model.weights == again.weights).all()
    rows = documents.limit(300).collect()
    assert sum(model.predict(r["text"].encode())[0] == r["lang"] for r in rows) >= 0.95 * len(rows)
    # One row among many counts.
    docs = spark.createDataFrame([("aa", "abab"), ("bb", "zuzu")] * 600 + [("aa", "qwqw")], "lang string, text string")
    assert language.fit_language_counts(docs).predict(b"qwqw")[0] == "aa"
    assert language.fit_language_counts(docs.where("false")).predict(b"abab") == ("und", 0.0)

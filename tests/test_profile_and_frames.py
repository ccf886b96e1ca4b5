import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.operators import frames, labels, profile, scaling, vectors


@pytest.fixture(scope="module")
def features(spark):
    rows = [(i, "ab"[i % 2], 7, i % 2, i, float(i % 5), None if i < 3 else 2.0) for i in range(40)]
    return spark.createDataFrame(
        rows, "doc_id bigint, label string, same int, leak int, unique_id bigint, value double, holes double"
    )


COLUMNS = ["same", "leak", "unique_id", "value", "holes"]


def names(df):
    return sorted(r["feature"] for r in df.collect())


def test_suspicious_columns(features):
    assert names(profile.constant_features(features, COLUMNS)) == ["holes", "same"]
    assert names(profile.class_constant_features(features, COLUMNS, "label")) == ["leak"]
    assert names(profile.id_like_features(features, COLUMNS)) == ["unique_id"]
    assert names(profile.id_like_features(features, ["same"])) == []


def test_histograms(spark):
    counts = {"a": [1, 5, 9, 9, 31], "b": [4, 4], "c": [0, 100]}
    rows = [(k, "w " * n) for k, v in counts.items() for n in v]
    df = spark.createDataFrame(rows, "label string, text string")
    got = {}
    for r in profile.length_histogram(df, "label", 30).collect():
        got.setdefault(r["label"], {})[r["bin"]] = r["n"]
    for label, values in counts.items():
        assert [got[label][i] for i in range(30)] == np.histogram(values, bins=30)[0].tolist(), label
    lengths = spark.createDataFrame([(k, float(n)) for k, v in counts.items() for n in v], "label string, x double")
    density = profile.feature_density(lengths, "x", "label", 20)
    assert density.agg(F.sum("density")).first()[0] * (100 / 20) == pytest.approx(1.0)


def test_frames(spark):
    df = spark.createDataFrame(
        [(1, None, float("nan"), 2.0, "x"), (2, 3, 1.5, float("inf"), "y")], "doc_id bigint, a int, b double, c double, s string"
    )
    assert [tuple(r) for r in frames.fill_missing(df).collect()] == [(1, 0, 0.0, 2.0, "x"), (2, 3, 1.5, float("inf"), "y")]
    assert {r["feature"]: (r["n_nan"], r["n_inf"]) for r in frames.non_finite_counts(df, ["a", "b", "c"]).collect()} == {
        "a": (0, 0), "b": (1, 0), "c": (0, 1)
    }
    with pytest.raises(ValueError, match="not finite"):
        frames.assert_finite(df, ["b"])
    assert frames.align_features(df, ["c", "new", "a"], ["doc_id"]).columns == ["doc_id", "c", "new", "a"]
    assert frames.numeric_columns(df) == ["doc_id", "a", "b", "c"]
    with pytest.raises(ValueError, match="text"):
        frames.text_and_label(df)
    wide = spark.createDataFrame([(1, 2, 3.0, 4.0)], "doc_id int, word_count int, sent_emb_0 double, fw_the double")
    assert frames.feature_set(wide, "stylometric", ["doc_id"]).columns == ["doc_id", "word_count"]
    assert frames.feature_set(wide, "embeddings", ["doc_id"]).columns == ["doc_id", "sent_emb_0"]
    assert frames.feature_set(wide, "all").columns == wide.columns


def test_upsert(spark):
    table = spark.createDataFrame([("Net_FS50", 0.5), ("Forest", 0.9)], "model string, mean_accuracy double")
    new = spark.createDataFrame([("Net_FS100", 0.6)], "model string, mean_accuracy double")
    assert sorted(r[0] for r in frames.upsert_by_prefix(table, "Net_FS", new).collect()) == ["Forest", "Net_FS100"]


def test_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "label string")
    encoder = labels.LabelEncoder.fit(df, "label")
    encoded = encoder.encode(df, "label", "i")
    assert sorted((r["label"], r["i"]) for r in encoded.collect()) == [("a", 0), ("a", 0), ("b", 1), ("c", 2)]
    assert all(r["label"] == r["back"] for r in labels.decode_predictions(encoded, "i", "back", truth="label").collect())
    out_of_range = encoded.withColumn("i", F.col("i") + 5)
    got = labels.decode_predictions(out_of_range, "i", "back", truth="label").select("back").collect()
    assert sorted(r[0] for r in got) == ["5", "5", "6", "7"]
    both = df.withColumn("author", F.lit("z"))
    assert [r["label"] for r in labels.label_column(both).distinct().collect()] == ["z"]
    with pytest.raises(ValueError):
        labels.label_column(df.withColumnRenamed("label", "other"))


def test_scaling_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)) * [1, 5, 0, 2] + [0, 3, 9, 100]
    y = np.arange(60) % 3
    x[:, 0] += y
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, label int, a double, b double, c double, d double").repartition(5)
    columns = ["a", "b", "c", "d"]
    scaled = scaling.StandardScale.fit(df, columns).transform(df).orderBy("doc_id").select(columns).collect()
    std = x.std(axis=0)
    np.testing.assert_allclose(np.array(scaled), (x - x.mean(axis=0)) / np.where(std == 0, 1, std), atol=1e-9)
    scores = {r["feature"]: r["f_score"] for r in scaling.anova_f_scores(df, columns, "label").collect()}
    for j, c in enumerate(columns):
        groups = [x[y == g, j] for g in range(3)]
        between = sum(len(g) * (g.mean() - x[:, j].mean()) ** 2 for g in groups) / 2
        within = sum(((g - g.mean()) ** 2).sum() for g in groups) / 57
        assert scores[c] is None if c == "c" else scores[c] == pytest.approx(between / within)
    best = sorted(scores, key=lambda c: -(scores[c] or 0))[:2]
    assert set(scaling.select_k_best(df, columns, "label", 2).columns) == set(best)


def test_pca_is_centred(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 5)) @ rng.normal(size=(5, 5)) + 50
    df = scaling.assemble(spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double, e double"), list("abcde"))
    out = np.array([r["pca"].toArray() for r in scaling.fit_pca(df, 3).transform(df).collect()])
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    np.testing.assert_allclose(np.abs(out), np.abs((x - x.mean(axis=0)) @ vt[:3].T), atol=1e-8)


def test_pooling(spark):
    rng = np.random.default_rng(5)
    rows = [(d, p, int(p % 3 != 0), [float(v) for v in rng.normal(size=3)]) for d in range(2) for p in range(6)]
    rows.append((7, 0, 0, [1.0, 2.0, 3.0]))
    df = spark.createDataFrame(rows, "doc int, pos int, mask int, vec array<double>")
    first = {r["doc"]: r["vec"] for r in vectors.pool_first(df).collect()}
    last = {r["doc"]: r["vec"] for r in vectors.pool_last(df).collect()}
    mean = {r["doc"]: r["vec"] for r in vectors.pool_mean(df, 3).collect()}
    for d in range(2):
        mine = [r for r in rows if r[0] == d]
        assert first[d] == mine[0][3] and last[d] == mine[-1][3]
        assert mean[d] == pytest.approx(np.mean([r[3] for r in mine if r[2]], axis=0).tolist())
    assert mean[7] == [0.0, 0.0, 0.0]


def test_embeddings_use_the_whole_text(spark):
    df = spark.createDataFrame([(1, "abc " * 5000), (2, "abc " * 5000 + "xyz"), (3, ""), (4, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["embedding"] for r in vectors.embed_documents(df, vectors.hashed_trigram_encoder(16)).collect()}
    assert got[1] != got[2] and len(got[1]) == 16 and got[3] == got[4] == [0.0] * 16


def test_combine(spark):
    left = spark.createDataFrame([(1, 2.0), (2, 3.0)], "doc_id bigint, a double")
    emb = spark.createDataFrame([(2, [0.5, 1.5])], "doc_id bigint, embedding array<float>")
    out = vectors.combine_features([left], {"m": emb})
    assert out.columns == ["doc_id", "a", "m_emb_0", "m_emb_1"] and [tuple(r) for r in out.collect()] == [(2, 3.0, 0.5, 1.5)]

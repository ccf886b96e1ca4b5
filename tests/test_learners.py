from threading import Barrier

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from inkprint.operators import learners as ml
from inkprint.operators.attribution import AttributionModel, Embedding
from inkprint.operators.labels import LabelEncoder
from inkprint.operators.sampling import stratified_folds
from inkprint.operators.scaling import BestByF
from inkprint.operators.vectors import hashed_trigram_encoder
from inkprint.sources.corpus import build_dataset
from inkprint.sources.sinks import misclassification_summary, union_misclassified

LOGISTIC = ml.logistic_regression(max_iter=20)
FOREST = ml.random_forest(trees=5, max_depth=5)
BOOSTED = ml.boosted_trees(rounds=2, max_depth=2)


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(150):
        y = i % 3
        x = rng.normal(size=4)
        x[y] += 4
        rows.append((i, float(y), Vectors.dense(x.tolist())))
    df = spark.createDataFrame(rows, ["doc_id", "label", "features"])
    path = str(tmp_path_factory.mktemp("data") / "t")
    stratified_folds(df, "label", 3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(
    "learner",
    [LOGISTIC, FOREST, ml.neural_network(hidden=(6,), max_iter=60), BOOSTED, ml.voting([LOGISTIC, BOOSTED]),
     ml.stacking([LOGISTIC, FOREST], folds=2, max_iter=20)],
    ids=lambda l: l.name,
)
def test_learner_fits_saves_and_loads(spark, data, tmp_path, learner):
    fitted = ml.fit(learner, data)
    out = fitted.transform(data)
    assert out.columns == [*data.columns, "probability", "prediction"]
    assert ml.score(fitted, data) > 0.85
    rows = out.select("doc_id", "probability", "prediction").orderBy("doc_id").collect()
    for r in rows:
        p = r["probability"].toArray()
        assert len(p) == 3 and p.sum() == pytest.approx(1.0) and p[int(r["prediction"])] == p.max()
    fitted.save(spark, str(tmp_path / "m"))
    again = ml.Fitted.load(spark, str(tmp_path / "m")).transform(data).orderBy("doc_id").collect()
    assert [r["prediction"] for r in again] == [r["prediction"] for r in rows]


def test_voting_is_the_mean_of_its_members(data):
    vote = ml.fit(ml.voting([LOGISTIC, FOREST]), data)
    whole = vote.transform(data).orderBy("doc_id").collect()
    parts = [m.transform(data).orderBy("doc_id").collect() for m in vote.members]
    for r, a, b in zip(whole, *parts):
        np.testing.assert_allclose(r["probability"].toArray(), (a["probability"].toArray() + b["probability"].toArray()) / 2)


def test_comparison_reports_failures(data):
    broken = ml.Learner("Broken", "nothing")
    rows = {r["model"]: r for r in ml.compare_models([LOGISTIC, broken], data, 3).collect()}
    assert rows["Broken"]["status"].startswith("failed") and rows["Broken"]["mean_accuracy"] is None
    scores = rows["LogisticRegression"]["fold_scores"]
    assert len(scores) == 3 and rows["LogisticRegression"]["mean_accuracy"] == pytest.approx(np.mean(scores))
    assert rows["LogisticRegression"]["std_accuracy"] == pytest.approx(np.std(scores))


def test_searches_and_best_network(data):
    grid = {"hidden": [(4,)], "max_iter": [10, 30], "step": [0.03]}
    found = ml.kbest_grid_search(data, grid, 3, k_list=(2, 50))
    assert found.count() == 4
    best = ml.best_network(found)
    assert best.name in ("NeuralNetwork_FS2", "NeuralNetwork_FS50") and best.reduce[0] == "selectkbest"
    assert ml.score(ml.fit(best, data), data) > 0.5


def test_zoo_saves_models_and_wrong_rows(spark, data, tmp_path):
    wide = data.withColumn("style", F.col("features")).withColumn("embedding", F.col("features")).withColumn("text", F.lit("a, \"text\"\nof two lines"))
    table = ml.train_model_zoo(
        [FOREST, ml.Learner("Broken", "nothing")], wide, wide, ml.feature_set_variants(2), str(tmp_path / "m"), str(tmp_path / "w")
    )
    rows = {(r["model"], r["feature_set"]): r for r in table.collect()}
    assert len(rows) == 10 and rows["Broken", "pca"]["accuracy"] is None
    saved = ml.Fitted.load(spark, str(tmp_path / "m" / "RandomForest_kbest"))
    wrong = union_misclassified(spark, str(tmp_path / "w" / "RandomForest_kbest_misclassified.csv")).count()
    assert ml.score(saved, wide) == pytest.approx(rows["RandomForest", "kbest"]["accuracy"])
    assert wrong == round(150 * (1 - rows["RandomForest", "kbest"]["accuracy"]))


def test_wrong_rows_of_the_zoo_reach_the_summary(spark, data, tmp_path):
    labels = LabelEncoder.fit(spark.createDataFrame([("ann",), ("bob",), ("cy",)], "name string"), "name")
    blind = data.withColumn("style", array_to_vector(F.array(F.lit(0.0)))).withColumn("text", F.concat(F.lit("text, no. "), "doc_id"))
    zoo = ml.train_model_zoo([FOREST], blind, blind, {"blind": ("style", None)}, wrong_dir=str(tmp_path), labels=labels).first()
    summary = misclassification_summary(union_misclassified(spark, str(tmp_path / "*_misclassified.csv"))).collect()
    assert len(summary) == round(150 * (1 - zoo["accuracy"])) > 0
    assert {r["model"] for r in summary} == {"RandomForest_blind"} and summary[0]["text_snippet"].startswith("text, no. ")
    assert {r["true_label"] for r in summary} | {r["predicted_label"] for r in summary} == {"ann", "bob", "cy"}
    assert [r["label"] for r in zoo["report"]] == ["ann", "bob", "cy"] and sum(r["support"] for r in zoo["report"]) == 150


def test_selection_ranks_by_f_where_p_values_are_all_zero(spark):
    rows = [(float(i % 2), Vectors.dense([(i % 2) * 2.0 + (i * 7919 % 1000) / 1000, (i % 2) * 40.0 + (i * 104729 % 1000) / 1000, 1.0, float(i % 2)])) for i in range(20_000)]
    frame = spark.createDataFrame(rows, ["label", "features"])
    for k, wanted in ((1, [3]), (2, [1, 3]), (3, [0, 1, 3])):
        assert BestByF(k, "features", "out", "label").fit(frame).getIndices() == wanted


def test_failures_keep_what_was_said(data):
    status = ml.compare_models([ml.Learner("Broken", "nothing")], data, 3).first()["status"]
    assert status == "failed: ValueError: unknown recipe 'nothing'"


def test_stacking_members_do_not_see_their_rows(data, monkeypatch):
    """A member trained on a fold's rest never meets a row of that fold."""
    seen = []
    real = ml.fit

    def spy(learner, train, *rest):
        if learner.name == "LogisticRegression" and "_stack_fold" in train.columns:
            seen.append({r[0] for r in train.select("_stack_fold").distinct().collect()})
        return real(learner, train, *rest)

    monkeypatch.setattr(ml, "fit", spy)
    real(ml.stacking([LOGISTIC], folds=3, max_iter=5), data)
    assert seen == [{1, 2}, {0, 2}, {0, 1}, {0, 1, 2}]


def test_attribution_round_trip(spark, tmp_path):
    rows = [(i, "Short. Words! Here! " * (1 + i % 3) if i % 2 else "a rather long winding sentence, without end " * (1 + i % 4), "xy"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label string")
    model = AttributionModel.train(df, FOREST)
    model.save(spark, str(tmp_path / "m"))
    loaded = AttributionModel.load(spark, str(tmp_path / "m"))
    assert loaded.names == model.names and len(model.names) == 43 + len(model.vocabulary.grams)
    scored = loaded.score(df.select("doc_id", "text")).join(df, "doc_id")
    assert scored.filter("predicted_label = label").count() == 60
    plan = loaded.score(df.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_author_files_to_saved_stacked_model_with_embeddings(spark, tmp_path):
    """Files of two authors, style, n-grams and components, stacking on string keys, saved, loaded, scored from both kinds of vectors."""
    for author, word in (("ann", "alpha beta, gamma"), ("bob", "delta. epsilon! zeta")):
        folder = tmp_path / "corpus" / author
        folder.mkdir(parents=True)
        for i in range(12):
            (folder / f"{i}.txt").write_text(" ".join([word] * (3 + i % 4)) + f" {i}.")
    docs = build_dataset(spark, str(tmp_path / "corpus"))
    assert {r["doc_id"] for r in docs.collect()} == {f"{a}/{i}.txt" for a in ("ann", "bob") for i in range(12)}
    embedding = Embedding(hashed_trigram_encoder(16), n=5)
    model = AttributionModel.train(docs, ml.stacking([LOGISTIC, FOREST], folds=2, max_iter=10), embedding=embedding)
    model.save(spark, str(tmp_path / "model"))
    loaded = AttributionModel.load(spark, str(tmp_path / "model"))
    scored = {r["doc_id"]: r for r in loaded.score(docs, keep=["label"], embedding=embedding).collect()}
    assert len(scored) == 24 and all(r["label"] == r["predicted_label"] for r in scored.values())
    vectors = embedding.add(docs, "doc_id", "text").select("doc_id", "embedding")
    from_table = loaded.score(docs, embedding=Embedding(table=vectors)).collect()
    assert {r["doc_id"]: r["predicted_label"] for r in from_table} == {k: r["predicted_label"] for k, r in scored.items()}
    with pytest.raises(ValueError):
        loaded.score(docs)


def test_a_search_goes_on_where_it_was(data, spark, tmp_path, monkeypatch):
    """The first run has half of the grid and leaves one fold out; the second fits what is missing, the third nothing."""
    fits = []
    real = ml.MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(ml.MultilayerPerceptronClassifier, "fit", lambda self, df: fits.append(self.getLayers()) or real(self, df))
    grid = {"hidden": [(3,), (4, 2)], "max_iter": [5], "step": [0.1]}
    path = str(tmp_path / "results")
    ml.grid_search(data, {**grid, "hidden": [(3,)]}, 2, results=path)
    assert len(fits) == 2
    whole = ml.grid_search(data, grid, 3, results=path).collect()
    assert len(fits) == 6 and sorted(map(tuple, {tuple(r["hidden"]) for r in whole})) == [(3,), (4, 2)]
    assert ml.grid_search(data, grid, 3, results=path).collect() == whole and len(fits) == 6
    selected = ml.grid_search(data, grid, 3, results=path, reduce=("selectkbest", 2))
    assert selected.count() == 2 and len(fits) == 12 and fits[-1][0] == 2
    fresh = ml.grid_search(data, grid, 3)
    assert fresh.collect() == whole


def test_scaling_and_selection_see_only_the_training_rows_of_a_fold(data):
    train, test, width = ml.prepared_fold(data, "fold", 1, None)
    assert train.count() == data.filter("fold != 1").count() and test.count() == data.filter("fold = 1").count()
    x = vector_to_array("x")
    means = train.select([F.avg(F.get(x, F.lit(i))).alias(f"m{i}") for i in range(width)]).first()
    assert all(abs(m) < 1e-9 for m in means)
    assert any(abs(m) > 1e-6 for m in test.select([F.avg(F.get(x, F.lit(i))).alias(f"m{i}") for i in range(width)]).first())


def test_boosted_rounds_are_checkpointed(data, spark):
    fitted = ml.fit(ml.boosted_trees(rounds=6, max_depth=2, checkpoint=2), data)
    assert spark.sparkContext.getCheckpointDir() is not None
    models = [m for m in fitted.pipeline.stages if hasattr(m, "trees")]
    assert len(models) == ml.class_count(data) and all(len(m.trees) == 6 for m in models)


def test_forest_keeps_node_ids_and_grows_the_same_trees(spark):
    from pyspark.ml.classification import RandomForestClassifier

    rng = np.random.default_rng(3)
    rows = [(float(i % 3), Vectors.dense(rng.normal(i % 3, 2, size=6).tolist())) for i in range(600)]
    table = spark.createDataFrame(rows, ["label", "features"]).repartition(3).cache()
    grown = ml.fit(ml.random_forest(trees=6, max_depth=9, checkpoint=2), table).pipeline.stages[-1]
    plain = RandomForestClassifier(featuresCol="features", numTrees=6, maxDepth=9, seed=42).fit(table)
    assert grown.getOrDefault("cacheNodeIds") and not plain.getOrDefault("cacheNodeIds")
    assert spark.sparkContext.getCheckpointDir() is not None
    body = [[t.toDebugString.split("\n")[1:] for t in m.trees] for m in (grown, plain)]
    assert body[0] == body[1] and grown.totalNumNodes > 50


def test_the_zoo_fits_side_by_side_and_keeps_its_order(data, monkeypatch):
    """Two fits wait for each other, which they cannot one after the other; rows stay in the order of sets and learners."""
    both = Barrier(2, timeout=60)

    def fit(learner, *_):
        both.wait()
        raise ValueError(learner.name)

    monkeypatch.setattr(ml, "fit", fit)
    learners = [ml.Learner("One", "nothing"), ml.Learner("Two", "nothing")]
    zoo = ml.train_model_zoo(learners, data, data, {"a": ("features", None), "b": ("features", ("pca", 2))}, parallelism=2).collect()
    assert [(r["model"], r["feature_set"], r["status"]) for r in zoo] == [
        (name, at, f"failed: ValueError: {name}") for at in "ab" for name in ("One", "Two")
    ]

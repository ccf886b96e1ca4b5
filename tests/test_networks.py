"""Networks that learn side by side: Spark's own weights, one job a round, nothing left out."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors

from inkprint.operators import learners as ml
from inkprint.operators import networks as nw


def _table(spark, n, width, seed=1, column="x"):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(n, width)), rng.integers(0, 3, n)
    x[np.arange(n), y] += 1.5
    rows = [(i, i % 3, float(b), Vectors.dense(a.tolist())) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["doc_id", "fold", "label", column])


@pytest.mark.parametrize("hidden", [(5,), (6, 4)])
def test_weights_are_those_of_sparks_own_fit(spark, hidden):
    """Ten whole blocks of 128 rows, where the mean over blocks is the mean over rows; two networks of different lengths at once."""
    df = _table(spark, 1280, 7).coalesce(1).cache()
    layers = [7, *hidden, 3]

    def own(turns):
        return MultilayerPerceptronClassifier(featuresCol="x", solver="gd", seed=42, layers=layers, maxIter=turns, stepSize=0.3).fit(df)

    start = own(0).weights.toArray()
    networks = [nw.Network(0, tuple(layers), start, turns, 0.3) for turns in (9, 20)]
    assert list(nw.descend(nw.blocks(df, 0, 3).repartition(3), networks)) == [[0], [1]]
    for network in networks:
        model = own(network.max_iter)
        assert np.abs(network.weights - model.weights.toArray()).max() < 1e-12
        scored = ml.score(ml.Fitted("pipeline", ml.PipelineModel(stages=[model]), [], 3), df)
        assert nw.accuracies(nw.blocks(df, 0), [network]) == [pytest.approx(scored)]


def test_a_search_starts_a_job_a_round_for_all_its_fits(spark):
    df = _table(spark, 120, 5, column="features").cache()
    grid = {"hidden": [(3,), (4,)], "max_iter": [60], "step": [0.1]}
    spark.sparkContext.setJobGroup("a search", "")
    try:
        assert ml.kbest_grid_search(df, grid, 3, k_list=(2, 3)).count() == 4
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("a search"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 60 <= jobs < 12 * 60


def test_fits_beyond_the_limit_of_weights_learn_in_parts(spark, monkeypatch):
    df = _table(spark, 90, 4, column="features").cache()
    grid = {"hidden": [(3,), (2, 2)], "max_iter": [4, 8], "step": [0.1]}

    def found():
        return {(*r["hidden"], r["max_iter"]): pytest.approx(r["mean_accuracy"]) for r in ml.grid_search(df, grid, 3).collect()}

    whole = found()
    monkeypatch.setattr(ml, "SIDE_BY_SIDE", 60)
    assert len(whole) == 4 and {k: v.expected for k, v in found().items()} == whole


def test_rows_that_no_network_can_learn_from_are_refused(spark):
    for label, value in ((None, 1.0), (3.0, 1.0), (0.5, 1.0), (1.0, math.nan)):
        rows = spark.createDataFrame([(0.0, Vectors.dense([1.0])), (label, Vectors.dense([value]))], ["label", "x"])
        with pytest.raises(Exception, match="labels of 0 to 2"):
            nw.blocks(rows, 0, 3).collect()


def test_rows_without_a_label_do_not_count(spark):
    rows = [(0.0, Vectors.dense([1.0])), (1.0, Vectors.dense([1.0])), (None, Vectors.dense([1.0]))]
    packed = nw.blocks(spark.createDataFrame(rows, ["label", "x"]), 2)
    first = np.array([0.0, 0.0, 1.0, 0.0])
    assert nw.accuracies(packed, [nw.Network(2, (1, 2), first, 1, 0.1), nw.Network(1, (1, 2), first, 1, 0.1)]) == [0.5, 0.0]


@pytest.mark.parametrize("whole_bytes", [0, nw.WHOLE_BYTES])
def test_networks_of_one_way_are_learned_once(spark, monkeypatch, whole_bytes):
    """Three lengths of one network and one of another step, in rounds over all tasks and whole in a task: the weights of fits alone."""
    df = _table(spark, 100, 4)
    rng = np.random.default_rng(5)
    start = rng.normal(size=4 * 3 + 3 + 3 * 3 + 3)

    def networks():
        return [nw.Network(0, (4, 3, 3), start, turns, step) for turns, step in ((7, 0.2), (2, 0.2), (0, 0.2), (4, 0.2), (4, 0.5))]

    alone = networks()
    for network in alone:
        list(nw.descend(nw.blocks(df, 0, 3), [network]))
    together, learned = networks(), []
    real = nw._gradients
    monkeypatch.setattr(nw, "_gradients", lambda rows, found: learned.append(len(found)) or real(rows, found))
    monkeypatch.setattr(nw, "WHOLE_BYTES", whole_bytes)
    assert list(nw.descend(nw.blocks(df, 0, 3).repartition(3), together)) == [[2], [1], [3, 4], [0]]
    assert learned == ([] if whole_bytes else [2, 2, 2, 2, 1, 1, 1])
    for a, b in zip(alone, together):
        assert np.abs(a.weights - b.weights).max() < 1e-12
    assert not np.allclose(together[0].weights, together[3].weights)


def test_networks_of_one_way_stay_in_one_part(monkeypatch):
    found = [nw.Network(at, (2, 2), np.zeros(6), turns, 0.1) for turns in (5, 9) for at in range(3)]
    monkeypatch.setattr(ml, "SIDE_BY_SIDE", 12)
    assert [sorted(part) for part in ml._parts(found)] == [[0, 1, 3, 4], [2, 5]]

"""Metrics against hand-made definitions, with a class never predicted and one never true."""

import pytest

from inkprint.operators import evaluation as ev
from inkprint.operators import profile

PAIRS = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("c", "a")] * 4 + [("b", "d")]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(PAIRS, "true_label string, predicted_label string")


def brute():
    out = {}
    for label in "abcd":
        tp = sum(t == p == label for t, p in PAIRS)
        predicted, support = sum(p == label for _, p in PAIRS), sum(t == label for t, _ in PAIRS)
        precision, recall = tp / predicted if predicted else 0.0, tp / support if support else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        out[label] = (precision, recall, f1, support)
    return out


def test_report(df):
    rows = {r["label"]: tuple(r)[1:] for r in ev.classification_report(df).collect()}
    want = brute()
    n = len(PAIRS)
    for label, values in want.items():
        assert rows[label] == pytest.approx(values)
    accuracy = sum(t == p for t, p in PAIRS) / n
    assert rows["accuracy"] == pytest.approx((accuracy,) * 3 + (n,))
    assert rows["macro avg"] == pytest.approx(tuple(sum(v[i] for v in want.values()) / 4 for i in range(3)) + (n,))
    weighted = tuple(sum(v[i] * v[3] for v in want.values()) / n for i in range(3))
    assert rows["weighted avg"] == pytest.approx(weighted + (n,))
    assert len(rows) == 7


def test_confusion_keeps_zero_cells(df):
    cells = {(r[0], r[1]): r[2] for r in ev.confusion_matrix(df).collect()}
    assert len(cells) == 16 and sum(cells.values()) == len(PAIRS)
    assert cells["c", "a"] == 4 and cells["d", "d"] == 0


def test_long_metrics_and_errors(df):
    assert ev.per_class_metrics(df).count() == 12
    assert [tuple(r) for r in ev.common_misclassifications(df).collect()] == [("c", "a", 4), ("a", "b", 2), ("b", "d", 1)]
    assert {r[0]: r[1] for r in ev.per_class_accuracy(df).collect()} == pytest.approx({"a": 5 / 7, "b": 0.75, "c": 0.0})
    assert profile.misclassification_patterns(df.filter("true_label <> predicted_label"), 2).count() == 2


def test_empty_predictions(spark):
    empty = spark.createDataFrame([], "true_label string, predicted_label string")
    assert ev.confusion_matrix(empty).count() == 0
    assert {r["support"] for r in ev.classification_report(empty).collect()} <= {None, 0}

"""Top-k search against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.llm import topk


def brute(rows, k=5, every=5):
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in good]
    out = set()
    for q, v in {i: v for i, v in good if i % every == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


def test_all_kinds_of_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.3) * (1 + i % 7) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[10][1]) for i in range(60)]
    rows += [(2000, None), (2005, [0.1, None]), (2010, [float("nan")] * 8), (2015, [float("inf")] * 8), (None, [0.5] * 8)]
    rows += [(3000, [0.0] * 8), (3005, []), (4000, [1.0, 2.0]), (4005, [1.0, -2.0]), (4006, [3.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, dim int").repartition(5)
    found = topk.top_k(frame.drop("dim"), F.col("vec_id") % 5 == 0)
    assert {tuple(r) for r in found.collect()} == brute(rows)
    assert topk.top_k(frame.where("false"), F.col("vec_id") % 5 == 0).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_prunings_lose_nothing(seed):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-200, 200, (300, 6)) * rng.integers(0, 4, (300, 1))
    vectors = vectors[np.argsort(-(vectors ** 2).sum(1), kind="stable")]
    queries, ids, query_ids = rng.integers(-200, 200, (40, 6)), np.arange(300), np.arange(1000, 1040)
    scores = queries @ vectors.T
    for quantile in (0.0, 0.5, 0.9, 0.99, 1.0):
        needs = np.quantile(scores, quantile, axis=1).astype(np.float64)
        found = set(zip(*(x.tolist() for x in topk.search_bucket(query_ids, queries, needs, ids, vectors, 5))))
        wanted = set()
        for q in range(40):
            best = sorted((-s, i) for i, s in enumerate(scores[q].tolist()) if s >= needs[q])[:5]
            wanted |= {(1000 + q, i, -s) for s, i in best}
        assert found == wanted


def test_products_are_exact_beyond_doubles():
    a = np.array([[2 ** 30 + 1, 3]], np.int64)
    assert topk.products(a, a)[0, 0] == (2 ** 30 + 1) ** 2 + 9

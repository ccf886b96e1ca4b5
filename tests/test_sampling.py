"""Splits and folds against ranking everything, on skewed classes and with forced brackets."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkprint.operators import sampling as sp


@pytest.fixture(scope="module")
def rows():
    """One class holds most rows, one has a single row, one row has no label; ids have gaps."""
    out = [(i * i + 3, "big") for i in range(400)]
    out += [(i * 7 + 1_000_000, f"c{i % 3}") for i in range(60)]
    return out + [(5_000_000, "one"), (6_000_000, None)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, label string").repartition(5)


def largest_remainder(counts, total):
    """``total`` dealt one by one: each time to the class that is furthest below its share, the first of equals."""
    whole = [total * c // sum(counts) for c in counts]
    behind = sorted(range(len(counts)), key=lambda i: (whole[i] * sum(counts) - total * counts[i], i))
    return [w + (i in behind[:total - sum(whole)]) for i, w in enumerate(whole)]


def fold_sizes(counts, k):
    """Rows are dealt out to the folds in turn, class after class."""
    dealt = [c for c, n in enumerate(counts) for _ in range(n)]
    return [[sum(1 for at, c in enumerate(dealt) if c == mine and at % k == fold) for fold in range(k)] for mine in range(len(counts))]


def order(i, seed=42):
    return hashlib.md5(f"{i}-{seed}".encode()).hexdigest()


def by_class(rows):
    classes = {}
    for i, label in rows:
        classes.setdefault("\0" if label is None else label, []).append(i)
    return classes


@pytest.mark.parametrize("direct_rows", [10**6, 0, 50])
@pytest.mark.parametrize("fraction", [0.1, 0.2])
def test_stratified_split(df, rows, fraction, direct_rows):
    got = {r["doc_id"]: r["split"] for r in sp.stratified_split(df, "label", fraction, direct_rows=direct_rows).collect()}
    classes = sorted(by_class(rows).items())
    n = len(rows)
    quota = largest_remainder([len(v) for _, v in classes], n - math.ceil(n * fraction))
    want = {}
    for (_, ids), train in zip(classes, quota):
        ranked = sorted(ids, key=order)
        want.update({i: "test" if at < len(ids) - train else "train" for at, i in enumerate(ranked)})
    assert got == want
    assert Counter(got.values())["test"] == math.ceil(n * fraction)


@pytest.mark.parametrize("direct_rows", [10**6, 0])
@pytest.mark.parametrize("seed", [42, None])
@pytest.mark.parametrize("k", [3, 5])
def test_stratified_folds(df, rows, k, seed, direct_rows):
    got = {r["doc_id"]: r["fold"] for r in sp.stratified_folds(df, "label", k, seed=seed, direct_rows=direct_rows).collect()}
    classes = sorted(by_class(rows).items(), key=lambda c: min(c[1]))
    want = {}
    for (_, ids), sizes in zip(classes, fold_sizes([len(v) for _, v in classes], k)):
        ranked = sorted(ids, key=order if seed is not None else None)
        assert sum(sizes) == len(ids) and max(sizes) - min(sizes) <= 1
        start = 0
        for fold, size in enumerate(sizes):
            want.update({i: fold for i in ranked[start : start + size]})
            start += size
    assert got == want
    totals = Counter(got.values())
    assert max(totals.values()) - min(totals.values()) <= 1


def test_random_split(df, rows):
    for direct in (10**6, 0):
        got = {r["doc_id"] for r in sp.random_split(df, 0.2, direct_rows=direct).filter("split = 'test'").collect()}
        n = math.ceil(len(rows) * 0.2)
        assert got == set(sorted((i for i, _ in rows), key=order)[:n])


def test_samples(df, rows):
    assert [r[0] for r in sp.sample_n(df, 7).select("doc_id").collect()] == sorted((i for i, _ in rows), key=order)[:7]
    heads = sp.head_per_class(df, "label").groupBy("label").agg(F.collect_set("doc_id").alias("ids")).collect()
    for r in heads:
        assert set(r["ids"]) == set(sorted(by_class(rows)["\0" if r["label"] is None else r["label"]])[:2])
    picked = sp.sample_per_class(df, "label", 3).collect()
    assert Counter(r["label"] for r in picked) == {"big": 3, "c0": 3, "c1": 3, "c2": 3, "one": 1, None: 1}


def test_equal_keys_are_split_by_id(spark):
    """All rows share one order key: the ties alone decide."""
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("label"))
    got = sp.stratified_folds(df, "label", 4, seed=None, direct_rows=0).groupBy("fold").count().collect()
    assert sorted((r["fold"], r["count"]) for r in got) == [(i, 25) for i in range(4)]


def test_class_rank_is_a_group_limit(df):
    plan = sp.head_per_class(df, "label")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_more_labels_than_a_broadcast_takes(spark, monkeypatch):
    """Thousands of labels, with limits so low that no table of labels may be broadcast; one label holds a third of the rows."""
    monkeypatch.setattr(sp, "BROADCAST_ROWS", 50)
    rows = [(i, "l%d" % (i % 3000)) for i in range(8000)] + [(10_000 + i, "hot") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, label string").repartition(5)
    classes = sorted(by_class(rows).items())
    quota = largest_remainder([len(v) for _, v in classes], 12_000 - 2400)
    for direct_rows in (10**6, 100):
        got = {r["doc_id"]: r["split"] for r in sp.stratified_split(df, "label", 0.2, direct_rows=direct_rows).collect()}
        assert len(got) == 12_000 and Counter(got.values())["test"] == 2400
        for (_, ids), train in zip(classes, quota):
            assert {i for i in ids if got[i] == "test"} == set(sorted(ids, key=order)[:len(ids) - train])
    folds = Counter((r["label"], r["fold"]) for r in sp.stratified_folds(df, "label", 3).collect())
    assert {sum(n for (_, f), n in folds.items() if f == fold) for fold in range(3)} == {4000}
    assert all(max(sizes) - min(sizes) <= 1 for sizes in ([folds[label, f] for f in range(3)] for label, _ in classes))


def test_running_totals_over_ranges(spark):
    df = spark.createDataFrame([(i * 37 % 101, i % 5, i) for i in range(101)], "o bigint, v bigint, id bigint").repartition(7)
    found = {r["o"]: r["total"] for r in sp.running_total(df, ["o"], "v", "total").collect()}
    values = {i * 37 % 101: i % 5 for i in range(101)}
    assert found == {o: sum(values[p] for p in range(o)) for o in range(101)}
    assert sp.running_total(df.where("false"), ["o"], "v", "total").count() == 0


def test_quotas_are_exact_for_large_counts(spark):
    """Remainders one below the total, where a rounded quotient would be one too large, and products beyond a bigint."""
    for counts in ([20_000_001, 9_999_999, 1, 7, 30_000_000_000], [4_999_999_999, 5_000_000_001], [3, 3, 3], [10**12 + 1, 10**12 - 1, 2]):
        total = sum(counts)
        for n_train in (total - 1, total // 3, total - math.ceil(total * 0.2), 0):
            classes = spark.createDataFrame([(f"c{i}", n) for i, n in enumerate(counts)], "_g string, n bigint")
            found = {r["_g"]: r["n"] - r["ends"][0] for r in sp.split_quotas(classes, n_train, total).collect()}
            assert [found[f"c{i}"] for i in range(len(counts))] == largest_remainder(counts, n_train)

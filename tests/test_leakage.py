"""Leak checks with a hot group of copies, on the broadcast and on the salted path."""

import hashlib

import pytest
from pyspark.sql import functions as F

from inkprint import storage
from inkprint.operators import leakage
from inkprint.storage import match_rows, match_skewed, materialize


@pytest.fixture(scope="module")
def df(spark):
    rows = [(i, "copied text" if i % 3 == 0 else f"text {i}", "test" if i % 5 == 0 else "train") for i in range(300)]
    rows += [(1000, "only in test twice", "test"), (1001, "only in test twice", "test"), (1002, "text 1", "test")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, split string").repartition(6)


def brute(df):
    rows = [(r["doc_id"], r["text"], r["split"]) for r in df.collect()]
    train = {t for _, t, s in rows if s == "train"}
    test = [(i, t) for i, t, s in rows if s == "test"]
    return train, test


def test_leaked_and_clean_partition_the_test_rows(df):
    train, test = brute(df)
    leaked = {r["doc_id"] for r in leakage.leaked_rows(df).collect()}
    clean = {r["doc_id"] for r in leakage.clean_rows(df).collect()}
    assert leaked == {i for i, t in test if t in train}
    assert clean == {i for i, t in test if t not in train}


def test_summary_and_examples(df):
    train, test = brute(df)
    row = leakage.overlap_summary(df).first()
    in_test = {t for _, t in test}
    assert tuple(row) == (len(train), len(in_test), len(train & in_test))
    got = leakage.leak_examples(df, 5).collect()
    assert [r["text"] for r in got] == sorted(train & in_test)[:5]
    assert all(r["hash"] == hashlib.md5(r["text"].encode()).hexdigest() for r in got)


@pytest.mark.parametrize("how", ["left_semi", "left_anti", "inner"])
def test_salted_join_equals_plain_join(df, how):
    left = df.withColumn("hash", F.md5("text"))
    right = left.filter("split = 'train'").select("hash").distinct()
    plain = sorted(r["doc_id"] for r in left.join(right, "hash", how).collect())
    salted = sorted(r["doc_id"] for r in match_rows(left, right, "hash", how, "doc_id", max_rows=0).collect())
    assert salted == plain


@pytest.mark.parametrize("share", [2, 10, 1000, 10**9])
@pytest.mark.parametrize("how", ["left_semi", "left_anti", "inner", "left"])
def test_skewed_join_equals_plain_join(df, how, share, monkeypatch):
    """At any limit: with no heavy key, with some, and with all of them."""
    monkeypatch.setattr(storage, "HEAVY_SHARE", share)
    rows = df.withColumn("hash", F.md5("text")).union(df.limit(2).withColumn("hash", F.lit(None).cast("string")))
    left = materialize(rows)
    right = left.filter("split = 'train'").groupBy("hash").agg(F.count("*").alias("copies"))
    plain = sorted(map(str, left.join(right, "hash", how).collect()))
    assert sorted(map(str, match_skewed(left, right, "hash", how).select(left.join(right, "hash", how).columns).collect())) == plain


def test_bloom_filter_lets_all_through_that_it_has_seen(spark):
    seen = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("h"))
    bloom = leakage.BloomFilter.build(seen, "h")
    assert bloom.may_hold(seen, "h").count() == 3000
    others = spark.range(10**6, 10**6 + 4000).select(F.md5(F.col("id").cast("string")).alias("h"), F.lit(1).alias("my col"))
    passed = bloom.may_hold(others, "h")
    assert passed.columns == ["h", "my col"] and passed.count() < 200
    assert leakage.BloomFilter.build(seen.where("false"), "h").may_hold(others, "h").count() == 0


def test_a_full_filter_changes_nothing(df, monkeypatch):
    monkeypatch.setattr(leakage, "MOST_BITS", leakage.BITMAP_BITS)
    monkeypatch.setattr(leakage, "BITS_PER_HASH", 0)
    monkeypatch.setattr(leakage, "BROADCAST_ROWS", 1)
    test_leaked_and_clean_partition_the_test_rows(df)
    test_summary_and_examples(df)


def test_texts_are_read_once(df):
    """What is decided on has no text, and carries only the wanted columns."""
    leaked = leakage.leaked_rows(df, keep=[])
    assert leaked.columns == ["hash", "doc_id", "split"] or set(leaked.columns) == {"hash", "doc_id", "split"}
    assert "text" not in leaked._jdf.queryExecution().executedPlan().toString()

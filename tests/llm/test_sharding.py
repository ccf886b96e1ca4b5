"""The hash tree: movement stays in the subtrees whose weights change; slots are gapless."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from inkprint.llm import sharding
from inkprint.llm.sharding import Leaf


def place(spark, leaves, n=4000):
    keys = spark.range(n).select(F.col("id"), sharding.tree_shard(F.col("id"), leaves).alias("shard"))
    return {r["id"]: r["shard"] for r in keys.collect()}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    before = place(spark, sharding.layout(24))
    for shards in (25, 26, 27):
        after = place(spark, sharding.layout(shards))
        moved = {k for k in before if before[k] != after[k]}
        assert {after[k] for k in moved} == {shards - 1}
        assert 0.4 * 4000 / shards < len(moved) < 2.5 * 4000 / shards
        before = after


def test_a_weight_moves_rows_only_across_its_own_subtree(spark):
    leaves = sharding.layout(24)
    before = place(spark, leaves)
    changed = [Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in leaves]
    region = {x.shard: x.region for x in leaves}
    for k, shard in place(spark, changed).items():
        assert shard == before[k] or region[shard] == region[5]
    gone = [Leaf(x.region, x.rack, x.shard, 0.0 if x.shard == 5 else 1.0) for x in leaves]
    after = place(spark, gone)
    assert 5 not in after.values()
    assert all(after[k] == before[k] or region[before[k]] == region[5] for k in before)


def test_draws_follow_the_weights(spark):
    counts = Counter(place(spark, [Leaf("a", "a", 0, 1.0), Leaf("a", "b", 1, 2.0), Leaf("b", "c", 2, 5.0)], 16000).values())
    assert abs(counts[0] - 2000) < 250 and abs(counts[1] - 4000) < 350 and abs(counts[2] - 10000) < 400
    with pytest.raises(ValueError):
        sharding.tree_shard(F.col("id"), [Leaf("a", "a", 0, 0.0)])


def test_rows_of_all_kinds(odd_docs):
    found = sharding.shard_documents(odd_docs).collect()
    rows = odd_docs.collect()
    assert sorted((r["size"], r["text_crc32"]) for r in found) == sorted(
        (len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in rows)
    slots, shards = defaultdict(list), defaultdict(set)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        shards[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["law"] == "key" and 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())
    assert sharding.shard_documents(odd_docs.where("false")).count() == 0


def test_chunks_do_not_change_the_slots_of_a_rerun(documents):
    rows = documents.select("doc_id", (F.col("doc_id") % 2).alias("g"))
    one = {(r["g"], r["slot"]): r["doc_id"] for r in sharding.number_rows(rows, "g", ["doc_id"], "doc_id", rows_per_task=20).collect()}
    two = {(r["g"], r["slot"]): r["doc_id"] for r in sharding.number_rows(rows.repartition(7), "g", ["doc_id"], "doc_id", rows_per_task=20).collect()}
    assert one == two and len(one) == documents.count()


def test_rows_of_one_id_lie_in_many_chunks(spark, monkeypatch):
    """Most rows have no id, and half of those are equal in every column: slots are gapless, chunks even, reruns agree."""
    monkeypatch.setattr(sharding, "PIECE", 300)
    rows = [(None, "t%d" % i) for i in range(4000)] + [(None, "same")] * 4000 + [(7, "same")] * 2000 + [(i, "x") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = sharding.shard_documents(docs)
    slots = {}
    for r in found.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sum(map(len, slots.values())) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shard_documents(docs.repartition(3))
    assert sorted(map(str, found.collect())) == sorted(map(str, again.collect()))
    narrow = spark.range(40_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.col("id").alias("size"), F.lit(1).alias("shard"))
    numbered = sharding.number_rows(narrow, "shard", ["doc_id", "size"], "doc_id", rows_per_task=1000)
    assert sorted(r["slot"] for r in numbered.collect()) == list(range(40_000))
    chunk = F.pmod(F.xxhash64("doc_id", "doc_id", "size", F.lit("chunk")), F.lit(320))
    assert narrow.groupBy(chunk).count().count() == 320


def plain_shard(key, leaves, seed=0):
    """The tree walked in plain Python: draws of -ln(u) / weight, u from the XXH64 of the key and the child's name."""
    import math
    import struct

    import xxhash

    def draw(name, weight):
        start = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        bits = xxhash.xxh64_intdigest(f"{seed}/{name}".encode(), start) >> 11
        return -math.log((bits + 0.5) / (1 << 53)) / weight

    left = [leaf for leaf in leaves if leaf.weight > 0]
    for part in (lambda x: x.region, lambda x: f"{x.region}/{x.rack}", lambda x: f"{x.region}/{x.rack}/{x.shard}"):
        names = sorted({part(x) for x in left})
        if len(names) > 1:
            best = min(names, key=lambda n: (draw(n, sum(x.weight for x in left if part(x) == n)), n))
            left = [x for x in left if part(x) == best]
    return left[0].shard


def test_shards_match_a_tree_walked_in_plain_python(spark):
    weighted = [Leaf("a", "x", 0, 2.0), Leaf("a", "x", 1, 0.5), Leaf("a", "y", 2, 1.0), Leaf("b", "z", 3, 4.0), Leaf("b", "z", 4, 0.0), Leaf("c", "w", 5, 0.25)]
    for leaves in (sharding.layout(24), sharding.layout(27), weighted):
        keys = [None, 0, -1, 2**62, *range(1, 500, 7)]
        rows = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", sharding.tree_shard(F.col("k"), leaves).alias("s"))
        assert {r["k"]: r["s"] for r in rows.collect()} == {k: plain_shard(k, leaves) for k in keys}

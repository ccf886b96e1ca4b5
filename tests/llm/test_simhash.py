"""SimHash links, components and deduplication against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from inkprint.llm import simhash
from inkprint.llm.base import connected


def plain_fingerprint(text, words=3):
    tokens = (text or "").encode().lower().split()
    shingles = [b" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_and_components_match_brute_force(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "eps", "Zeta", "été", "x"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(150)]
    texts += [None, "", " \t\n", "one two", "One  TWO", texts[5], texts[5].upper(), "word " * 5000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, fingerprint string")
    marks = [plain_fingerprint(t) for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if bin(marks[i] ^ marks[j]).count("1") <= 2]
    wanted = roots(range(len(texts)), edges)
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r["fingerprint"] == signed(marks[r["doc_id"]])
        assert r["component_id"] == wanted[r["doc_id"]]


@pytest.mark.parametrize("crowd", [2, 5, 48])
def test_links_connect_the_same_groups_at_any_crowd_limit(spark, crowd):
    rng = random.Random(2)
    marks = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        base = rng.getrandbits(64)
        marks |= {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(25)}
        marks |= {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(9)}
    marks = sorted(map(signed, marks))
    edges = [(a, b) for a in marks for b in marks if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2]
    points = spark.createDataFrame([(m,) for m in marks], "fingerprint bigint")
    found = [(r["a"], r["b"]) for r in simhash.links(points, crowd=crowd).collect()]
    assert set(found) == set(edges)


def test_connected_on_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 500 + i) for i in range(1, 200)]
    edges = [*chain, *star, *star, (7, 7), (None, 3), (3, None)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in connected(frame).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{500 + i: 500 for i in range(200)}}
    assert connected(frame.where("false")).count() == 0


def test_deduplicate_keeps_the_smallest_row_of_each_component(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "Zeta", "été", "x"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(150)] + [None, "", " \t"]
    rows = [(200 - i, t, "x%d" % i, i) for i, t in enumerate(texts)]
    rows += [rows[5]] * 400 + [(rows[9][0], rows[9][1], "other", 1), (None, "no id at all", None, None), (None, "alpha beta", None, 0)]
    schema = "doc_id bigint, text string, `my col` string, _key bigint"
    docs = spark.createDataFrame(rows, schema).repartition(4)
    marks = [plain_fingerprint(r[1]) for r in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if bin(marks[i] ^ marks[j]).count("1") <= 2]
    groups = {}
    for i, root in roots(range(len(rows)), edges).items():
        groups.setdefault(root, []).append(rows[i])
    wanted = sorted((min(r[0] for r in g if r[0] is not None) if any(r[0] is not None for r in g) else -1) for g in groups.values())
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    found = [tuple(r) for r in kept.collect()]
    assert sorted(-1 if r[0] is None else r[0] for r in found) == wanted and set(found) <= set(rows)
    assert simhash.deduplicate(docs.where("false")).count() == 0
    assert simhash.near_duplicates(docs.where(F.lit(False))).count() == 0


def test_heavy_fingerprints_are_looked_up_like_others(spark, monkeypatch):
    texts = ["same words here"] * 500 + ["", None] * 50 + ["text number %d of some" % i for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    found = {r["doc_id"]: tuple(r) for r in simhash.near_duplicates(docs).collect()}
    monkeypatch.setattr(simhash, "HEAVY", 0)
    assert found == {r["doc_id"]: tuple(r) for r in simhash.near_duplicates(docs).collect()} and len(found) == len(texts)

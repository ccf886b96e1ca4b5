"""Prefix tries against a plain Python trie of the same conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from inkprint.llm import tries
from inkprint.llm.queries import ORACLES, op13_prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, extra string, path string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows, group=100, most=6):
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    lists = {}
    for c in own:
        own[c] = [(role, text) for _, _, role, text in sorted(own[c], key=lambda t: t[:2])]
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        base = int(np.fix(c / group)) * group
        lists[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    return lists


def plain_nodes(lists):
    members = defaultdict(list)
    for c, turns in lists.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    nodes = []
    for node, convs in members.items():
        below = [u for u in members if u[:len(node)] == node]
        leaf = [u for u in below if not any(len(v) == len(u) + 1 and v[:len(u)] == u for v in members)]
        ends = ",".join(map(str, sorted(c for c in convs if lists[c] == node)))
        nodes.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
            sum(len(u) == len(node) + 1 for u in below), len(leaf), sum((len(members[u]) - 1) * len(u[-1][1]) for u in below if u),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(nodes, key=str)


def conversations(seed, n, words=3, longest=7):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 17 != 3:
            rows += [(c * 7 - 40, t, rng.choice(["user", "assistant", None]), rng.choice(["", "a", "été 🎉", None, "b" * words]), "x", "y")
                     for t in range(rng.randint(1, longest))]
    return rows


@pytest.mark.parametrize("shard_turns", [1, 5, 40, 100_000])
def test_nodes_match_a_plain_trie_at_any_shard_size(spark, shard_turns):
    rows = conversations(1, 150) + [(None, 1, "user", "lost", "", "")] + [(3000 + i, t, "user", "hot %d" % t, "", "") for i in range(60) for t in range(4)]
    rows += [(5000, None, "user", "before all", "", ""), (5000, 0, "user", "a", "", ""), (5000, -5, None, None, "", "")]
    rows += [(2000, t, "user", "long %d" % t, "", "") for t in range(300)]
    rows = [(c, t, r, "same" if t == 0 else x, *rest) for c, t, r, x, *rest in rows]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = tries.trie_nodes(tries.with_shared_heads(docs), shard_turns)
    assert found.columns == COLUMNS and {t for _, t in found.dtypes} == {"bigint", "string"}
    assert sorted(map(tuple, found.collect()), key=str) == plain_nodes(rebuilt(rows))


def test_turnless_conversations_and_empty_tables(spark):
    docs = spark.createDataFrame([(101, 0, "user", "gone", "", "")], SCHEMA)
    assert zlib.crc32(b"101") % 6 > 0
    found = tries.trie_nodes(tries.with_shared_heads(docs)).collect()
    assert [tuple(r) for r in found] == [(101, 0, None, 1, 0, 1, 0, hashlib.sha256(b"101").hexdigest())]
    assert tries.trie_nodes(tries.with_shared_heads(docs.where("false"))).count() == 0


def test_ids_of_equal_conversations_are_hashed_in_order_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(tries, "CHUNK", 7)
    rows = [(c, 0, "user", "same", "", "") for c in range(600, 700)] + [(c, 0, "user", "same", "", "") for c in range(-50, 3)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert sorted(map(tuple, tries.trie_nodes(tries.with_shared_heads(docs)).collect()), key=str) == plain_nodes(rebuilt(rows))


def test_double_array_holds_its_paths_and_no_others():
    rng = random.Random(2)
    paths = sorted({tuple(rng.randrange(12) for _ in range(rng.randint(0, 6))) for _ in range(400)})
    codes, lengths = np.array([c for p in paths for c in p], np.int64), np.array([len(p) for p in paths])
    trie = tries.DoubleArray.pack(codes, np.cumsum(lengths) - lengths, lengths)
    known, at = {p[:d] for p in paths for d in range(len(p) + 1)}, {(): 0}
    for p in sorted(known, key=len)[1:]:
        at[p] = int(trie.step(np.array([at[p[:-1]]]), np.array([p[-1]]))[0])
    assert len(set(at.values())) == len(known) == int((trie.check != tries.FREE).sum())
    for p, node in at.items():
        children = trie.step(np.full(14, node), np.arange(14))
        assert [c for c in range(14) if children[c] != tries.FREE] == [c for c in range(14) if p + (c,) in known]


def test_query_over_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert sorted(map(tuple, op13_prefix_trie(spark, sf_dir).collect()), key=str) == plain_nodes(rebuilt(rows))
    assert "op13_prefix_trie" in ORACLES

"""Prefix tries of conversations: which turns conversations start with in common, and what storing them once would save.

Turns become 16-byte digests, equal conversations become one path with a weight, and paths are dealt into shards by
prefix: a prefix that holds more turns than a shard should is an upper node and is cut one turn deeper, so every
other node lies in one shard with all that starts with it. A shard numbers its turns densely, packs its paths
into a double array (BASE and CHECK) and walks them to sum up its nodes. Upper nodes appear in several shards; all that is summed for
them adds up, and they are merged by one aggregate over the shards.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.storage import match_rows, materialize

#: Turns of distinct paths that a prefix may hold before it is cut one turn deeper, and that a shard holds on average.
SHARD_TURNS = 8192
#: Conversations whose ids are put in order together.
CHUNK = 4096
#: Free places that a family of several children tries before it goes to the end of the array.
TRIES = 32
#: Bytes of a digest; the key of the root, which is the digest of no turns.
WIDTH, ROOT = 16, hashlib.md5(b"").digest()
FREE = -1


# -- conversations as lists of turns ------------------------------------------------------------------------------


def turn_lists(conversations: DataFrame, shared_by: int = 1) -> DataFrame:
    """base, conv_id, turns: the turns of each conversation in order, as structs of digest and size in code points.

    Turns are ordered by ``turn``, null first, turns of one number by digest; null role or text counts as empty. Rows without
    conv_id are left out. ``base`` is conv_id less its remainder by ``shared_by``, and rows of one base are in one partition.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id is not null").select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % shared_by).alias("base"),
        F.struct("turn", digest.alias("digest"), F.length(text).cast("bigint").alias("size")).alias("t"),
    )
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size")))
    return rows.repartition("base").groupBy("base", "conv_id").agg(ordered.alias("turns"))


def with_shared_heads(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """conv_id, turns, where the first h turns of every conversation are those of the conversation its group is named for.

    h is crc32 of the decimal conv_id modulo ``most``; the head is that conversation's first h original turns (all if there are
    fewer, none if it is absent), and own turns follow after the first h. A group has fewer than twice ``group`` conversations.
    """
    lists = turn_lists(conversations, group)
    own = F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, max(1, most - 1)))
    heads = lists.withColumn("head", F.max(own).over(Window.partitionBy("base")))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    none = F.slice("turns", 1, 0)
    return heads.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns") + 1)).alias("turns"))


# -- distinct paths ---------------------------------------------------------------------------------------------------


def paths(lists: DataFrame) -> DataFrame:
    """One row per distinct list of turns: key, path (turn digests), keys (a digest per prefix), sizes, n, least, ends.

    ``lists`` has one row per conv_id. ``n`` conversations have this very list, ``least`` is the smallest of them, and ``ends`` the
    SHA-256 of their ids in order. Ids are ordered in chunks and hashed chunk by chunk, so a list of any number of
    conversations is never held together.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    rows = lists.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    chunks = rows.groupBy(F.unhex(F.md5("path")).alias("key"), F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(
        F.sort_array(F.collect_list("conv_id")).alias("ids"), F.first("path").alias("path"), F.first("sizes").alias("sizes"),
    )
    schema = "key binary, path binary, keys binary, sizes array<bigint>, length bigint, n bigint, least bigint, ends string"
    return chunks.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_settle, schema)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of key and id, as one row per key."""
    names = ["key", "path", "keys", "sizes", "length", "n", "least", "ends"]
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    done: list[tuple] = []
    open_row = None

    def close() -> None:
        if open_row is not None:
            key, path, sizes, n, least, digest = open_row
            done.append((key, path, prefix_keys(path), sizes, len(path) // WIDTH, n, least, digest.hexdigest()))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * len(names)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        for row in batch.to_pylist():
            text = ",".join(map(str, row["ids"])).encode()
            if open_row is not None and open_row[0] == row["key"]:
                open_row[3] += len(row["ids"])
                open_row[5].update(b"," + text)
            else:
                close()
                open_row = [row["key"], row["path"], row["sizes"], len(row["ids"]), row["ids"][0], hashlib.sha256(text)]
        yield flush()
    close()
    yield flush()


def prefix_keys(path: bytes) -> bytes:
    """The digests of all prefixes of a list of turn digests, from one turn to all of them."""
    running, keys = hashlib.md5(), []
    for start in range(0, len(path), WIDTH):
        running.update(path[start:start + WIDTH])
        keys.append(running.digest())
    return b"".join(keys)


# -- shards ---------------------------------------------------------------------------------------------------------


def _prefix(depth: Column) -> Column:
    return F.substring(F.col("keys"), (depth - 1) * WIDTH + 1, F.lit(WIDTH))


def shards(distinct: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """``distinct`` paths with the shard they belong to (top, part) and what is known of the upper nodes on their way.

    upper: how many of its prefixes, from the first turn on, are upper nodes. owned: from which depth on this path owns the upper
    nodes it passes (it holds their smallest conversation). lone: no other path passes its last upper node.
    """
    whole = distinct.agg(F.sum("length").alias("turns"), F.min("least").alias("least"), F.count("*").alias("n")).first()
    steps = distinct.where("length > 0").select("key", "least", "length", "keys", F.explode(F.sequence(F.lit(1).cast("bigint"), "length")).alias("depth"))
    steps = steps.select("key", "least", "length", "depth", _prefix(F.col("depth").cast("int")).alias("prefix"))
    counted = steps.groupBy("prefix").agg(F.sum("length").alias("turns"), F.min("least").alias("first"), F.count("*").alias("passing"))
    big = materialize(counted.where(F.col("turns") > shard_turns), "upper")
    met = match_rows(steps, big, "prefix", "inner", "key")
    way = met.groupBy("key").agg(
        F.count("*").alias("upper"), F.count_if(F.col("first") == F.col("least")).alias("mine"),
        F.max_by(F.struct("prefix", "turns", "passing"), "depth").alias("last"),
    )
    rows = distinct.join(way, "key", "left")
    upper, mine = F.coalesce("upper", F.lit(0)), F.coalesce("mine", F.lit(0))
    holds = F.coalesce("last.turns", F.lit(whole["turns"] or 0))
    parts = F.greatest(F.ceil(holds / shard_turns), F.lit(1))
    first_lower = _prefix((upper + 1).cast("int"))
    part = F.when(F.col("length") > upper, F.pmod(F.xxhash64(first_lower), parts)).otherwise(0)
    owns_root = F.col("least") == F.lit(whole["least"])
    return rows.select(
        *distinct.columns, upper.alias("upper"), F.when(owns_root, 0).otherwise(upper - mine + 1).alias("owned"),
        (F.coalesce("last.passing", F.lit(whole["n"])) == 1).alias("lone"),
        F.coalesce("last.prefix", F.lit(ROOT)).alias("top"), part.cast("bigint").alias("part"),
    )


# -- the double array --------------------------------------------------------------------------------------------


class DoubleArray:
    """A trie in two arrays: the child of node s by code c is at BASE[s] + c, and CHECK there is s. The root is 0."""

    def __init__(self, size: int):
        self.base, self.check = np.zeros(size + 1, np.int64), np.full(size + 1, FREE, np.int64)
        self.check[0] = 0
        self.low, self.end = 1, 1

    @classmethod
    def pack(cls, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> DoubleArray:
        """The trie of paths ``codes[starts[i]:starts[i] + lengths[i]]``, level by level. Codes are 0 or more."""
        trie, wide = cls(len(codes) + 1), int(codes.max(initial=0)) + 1
        going, at = np.flatnonzero(lengths > 0), np.zeros(len(starts), np.int64)
        depth = 0
        while len(going):
            families, back = np.unique(at[going] * wide + codes[starts[going] + depth], return_inverse=True)
            at[going] = trie._place(families // wide, families % wide)[back]
            depth += 1
            going = going[lengths[going] > depth]
        return trie

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of nodes by code, FREE where there is none."""
        to = self.base[nodes] + codes
        inside = (to > 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == nodes), to, FREE)

    def _place(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Places for children, given in order of parent and code. Families of several are placed first, largest first."""
        first = np.flatnonzero(np.diff(parents, prepend=-1))
        counts = np.diff(first, append=len(parents))
        places = np.empty(len(parents), np.int64)
        several = np.flatnonzero(counts > 1)
        for f in several[np.argsort(-counts[several], kind="stable")]:
            members = slice(first[f], first[f] + counts[f])
            offsets = codes[members] - codes[first[f]]
            places[members] = self._fit(offsets) + offsets
            self._take(places[members], parents[members], codes[members])
        alone = first[counts == 1]
        if len(alone):
            places[alone] = self._holes(len(alone))
            self._take(places[alone], parents[alone], codes[alone])
            self.low = int(places[alone[-1]]) + 1
        return places

    def _take(self, places: np.ndarray, parents: np.ndarray, codes: np.ndarray) -> None:
        self.check[places], self.base[parents] = parents, places - codes
        self.end = max(self.end, int(places[-1]) + 1)

    def _fit(self, offsets: np.ndarray) -> int:
        """The first of a few free places from which all ``offsets`` are free; otherwise the end, where all are."""
        self._reach(self.end + int(offsets[-1]) + 1)
        free = self.low + np.flatnonzero(self.check[self.low:self.low + 8 * TRIES] == FREE)[:TRIES]
        for place in free:
            if place < self.end and (self.check[place + offsets] == FREE).all():
                return int(place)
        return self.end

    def _holes(self, n: int) -> np.ndarray:
        """The first ``n`` free places from ``low`` on."""
        span = 2 * n + 64
        while True:
            self._reach(self.low + span)
            free = np.flatnonzero(self.check[self.low:self.low + span] == FREE)
            if len(free) >= n:
                return self.low + free[:n]
            span *= 2

    def _reach(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, FREE, np.int64)])


_NODE_SCHEMA = (
    "key binary, depth bigint, parent_key binary, upper boolean, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, passed bigint, kept bigint, ends string"
)
_NODE_KINDS = [pa.binary(), pa.int64(), pa.binary(), pa.bool_(), *[pa.int64()] * 7, pa.string()]


def shard_nodes(table: pa.Table) -> pa.Table:
    """The nodes of one shard, from its paths.

    ``passed`` is the code points of all turns from the node on, over all its conversations, and ``kept`` those of the node
    and the nodes below, each once; upper nodes count below only in the shard of the path that owns them.
    """
    path, keys = table["path"].to_pylist(), table["keys"].to_pylist()
    lengths = table["length"].to_numpy()
    n, least, upper, owned = (table[c].to_numpy() for c in ("n", "least", "upper", "owned"))
    ends, lone = table["ends"].to_pylist(), table["lone"].to_numpy(zero_copy_only=False)
    sizes = table["sizes"].combine_chunks().flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    turns, back, often = np.unique(np.frombuffer(b"".join(path), f"S{WIDTH}"), return_inverse=True, return_counts=True)
    dense = np.empty(len(turns), np.int64)
    dense[np.argsort(-often, kind="stable")] = np.arange(len(turns))
    codes = dense[back]
    trie = DoubleArray.pack(codes, starts, lengths)

    places = len(trie.check)
    convs, first, passed, size = np.zeros(places, np.int64), np.full(places, np.iinfo(np.int64).max), np.zeros(places, np.int64), np.zeros(places, np.int64)
    level, sample = np.full(places, -1, np.int64), np.zeros(places, np.int64)
    counted, is_upper, leaf = np.zeros(places, bool), np.zeros(places, bool), np.zeros(places, bool)
    ending: dict[int, str] = {}
    left = np.add.reduceat(np.append(sizes, 0), starts) * (lengths > 0) if len(lengths) else sizes
    going, at, depth, levels = np.arange(len(lengths)), np.zeros(len(lengths), np.int64), 0, []
    while len(going):
        here = at[going]
        np.add.at(convs, here, n[going])
        np.minimum.at(first, here, least[going])
        np.add.at(passed, here, n[going] * left[going])
        level[here], sample[here] = depth, going
        above = upper[going] >= depth
        is_upper[here] = above
        counted[here[~above | (owned[going] <= depth)]] = True
        leaf[here[above & lone[going] & (lengths[going] == depth)]] = True
        levels.append(np.unique(here))
        for i in going[lengths[going] == depth]:
            ending[int(at[i])] = ends[i]
        going = going[lengths[going] > depth]
        turn = starts[going] + depth
        at[going] = trie.step(at[going], codes[turn])
        size[at[going]] = sizes[turn]
        if depth:
            left[going] -= sizes[turn - 1]
        depth += 1

    used = np.concatenate(levels)
    parent = trie.check
    children, leaves, kept = np.zeros(places, np.int64), np.zeros(places, np.int64), np.where(counted, size, 0)
    np.add.at(children, parent[used[(used > 0) & counted[used]]], 1)
    lower = used[~is_upper[used]]
    leaves[lower[children[lower] == 0]] = 1
    leaves[leaf] = 1
    for nodes in reversed(levels[1:]):
        np.add.at(leaves, parent[nodes], leaves[nodes])
        np.add.at(kept, parent[nodes], kept[nodes])

    def key(i: int, d: int) -> bytes:
        return keys[i][(d - 1) * WIDTH:d * WIDTH] if d else ROOT

    depths, rows = level[used].tolist(), sample[used].tolist()
    columns = [
        [key(i, d) for i, d in zip(rows, depths)], depths, [key(i, d - 1) if d else None for i, d in zip(rows, depths)], is_upper[used],
        first[used], [p if d else None for p, d in zip(first[parent[used]].tolist(), depths)], convs[used], children[used],
        leaves[used], passed[used], kept[used], [ending.get(s) for s in used.tolist()],
    ]
    names = [f.split()[0] for f in _NODE_SCHEMA.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(columns, _NODE_KINDS)], names=names)


# -- nodes -----------------------------------------------------------------------------------------------------------


def trie_nodes(lists: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the prefix trie of ``lists`` (conv_id, turns: array of struct of digest and size).

    A node is a distinct sequence of first turns, from the root without turns on; conversations that start with it are its members.
    conv_id: smallest member; depth; parent_conv_id: the parent's conv_id, null for the root; n_convs: members; n_children;
    n_leaves: nodes without children from the node down; saved_tokens: sum from the node down of (members - 1) times the code points of
    the last turn; ends_sha256: hash of the ids, in order, of the members that end here. Conversations of any length and any number of
    equal ones are taken whole, one conversation is one record of a task; no conversations give no nodes.
    """
    sharded = shards(materialize(paths(lists), "paths"), shard_turns)
    nodes = materialize(sharded.groupBy("top", "part").applyInArrow(shard_nodes, _NODE_SCHEMA), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "passed", "kept")]
    upper = nodes.where("upper").groupBy("key").agg(
        F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends"),
    )
    upper = materialize(upper, "upper_nodes")
    parents = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "passed", "kept", "ends"]
    named = upper.join(parents, "parent_key", "left").select(columns)
    return _finished(named.union(_below(nodes.where("not upper"), parents, columns)))


def _below(lower: DataFrame, parents: DataFrame, columns: list[str]) -> DataFrame:
    """Nodes of one shard each. Their parents' smallest members were found in the shard, but for those right below an upper node."""
    return match_rows(
        lower.withColumnRenamed("parent_conv_id", "inside"), parents, "parent_key", "left", "key",
    ).withColumn("parent_conv_id", F.coalesce("parent_conv_id", "inside")).select(columns)


def _finished(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("passed") - F.col("kept")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )

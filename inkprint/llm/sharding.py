"""Sharding by a hierarchical weighted hash tree.

A cluster is a tree of regions, racks and shards; every leaf has a weight, every inner node the sum below it. A
key descends from the root: at each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the key and the
child's own name, and the smallest draw wins. A draw depends on one child's name and weight only, so when weights change,
rows move only towards subtrees whose weight grew or away from subtrees whose weight fell: all else stays.

Native: one projection of built-in functions, then a numbering of the rows in each shard.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.storage import materialize


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(shards: int, base: int = 24, rack: int = 4, region: int = 8) -> list[Leaf]:
    """The tree of a cluster that began with ``base`` shards and has ``shards`` now.

    The first ``base`` shards fill regions of ``region`` shards in racks of ``rack``. Every later shard brings a region
    of its own, so that growth changes the weight of that one subtree only and rows move only into the new shard.
    """
    first = [Leaf(f"r{s // region}", f"k{s // rack}", s) for s in range(min(shards, base))]
    return first + [Leaf(f"r+{s}", f"k+{s}", s) for s in range(base, shards)]


def _pick(key: Column, children: list[tuple[str, float, Column]], seed: int) -> Column:
    """The value of the child with the smallest draw; equal draws go to the child whose name sorts first."""
    if len(children) == 1:
        return children[0][2]
    draws = []
    for name, weight, value in sorted(children, key=lambda c: c[0]):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{seed}/{name}")), 11)
        unit = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.log(unit) / F.lit(weight)).alias("draw"), F.lit(name).alias("name"), value.alias("value")))
    return F.least(*draws)["value"]


def tree_shard(key: Column, leaves: list[Leaf], seed: int = 0) -> Column:
    """The shard of ``key`` in the tree of ``leaves``; leaves without weight get no rows. A null key hashes like any other."""
    tree: dict[str, dict[str, list[Leaf]]] = defaultdict(lambda: defaultdict(list))
    for leaf in leaves:
        if leaf.weight > 0:
            tree[leaf.region][leaf.rack].append(leaf)
    if not tree:
        raise ValueError("no shard has weight")
    def weigh(found: list[Leaf]) -> float:
        return sum(x.weight for x in found)

    regions = []
    for region, racks in tree.items():
        inner = []
        for rack, found in racks.items():
            ends = [(f"{region}/{rack}/{x.shard}", x.weight, F.lit(x.shard)) for x in found]
            inner.append((f"{region}/{rack}", weigh(found), _pick(key, ends, seed)))
        regions.append((region, sum(weigh(f) for f in racks.values()), _pick(key, inner, seed)))
    return _pick(key, regions, seed)


#: Equal rows that are numbered by one task.
PIECE = 100_000


def number_rows(df: DataFrame, group: str, order: list[str], key: str, rows_per_task: int = 100_000) -> DataFrame:
    """``df`` with ``slot``: 0, 1, ... without gaps in each ``group``, in an order that depends on the rows alone.

    Rows that agree in every column are counted first, so any number of them is one row until the numbers are dealt out. A group may
    hold any share of all rows, so it is cut into chunks by a hash of ``key`` and the columns ``order``, which tell different rows apart; chunks
    are numbered on their own and start where the counts of the chunks before them end. The number of chunks follows the number
    of rows.
    """
    chunks = max(1, -(-df.count() // rows_per_task) * 8)
    columns = df.columns
    rows = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    rows = materialize(rows.withColumn("_chunk", F.pmod(F.xxhash64(key, *order, F.lit("chunk")), F.lit(chunks)).cast("int")), "rows")
    counts = rows.groupBy(group, "_chunk").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_chunk", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    starts = materialize(starts, "starts")
    within = Window.partitionBy(group, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(starts, [group, "_chunk"])
    placed = placed.select(*columns, "_n", (F.col("_start") + F.col("_before")).alias("slot"))
    single = placed.where("_n = 1").drop("_n")
    pieces = placed.where("_n > 1").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("_n") - 1) - (F.col("_n") - 1) % PIECE, F.lit(PIECE).cast("bigint"))).alias("_from"))
    last = F.least(F.col("_from") + PIECE, F.col("_n")) - 1
    dealt = pieces.repartition("slot", "_from").withColumn("_at", F.explode(F.sequence("_from", last)))
    return single.union(dealt.select(*columns, (F.col("slot") + F.col("_at")).alias("slot")))


def shard_documents(
    docs: DataFrame, shards: int = 24, leaves: list[Leaf] | None = None, grown: list[Leaf] | None = None, seed: int = 0,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length of the text plus 8 (a null text has length 0, checksum that of no bytes). Documents with
    the same or a null doc_id go to the same shard and get different slots. Other columns of ``docs`` are not read.
    Law ``key``: doc_id and the tree alone decide; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text).alias("text_crc32"),
    )
    placed = rows.select(
        "*", F.lit("key").alias("law"), tree_shard(F.col("doc_id"), leaves or layout(shards), seed).alias("shard"),
        tree_shard(F.col("doc_id"), grown or layout(shards + 1), seed).alias("grown_shard"),
    )
    narrow = materialize(placed, "placed")
    return number_rows(narrow, "shard", ["doc_id", "text_crc32", "size"], "doc_id").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard",
    )

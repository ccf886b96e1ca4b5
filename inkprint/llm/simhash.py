"""Near duplicates by SimHash: segment popcounts as an embedding, a grid range join, exact verification.

A 64-bit fingerprint is cut into segments and mapped to the number of set bits of each. Two fingerprints that differ in d bits
lie at most d apart in Manhattan distance there, so a range join of radius d on the grid of count vectors misses no link. Every
point is put into its own cell and into the cells one step away; any two within distance 2 then share a cell (their
own, or one half way), and the pairs of a cell are checked exactly on the fingerprints.

Cells are formed over distinct fingerprints, so copies never multiply. A crowded cell is not paired: its fingerprints
go through a finer grid, the fingerprints at Hamming distance 1. Two fingerprints within two bits share one of those, at most
65 fingerprints can meet there, and so this way is exact and grows in proportion.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm.base import connected, map_rows, text_bytes
from inkprint.storage import materialize

SEED, BITS = 42, 64
#: Fingerprints in a cell that are paired with one another; fuller cells take the finer grid.
CROWD = 48
#: A value held by more than one row in so many is heavy; there are fewer than so many of them, so they may be broadcast.
HEAVY = 1000


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of a whole text, repeats included; A-Z lower-cased, words end at ASCII white space."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) < words:
        joined = [b" ".join(tokens)]
    else:
        joined = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), joined), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer; 0 without hashes."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        block = hashes[start:start + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fingerprint (bigint) of every row. Null and empty texts have fingerprint 0."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        return {
            "doc_id": batch.column(0), "fingerprint": [fingerprint(shingle_hashes(t, words)) for t in text_bytes(batch, "text")],
        }

    return map_rows(docs.select("doc_id", "text"), run, "doc_id bigint, fingerprint bigint")


def popcounts(bits: Column) -> Column:
    """The set bits of each of the 16 segments of four bits, packed four bits apiece into one integer."""
    odd, low = F.lit(0x5555555555555555), F.lit(0x3333333333333333)
    a, b = bits.bitwiseAND(odd), F.shiftrightunsigned(bits, 1).bitwiseAND(odd)
    pairs = a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))
    return pairs.bitwiseAND(low) + F.shiftrightunsigned(pairs, 2).bitwiseAND(low)


def near_cells(counts: Column) -> Column:
    """The grid cells within Manhattan distance 1 of a count vector, its own first."""
    cells = [counts]
    for segment in range(16):
        value = F.shiftrightunsigned(counts, 4 * segment).bitwiseAND(F.lit(15).cast("bigint"))
        step = F.shiftleft(F.lit(1).cast("bigint"), 4 * segment)
        cells += [F.when(value < 4, counts + step), F.when(value > 0, counts - step)]
    return F.array_compact(F.array(*cells))


def _pairs(members: str, bits: int) -> Column:
    """The linked pairs of a bounded list of fingerprints, each once."""
    return F.expr(
        f"flatten(transform({members}, x -> transform(filter({members}, y -> x < y and bit_count(x ^ y) <= {bits}), y -> struct(x as a, y as b))))"
    )


def links(points: DataFrame, bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of distinct ``fingerprint`` values of ``points`` that connect all values within ``bits`` bits, 2 at most.

    Every link between different fingerprints appears, once or more. An empty table gives no links.
    """
    if not 0 <= bits <= 2:
        raise ValueError("cells one step away meet for distances up to 2")
    near = points.select("fingerprint", F.explode(near_cells(popcounts(F.col("fingerprint")))).alias("cell"))
    cells = near.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b"),
    ).where("n > 1")
    cells = materialize(cells, "cells")
    two = cells.where(f"n = 2 and bit_count(a ^ b) <= {bits}").select("a", "b")
    few = near.join(cells.where(f"n > 2 and n <= {crowd}").select("cell"), "cell")
    few = few.groupBy("cell").agg(F.collect_list("fingerprint").alias("m")).select(F.inline(_pairs("m", bits)))
    many = near.join(cells.where(f"n > {crowd}").select("cell"), "cell").select("fingerprint").distinct()
    flips = F.array(F.col("fingerprint"), *[F.col("fingerprint").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(BITS)])
    fine = many.select("fingerprint", F.explode(flips).alias("middle"))
    fine = fine.groupBy("middle").agg(F.collect_list("fingerprint").alias("m")).where("size(m) > 1")
    return two.union(few).union(fine.select(F.inline(_pairs("m", bits))))


def rooted(points: DataFrame, bits: int = 2) -> DataFrame:
    """``points``, one row per ``fingerprint``, with root: the smallest fingerprint reachable over links."""
    found = connected(links(points.select("fingerprint"), bits))
    return points.join(found, F.col("fingerprint") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fingerprint")).drop("node")


def components(marked: DataFrame, bits: int = 2) -> DataFrame:
    """``marked`` (doc_id, fingerprint) with component_id: the smallest doc_id reachable over links, its own included.

    Repeated rows stay separate rows. Rows without doc_id link like others but give no id; a component of such rows alone
    has a null id. An empty table gives an empty table. Fingerprints of very many rows are looked up in a broadcast table, so
    that their rows stay where they are.
    """
    points = materialize(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "points")
    linked = materialize(rooted(points, bits), "rooted")
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = linked.select("fingerprint", "root", "n").join(roots, "root").select("fingerprint", "component_id", "n")
    total = points.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(labels.where(F.col("n") * HEAVY > total).drop("n"))
    light = marked.join(heavy, "fingerprint", "left_anti").join(labels.drop("n"), "fingerprint")
    return marked.join(heavy, "fingerprint").union(light)


def near_duplicates(docs: DataFrame, bits: int = 2, words: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs``; fingerprints are read again from the shared folder.

    Null and empty texts have fingerprint 0 and link like any other; texts are read whole; repeated rows give repeated results.
    """
    return components(materialize(fingerprints(docs, words), "fingerprints"), bits)


def deduplicate(docs: DataFrame, bits: int = 2, words: int = 3) -> DataFrame:
    """One row of every group of near duplicates, with all columns of ``docs``: that of the smallest doc_id, rows without one last.

    Groups are the components of ``near_duplicates``. Among rows of one doc_id the one with the smallest hash of all its columns
    stays; of rows that are equal in every column, one. Null and empty texts are one group. An empty table gives an empty table.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = [c for c, f in zip(columns, docs.schema.fields) if "map<" not in f.dataType.simpleString()]
    tag = F.xxhash64(*hashed, *[c.isNull() for c in columns])
    rows = docs.select(F.struct(*columns).alias("row"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), tag.alias("tag"))

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        marks = [fingerprint(shingle_hashes(t, words)) for t in text_bytes(batch, "text")]
        return {"doc_id": batch.column(0), "tag": batch.column(2), "fingerprint": marks}

    marked = map_rows(docs.select("doc_id", "text", tag.alias("tag")), run, "doc_id bigint, tag bigint, fingerprint bigint")
    marked = materialize(marked, "marks")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first")
    points = materialize(marked.groupBy("fingerprint").agg(first), "points")
    kept = rooted(points, bits).groupBy("root").agg(F.min("first").alias("first"))
    key = ["id", "tag"]
    kept = materialize(kept.select(F.coalesce("first.doc_id", F.lit(0)).alias("id"), F.col("first.tag").alias("tag")), "kept")
    counts = marked.groupBy(F.coalesce("doc_id", F.lit(0)).alias("id"), "tag").agg(F.count("*").alias("n"))
    heavy = materialize(counts.where(F.col("n") * HEAVY > marked.count()).drop("n"), "heavy")
    light = rows.join(F.broadcast(heavy), key, "left_anti").join(kept, key, "left_semi").dropDuplicates(key)
    chosen = F.broadcast(heavy.join(kept, key, "left_semi"))
    single = rows.join(chosen, key, "left_semi").groupBy(key).agg(F.first("row").alias("row"))
    return light.select("row.*").union(single.select("row.*"))

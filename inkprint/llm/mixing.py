"""Mixing sources to target weights by subset sums of exact lengths.

Each source gets a target number of words. Whole passes over a source take ``floor(target / size)`` copies of every document;
what is left is a budget for a subset of its documents. That subset is fitted on the counts of documents by exact length:
an even share of every length first, then a bounded-knapsack dynamic programme over the words still missing. The documents
of each length are chosen by a seeded hash. No text, and no list of documents, ever reaches the driver or one task: the
fit sees one row per source and length.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.storage import materialize

#: Weights of the sources by name, repeating; the most times a source or a document is taken.
WEIGHTS, MOST = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("bigint")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> dict:
    """Words wanted of each source: shares of the whole by weight, never above ``most`` times the source's own size.

    What a source at its limit leaves over is shared by weight among the others, until none is above. Sources are weighed
    in order of code points, null last.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(order)}
    size, left, fixed = dict(order), float(sum(n for _, n in order)), {}
    open_ = [name for name, _ in order]
    while open_:
        total = sum(weight[name] for name in open_)
        over = [name for name in open_ if left * weight[name] / total > most * size[name]]
        if not over:
            return fixed | {name: left * weight[name] / total for name in open_}
        for name in over:
            fixed[name] = float(most * size[name])
        left -= sum(fixed[name] for name in over)
        open_ = [name for name in open_ if name not in fixed]
    return fixed


def fit_lengths(counts: dict[int, int], budget: int, reach: int = 65_536) -> dict[int, int]:
    """How many documents of each length to take so that their lengths add up to ``budget`` as nearly as can be.

    An even share of every length comes first, rounded down. Single documents, longest first, then bring the words still
    missing under ``reach``. A bounded-knapsack programme over what is left of each length finds the largest sum
    that fits: lengths are split into binary multiples, reachable sums are the bits of one integer, and the choice is read
    back from the saved states. If one more shortest document comes nearer, it is added.
    """
    lengths = sorted((n for n in counts if n > 0 and counts[n] > 0), reverse=True)
    total = sum(n * counts[n] for n in lengths)
    if budget <= 0 or total == 0:
        return {}
    if budget >= total:
        return {n: counts[n] for n in lengths}
    take = {n: counts[n] * budget // total for n in lengths}
    missing = budget - sum(n * k for n, k in take.items())
    for n in lengths:
        if missing <= reach:
            break
        more = min(counts[n] - take[n], max(0, (missing - reach // 2) // n))
        take[n] += more
        missing -= n * more
    bounded = min(missing, reach)
    items = []
    for n in lengths:
        if n > bounded:
            continue
        spare, part = min(counts[n] - take[n], bounded // n), 1
        while spare > 0:
            part = min(part, spare)
            items.append((n, part))
            spare, part = spare - part, part * 2
    mask, states = (1 << (bounded + 1)) - 1, [1]
    for n, part in items:
        if states[-1] >> bounded & 1:
            break
        states.append((states[-1] | states[-1] << (n * part)) & mask)
    at = states[-1].bit_length() - 1
    missing -= at
    for i in range(len(states) - 1, 0, -1):
        if not states[i - 1] >> at & 1:
            n, part = items[i - 1]
            take[n] += part
            at -= n * part
    spare = [n for n in lengths if counts[n] > take[n]]
    if spare and missing > 0 and spare[-1] - missing < missing:
        take[spare[-1]] += 1
    return {n: k for n, k in take.items() if k}


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 0, reach: int = 65_536, bins: int = 1024,
) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken.

    ``size`` counts the words of the whole text (null: 0), ``copies`` how often the mix takes the document, ``taken`` the words
    that makes. Null is a source of its own. Documents of size 0 add nothing: they are taken as often as whole passes are made.
    Equal rows are separate documents; those with equal keys are interchangeable. The choice depends on the rows and the
    seed alone. Empty table: empty result. Reads doc_id, source and text only.
    """
    rows = materialize(_sized(docs, seed, bins), "sizes")
    return _copies(rows, rows, weights, most, reach)


def mixed_rows(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 0, reach: int = 65_536, bins: int = 1024,
) -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, as often as ``mix`` takes it."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = materialize(_sized(docs, seed, bins), "sizes")
    copied = _copies(rows, _sized(docs, seed, bins, row.alias("_row")), weights, most, reach, "_row")
    return copied.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("_row.*")


def _sized(docs: DataFrame, seed: int, bins: int, *carried: Column) -> DataFrame:
    rows = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_hash"), *carried,
    )
    return rows.withColumn("_bin", F.pmod("_hash", F.lit(bins)).cast("int"))


def _copies(narrow: DataFrame, rows: DataFrame, weights: tuple[float, ...], most: int, reach: int, *carried: str) -> DataFrame:
    """Count ``narrow`` by source, size and bin of the hash, fit the plan, and rank ``rows`` in the bins.

    A length may be that of a third of all documents, so its documents are ranked bin by bin; a bin starts where the counts of
    those before it end.
    """
    by_bin = materialize(narrow.groupBy("source", "size", "_bin").agg(F.count("*").alias("n")), "bins")
    by_length = by_bin.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = _with_targets(sizes, weights, most)
    plan = materialize(_fit(by_length.join(wanted, F.col("source").eqNullSafe(F.col("wanted_source"))), reach), "plan")
    before = Window.partitionBy("source", "size").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bin.withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    keys = ["source_key", "size"]
    cells = _keyed(starts).join(_keyed(plan).drop("source"), keys).drop("source")
    within = Window.partitionBy(*keys, "_bin").orderBy("_hash", "doc_id")
    ranked = _keyed(rows).withColumn("_row_number", F.row_number().over(within).cast("bigint"))
    joined = ranked.join(cells, [*keys, "_bin"])
    further = F.when(F.col("_start") + F.col("_row_number") <= F.col("extra"), 1).otherwise(0)
    copies = F.least(F.col("passes") + further, F.lit(most)).cast("bigint")
    return joined.withColumn("copies", copies).select(
        "doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carried,
    )


def _keyed(df: DataFrame) -> DataFrame:
    """A key for joins that tells null from every name."""
    return df.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))


def _with_targets(sizes: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """Sources with their targets. One row per source passes the driver: a mix is written down source by source."""
    spark = sizes.sparkSession
    found = [(r["source"], int(r["source_size"])) for r in sizes.collect()]
    wanted = targets(found, weights, most)
    return spark.createDataFrame(
        [(name, n, wanted[name]) for name, n in found], "wanted_source string, source_size bigint, target double",
    )


def _fit(lengths: DataFrame, reach: int) -> DataFrame:
    """Per source and length: whole passes and further documents. A group holds one row per distinct length of one source."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        size, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        passes = int(target // size) if size else 1
        extra = fit_lengths(dict(zip(frame["size"].tolist(), frame["n"].tolist())), round(target) - passes * size, reach)
        return frame.assign(passes=passes, extra=[extra.get(n, 0) for n in frame["size"].tolist()])[
            ["source", "size", "source_size", "target", "passes", "extra"]
        ]

    schema = "source string, size bigint, source_size bigint, target double, passes bigint, extra bigint"
    return _keyed(lengths).groupBy("source_key").applyInPandas(fit, schema)

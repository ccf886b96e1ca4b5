"""Splits, folds and samples that are exact, seeded and free of per-class sorts.

A stratified split of a class is "the first q rows of the class in a seeded order". Ranking every row
of a class would put the whole class, which may be a third of the corpus, into one task. Instead the
rank is turned into a cut: the key of the q-th row. How many rows of each class go where is worked out on a
table with one row per class, which stays a table however many classes there are. Cuts of classes up to a size are found by
ranking their rows. For larger classes, of which a corpus can only have few, finding a cut needs

1. approximate quantiles around the wanted rank,
2. one count of the rows below and inside the bracket those quantiles give, which proves the bracket
   holds the wanted rank (it is widened and counted again if not),
3. a rank over the rows inside the bracket only.

Every row is then assigned by comparing its key with the few cuts of its class: a projection after a join with one row per
class. The result is the same as ranking everything.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.functions.names import named
from inkprint.storage import BROADCAST_ROWS, local_side, match_skewed, materialize

# Classes up to this size are ranked whole; larger ones are ranked inside brackets.
DIRECT_ROWS = 1_000_000
_ACCURACY = 10_000


def seeded_hash(key: Column | str, seed: int) -> Column:
    """A reproducible pseudo-random order: MD5 of the key and the seed."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))


def _hash_number(digest: Column) -> Column:
    """The first 60 bits of a digest, in the digest's own order."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _group(column: str | None) -> Column:
    """The class a row belongs to; rows without a label form a class of their own."""
    return F.coalesce(F.col(column).cast("string"), F.lit("\0")) if column else F.lit("all")


def _order(df: DataFrame, key: str, seed: int | None) -> DataFrame:
    """Add ``_k`` (a bigint that orders rows) and ``_tie`` (settles equal ``_k``)."""
    if seed is None and dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint"):
        return df.withColumn("_k", F.col(key).cast("bigint")).withColumn("_tie", F.lit(""))
    digest = seeded_hash(key, seed or 0)
    return df.withColumn("_tie", digest).withColumn("_k", _hash_number(F.col("_tie")))


def running_total(df: DataFrame, order: Sequence[str], value: str, output: str) -> DataFrame:
    """``df`` with ``output``: the sum of ``value`` over all rows before this one in ``order``, which tells all rows apart.

    Rows are dealt by ranges of ``order``; sums of whole ranges are the only numbers that come together.
    """
    placed = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = sorted(placed.groupBy("_range").agg(F.sum(value).alias("s")).collect())
    starts, at = [], 0
    for r in sums:
        starts.append((r["_range"], at))
        at += int(r["s"] or 0)
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    joined = placed.join(local_side(df.sparkSession, starts, "_range int, _offset bigint"), "_range")
    return joined.withColumn(output, (F.col("_offset") + F.coalesce(inside, F.lit(0))).cast("bigint")).drop("_range", "_offset")


def split_quotas(classes: DataFrame, n_train: int, total: int) -> DataFrame:
    """``classes`` (_g, n) with ``ends``, the rows of each class that are no train rows, as an array of one.

    ``n_train`` rows are shared over the classes in proportion to their sizes, exactly: what is left after
    rounding down goes to the largest remainders, equal ones in class order.
    """
    # Decimals, because a product of two counts may not fit a bigint; div, because a rounded quotient may be one too large.
    product = F.col("n").cast("decimal(18,0)") * F.lit(n_train).cast("decimal(18,0)")
    whole = F.lit(max(total, 1)).cast("decimal(18,0)")
    shared = classes.withColumn("_product", product).withColumn("_total", whole).withColumn("_share", F.expr("_product div _total"))
    left_over = F.col("_product") - F.col("_share").cast("decimal(18,0)") * F.col("_total")
    shared = materialize(shared.withColumn("_behind", -left_over), "shares")
    missing = n_train - int(shared.agg(F.sum("_share")).first()[0] or 0)
    ranked = running_total(shared.withColumn("_one", F.lit(1)), ["_behind", "_g"], "_one", "_rank")
    train = F.col("_share") + F.when(F.col("_rank") < missing, 1).otherwise(0)
    return ranked.select("_g", "n", F.array(F.col("n") - train).alias("ends"))


def fold_quotas(classes: DataFrame, k: int) -> DataFrame:
    """``classes`` (_g, n, first) with ``ends``: the rank in each class that folds 0 to k - 2 end at.

    Classes are laid end to end in order of their first row and dealt out round-robin, which keeps both
    the classes and the fold totals within one row of even.
    """
    laid = running_total(classes, ["first", "_g"], "n", "_start")
    start, end = F.col("_start"), F.col("_start") + F.col("n")
    ends, at = [], F.lit(0).cast("bigint")
    for fold in range(k - 1):
        dealt = [F.floor((edge - fold + k - 1) / k) for edge in (end, start)]
        at = at + dealt[0] - dealt[1]
        ends.append(at)
    return laid.select("_g", "n", F.array(*ends).cast("array<bigint>").alias("ends"))


Plan = Callable[[DataFrame], DataFrame]


def _cuts(
    df: DataFrame, group: str | None, key: str, seed: int | None, plan: Plan, fractions: Sequence[float],
    direct_rows: int,
) -> DataFrame:
    """One row per group: ``_g`` and ``_cuts``, the (key, tie, id) of the last row of each part but the last.

    ``plan`` turns (_g, n, first), the groups with their sizes and smallest ids, into (_g, n, ends), the
    cumulative rank each part ends at. ``fractions`` are the same boundaries as shares, used to place the brackets.
    """
    rows = _order(df.select(_group(group).alias("_g"), F.col(key)), key, seed)
    classes = materialize(rows.groupBy("_g").agg(F.count("*").alias("n"), F.min(key).alias("first")), "classes")
    planned = materialize(plan(classes), "planned")
    small = _ranked_cuts(rows, planned.where(F.col("n") <= direct_rows).drop("n"), key)
    # Fewer than rows / direct_rows of them.
    large = {r["_g"]: (r["n"], r["ends"]) for r in planned.where(F.col("n") > direct_rows).collect()}
    if not large:
        return small
    return small.unionByName(_bracketed_cuts(rows, large, key, fractions, df.schema[key].dataType.simpleString()))


def _ranked_cuts(rows: DataFrame, planned: DataFrame, key: str) -> DataFrame:
    """Cuts of groups that are small enough to rank their rows."""
    few = len(planned.select(F.lit(1)).take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS
    position = F.row_number().over(Window.partitionBy("_g").orderBy("_k", "_tie", key)).cast("bigint")
    inside = rows.join(F.broadcast(planned) if few else planned, "_g").withColumn("_at", position)
    cut = F.struct("_k", "_tie", F.col(key).alias("_id"))
    found = inside.filter(F.array_contains("ends", F.col("_at"))).groupBy("_g").agg(F.collect_list(F.struct("_at", cut.alias("c"))).alias("_found"))
    cuts = F.transform("ends", lambda end: F.get(F.filter("_found", lambda f: f["_at"] == end), F.lit(0))["c"])
    return planned.join(found, "_g", "left").select("_g", cuts.alias("_cuts"))


def _bracketed_cuts(
    rows: DataFrame, large: dict[str, tuple[int, list[int]]], key: str, fractions: Sequence[float], id_type: str,
) -> DataFrame:
    """Cuts of groups whose rows are ranked inside brackets only."""
    spark = rows.sparkSession
    names = local_side(spark, [(name,) for name in large], "_g string")
    rows = rows.join(F.broadcast(names), "_g", "left_semi")
    margin = 4.0 / _ACCURACY
    schema = "_g string, _j int, _rank bigint, _lo bigint, _hi bigint"
    while True:
        whole = margin >= 1.0
        edges = [min(1.0, max(0.0, f + d)) for f in fractions for d in (-margin, margin)]
        stats = rows.groupBy("_g").agg(
            F.min("_k").alias("lo"), F.max("_k").alias("hi"), F.percentile_approx("_k", edges, _ACCURACY).alias("q"),
        ).collect()
        brackets = [
            (r["_g"], j, rank, *((r["lo"], r["hi"]) if whole else (r["q"][2 * j], r["q"][2 * j + 1])))
            for r in stats for j, rank in enumerate(large[r["_g"]][1]) if rank > 0
        ]
        # Rows under and up to each bracket, so that the rank is known to lie inside.
        counted = (
            rows.join(local_side(spark, brackets, schema), "_g")
            .groupBy("_g", "_j", "_rank")
            .agg(
                F.count_if(F.col("_k") < F.col("_lo")).alias("below"),
                F.count_if(F.col("_k") <= F.col("_hi")).alias("upto"),
            )
            .collect()
        )
        if all(r["below"] < r["_rank"] <= r["upto"] for r in counted):
            break
        margin *= 8
    below = {(r["_g"], r["_j"]): r["below"] for r in counted}
    # Brackets that coincide are ranked once for all their cuts.
    spans: dict[tuple, list[tuple[int, int]]] = {}
    for name, j, rank, lo, hi in brackets:
        spans.setdefault((name, lo, hi), []).append((j, rank - below[name, j]))
    span_rows = [(name, lo, hi, [r for _, r in cuts], [j for j, _ in cuts]) for (name, lo, hi), cuts in spans.items()]
    span_schema = "_g string, _lo bigint, _hi bigint, _ranks array<bigint>, _js array<int>"
    inside = rows.join(local_side(spark, span_rows, span_schema), "_g").filter(F.col("_k").between(F.col("_lo"), F.col("_hi")))
    position = F.row_number().over(Window.partitionBy("_g", "_lo", "_hi").orderBy("_k", "_tie", key))
    found = (
        inside.withColumn("_at", position.cast("bigint"))
        .filter(F.array_contains("_ranks", F.col("_at")))
        .select("_g", "_js", "_ranks", "_at", F.struct("_k", "_tie", F.col(key).alias("_id")).alias("_cut"))
        .collect()
    )
    by_group: dict[str, dict[int, tuple]] = {name: {} for name in large}
    for r in found:
        for j, rank in zip(r["_js"], r["_ranks"]):
            if rank == r["_at"]:
                by_group[r["_g"]][j] = tuple(r["_cut"])
    cut_rows = [(name, [cuts.get(j) for j in range(len(fractions))]) for name, cuts in by_group.items()]
    return local_side(spark, cut_rows, f"_g string, _cuts array<struct<_k:bigint,_tie:string,_id:{id_type}>>")


def _assign(df: DataFrame, group: str | None, key: str, seed: int | None, cuts: DataFrame, output: str) -> DataFrame:
    """Add ``output``: how many cuts of its group a row lies beyond (an empty part's cut is null: always beyond)."""
    keyed = _order(df.withColumn("_g", _group(group)), key, seed)
    mine = F.struct(F.col("_k"), F.col("_tie"), F.col(key).alias("_id"))
    part = F.size(F.filter("_cuts", lambda cut: cut.isNull() | (mine > cut))).cast("bigint")
    cuts = materialize(cuts, "cuts")
    few = len(cuts.select(F.lit(1)).take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS
    met = keyed.join(F.broadcast(cuts), "_g") if few else match_skewed(keyed, cuts, "_g", "inner")
    return met.select(*named(df.columns), part.alias(output))


def stratified_split(
    df: DataFrame, label: str, test_fraction: float = 0.2, key: str = "doc_id", seed: int = 42,
    output: str = "split", direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Add ``output`` = 'test' or 'train'. ceil(n * fraction) test rows in all, shared over the classes
    in proportion by largest remainder."""

    def plan(classes: DataFrame) -> DataFrame:
        n = int(classes.agg(F.sum("n")).first()[0] or 0)
        return split_quotas(classes, n - math.ceil(n * test_fraction), n)

    cuts = _cuts(df, label, key, seed, plan, [test_fraction], direct_rows)
    part = _assign(df, label, key, seed, cuts, output)
    return part.withColumn(output, F.when(F.col(output) == 0, "test").otherwise("train"))


def random_split(
    df: DataFrame, test_fraction: float = 0.2, key: str = "doc_id", seed: int = 42, output: str = "split",
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Add ``output`` = 'test' (exactly ceil(n * fraction) rows) or 'train', classes ignored."""

    def plan(classes: DataFrame) -> DataFrame:
        return classes.select("_g", "n", F.array(F.ceil(F.col("n") * F.lit(test_fraction)).cast("bigint")).alias("ends"))

    cuts = _cuts(df, None, key, seed, plan, [test_fraction], direct_rows)
    part = _assign(df, None, key, seed, cuts, output)
    return part.withColumn(output, F.when(F.col(output) == 0, "test").otherwise("train"))


def stratified_folds(
    df: DataFrame, label: str, k: int = 3, key: str = "doc_id", seed: int | None = 42, output: str = "fold",
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Add ``output`` = 0..k-1, each class spread evenly. With ``seed=None`` the rows of a class keep
    their key order and the folds are consecutive blocks of it; keys that are no integers are put in a seeded
    hash order instead."""

    cuts = _cuts(df, label, key, seed, lambda classes: fold_quotas(classes, k), [i / k for i in range(1, k)], direct_rows)
    return _assign(df, label, key, seed, cuts, output)


def sample_n(df: DataFrame, n: int, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """A seeded sample of exactly ``n`` rows (all rows if there are fewer): each task keeps its best ``n``."""
    return df.orderBy(seeded_hash(key, seed), key).limit(n)


def sample_per_class(df: DataFrame, label: str, n: int = 2, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """``n`` seeded rows per class. The rank filter is a group limit: a task passes on ``n`` rows per class."""
    return _first_per_class(df, label, n, [seeded_hash(key, seed), F.col(key)])


def head_per_class(df: DataFrame, label: str, n: int = 2, key: str = "doc_id") -> DataFrame:
    """The ``n`` rows of each class with the smallest keys."""
    return _first_per_class(df, label, n, [F.col(key)])


def _first_per_class(df: DataFrame, label: str, n: int, order: list[Column]) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(label).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def top_k(df: DataFrame, by: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The ``k`` rows with the largest ``by``; ``ties`` completes the order."""
    return df.orderBy(F.desc(by), *[F.asc(t) for t in ties]).limit(k)

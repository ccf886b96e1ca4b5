"""Corpus n-grams: a vocabulary of the most frequent ones, fitted once, then counted per document.

Fitting and counting are separate, so documents scored later get the columns of the training corpus.

The most frequent n-grams are found without shuffling every n-gram. A share of the texts names candidates. One pass over all texts
counts the candidates exactly and everything else in hash buckets, whose totals bound the count of any n-gram in them. Buckets that
stay below the k-th candidate are settled; only the n-grams of the others are counted one by one. The buckets are as many
as the share's counts ask for. What is guessed decides the cost, never the result.

Character n-grams come to this already added up over about a million characters, as numbers sorted by numpy: a text has as many of them
as characters, but few different ones. So no string is made of an n-gram before it has been counted.

Counting is a projection over at most ``k`` literals per n-gram size and shuffles nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkprint.functions.names import named
from inkprint.functions import text as tx
from inkprint.storage import BROADCAST_ROWS, local_side, materialize

_BASE = {"char": tx.squeezed, "word": tx.joined_words}
_GRAMS = {"char": tx.char_ngrams, "word": tx.word_ngrams}
_COUNT_BASE = {"char": tx.squeezed, "word": tx.spaced_words}
_COUNT = {"char": tx.count_char_ngram, "word": tx.count_word_ngram}


def ngram_totals(
    df: DataFrame, kinds: Sequence[str] = ("char", "word"), sizes: Sequence[int] = (2, 3), text: str = "text"
) -> DataFrame:
    """(kind, n, gram, total) over the whole corpus, from one scan and one shuffle.

    A gram tells its own kind and size: character n-grams hold no space, word n-grams hold n - 1. Both are
    worked out after the count instead of being carried through it.
    """
    if set(kinds) == {"char", "word"} and min(sizes) < 2:
        raise ValueError("single words cannot be told from character n-grams: count the kinds one at a time")
    base = df.select(*[_BASE[kind](F.col(text)).alias(f"_{kind}") for kind in kinds])
    grams = [_GRAMS[kind](F.col(f"_{kind}"), n) for kind in kinds for n in sizes]
    totals = base.select(F.explode(F.concat(*grams)).alias("gram")).groupBy("gram").agg(F.count("*").alias("total"))
    spaces = tx.count_char(F.col("gram"), " ")
    is_word = (spaces > 0) if len(kinds) > 1 else F.lit(kinds[0] == "word")
    return totals.select(
        F.when(is_word, "word").otherwise("char").alias("kind"),
        F.when(is_word, spaces + 1).otherwise(F.length("gram")).cast("bigint").alias("n"),
        "gram", "total",
    )


#: Share of the texts that candidates come from, and how many candidates there are for each n-gram to be found.
HINT_SHARE, HINTS = 0.02, 8
#: Fewest and most hash buckets per kind and size; buckets whose n-grams are counted by a look-up in a broadcast table.
BUCKETS = (1 << 12, 1 << 22)


#: Characters that are counted at once, and the longest character n-grams whose code points fit one number.
CHUNK, PACKED = 1 << 20, 3
_BITS = 21


def _packed_counts(points: np.ndarray, ends: np.ndarray, n: int) -> tuple[list[str], np.ndarray]:
    """Different n-grams of the texts that are joined in ``points`` and end at ``ends``, and how often they come."""
    if len(points) < n:
        return [], np.zeros(0, dtype=np.int64)
    codes = np.zeros(len(points) - n + 1, dtype=np.int64)
    for i in range(n):
        codes = (codes << _BITS) | points[i:len(points) - n + 1 + i]
    inside = np.ones(len(codes), dtype=bool)
    for i in range(1, n):
        # Started fewer than n characters before a text's end, an n-gram would reach into the next text.
        starts = ends - i
        inside[starts[(starts >= 0) & (starts < len(codes))]] = False
    found, counts = np.unique(codes[inside], return_counts=True)
    letters = np.stack([(found >> (_BITS * (n - 1 - i))) & ((1 << _BITS) - 1) for i in range(n)], axis=1).astype("<u4")
    joined = letters.tobytes().decode("utf-32-le", "replace")
    return [joined[i:i + n] for i in range(0, len(joined), n)], counts


def _char_grams(squeezed: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(g, gram, n) of one column of squeezed texts: character n-grams of the sizes of all groups, counted per chunk of texts."""

    def counted(texts: list[str]) -> Iterator[pa.RecordBatch]:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
        ends = np.cumsum([len(t) for t in texts])
        for g, size in sizes.items():
            grams, counts = _packed_counts(points, ends, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(grams), g, dtype=np.int32)), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], ["g", "gram", "n"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held = [], 0
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()):
                text = (value.as_py() or b"").decode("utf-8", "replace")
                texts.append(text)
                held += len(text)
                if held >= CHUNK:
                    yield from counted(texts)
                    texts, held = [], 0
        if texts:
            yield from counted(texts)

    return squeezed.mapInArrow(run, "g int, gram string, n bigint")


def _grouped_grams(df: DataFrame, groups: Sequence[tuple[str, int]], text: str, only: Sequence[int] | None = None) -> DataFrame:
    """(g, gram, n) for the n-grams of the corpus; ``g`` is the place of its kind and size in ``groups``. An n-gram may have several
    rows, whose ``n`` add up to its count. ``only`` names the groups wanted."""
    wanted = [(g, kind, n) for g, (kind, n) in enumerate(groups) if only is None or g in only]
    packed = {g: n for g, kind, n in wanted if kind == "char" and 1 <= n <= PACKED}
    others = [(g, kind, n) for g, kind, n in wanted if g not in packed]
    parts = []
    if packed:
        parts.append(_char_grams(df.select(_BASE["char"](F.col(text)).alias("_char")), packed))
    if others:
        base = df.select(*[_BASE[kind](F.col(text)).alias(f"_{kind}") for kind in sorted({kind for _, kind, _ in others})])
        none = F.array().cast("array<string>")
        by_group = {g: _GRAMS[kind](F.col(f"_{kind}"), n) for g, kind, n in others}
        arrays = F.array(*[by_group.get(g, none) for g in range(len(groups))])
        grams = base.select(F.posexplode(arrays).alias("g", "_grams")).select("g", F.explode("_grams").alias("gram"))
        parts.append(grams.withColumn("n", F.lit(1).cast("bigint")))
    return functools.reduce(DataFrame.unionByName, parts)


def _hints(df: DataFrame, groups: Sequence[tuple[str, int]], k: int, text: str, share: float) -> tuple[dict[int, list[str]], dict[int, int]]:
    """Candidates per group from a share of the texts, and how many buckets separate the k-th of them from the rest."""
    counted = materialize(_grouped_grams(df.sample(share, 42), groups, text).groupBy("g", "gram").agg(F.sum("n").alias("n")), "hints")
    order = Window.partitionBy("g").orderBy(F.desc("n"), F.asc("gram"))
    whole = Window.partitionBy("g")
    ranked = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= HINTS * k)
    totals = {r["g"]: r["n"] for r in counted.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    hints: dict[int, list[str]] = {g: [] for g in range(len(groups))}
    buckets = dict.fromkeys(hints, BUCKETS[0])
    for r in ranked.withColumn("last", F.max("rank").over(whole)).collect():
        hints[r["g"]].append(r["gram"])
        if r["rank"] == min(k, r["last"]):
            wanted = 8 * totals[r["g"]] / r["n"]
            buckets[r["g"]] = min(max(1 << int(wanted).bit_length(), BUCKETS[0]), BUCKETS[1])
    return hints, buckets


def bucketed_totals(grams: DataFrame, hints: dict[int, list[str]], buckets: dict[int, int]) -> DataFrame:
    """(g, gram, bucket, total) of ``_grouped_grams`` output: exact totals of the hinted n-grams (bucket null), and of everything else by hash bucket (gram null).

    The shuffle carries one row per bucket and task at most, however many different n-grams there are.
    """
    hinted = F.lit(False)
    sizes = F.lit(BUCKETS[0])
    for g, found in hints.items():
        if found:
            hinted = hinted | ((F.col("g") == g) & F.col("gram").isin(found))
        sizes = F.when(F.col("g") == g, buckets[g]).otherwise(sizes)
    marked = grams.select("g", "n", F.when(hinted, F.col("gram")).alias("own"), _bucket(sizes).alias("at"))
    keyed = marked.select("g", "n", F.col("own").alias("gram"), F.when(F.col("own").isNull(), F.col("at")).alias("bucket"))
    return keyed.groupBy("g", "gram", "bucket").agg(F.sum("n").alias("total"))


def _bucket(sizes: Column) -> Column:
    return F.pmod(F.xxhash64("gram"), sizes).cast("int")


def top_ngrams(
    df: DataFrame, kinds: Sequence[str] = ("char", "word"), sizes: Sequence[int] = (2, 3), k: int = 5,
    text: str = "text", share: float = HINT_SHARE,
) -> DataFrame:
    """(kind, n, gram, total, rank): the ``k`` most frequent n-grams per kind and size; ties go to the gram that sorts first.

    Exact on any corpus. An n-gram that is no candidate has at most its bucket's total, so a bucket below the k-th candidate holds
    none of the wanted; with fewer than ``k`` candidates every bucket stays open.
    """
    spark = df.sparkSession
    groups = [(kind, n) for kind in kinds for n in sizes]
    hints, buckets = _hints(df, groups, k, text, share)
    totals = materialize(bucketed_totals(_grouped_grams(df, groups, text), hints, buckets), "ngram-buckets")
    found = totals.filter("gram is not null").select("g", "gram", "total")
    order = Window.partitionBy("g").orderBy(F.desc("total"), F.asc("gram"))
    ranked = found.withColumn("rank", F.row_number().over(order))
    kth = dict.fromkeys(range(len(groups)), 1) | {r["g"]: r["total"] for r in ranked.filter(F.col("rank") == k).collect()}
    least = F.lit(1)
    for g, total in kth.items():
        least = F.when(F.col("g") == g, total).otherwise(least)
    still_open = totals.filter("gram is null").filter(F.col("total") >= least).select("g", "bucket")
    # The texts are read again for the kinds and sizes that have open buckets, and for no others.
    per_group = {r["g"]: r["n"] for r in still_open.groupBy("g").agg(F.count("*").alias("n")).collect()}
    n_open = sum(per_group.values())
    if n_open:
        sizes_of = F.lit(BUCKETS[0])
        for g, n in buckets.items():
            sizes_of = F.when(F.col("g") == g, n).otherwise(sizes_of)
        rest = _grouped_grams(df, groups, text, sorted(per_group)).withColumn("bucket", _bucket(sizes_of))
        if n_open <= BROADCAST_ROWS:
            rest = rest.join(F.broadcast(still_open), ["g", "bucket"], "left_semi")
        counted = rest.groupBy("g", "gram").agg(F.sum("n").alias("total"))
        found = found.unionByName(counted.join(F.broadcast(found.select("g", "gram")), ["g", "gram"], "left_anti"))
    names = local_side(spark, [(i, kind, n) for i, (kind, n) in enumerate(groups)], "g int, kind string, n bigint")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)
    return ranked.join(names, "g").select("kind", "n", "gram", "total", "rank")


@dataclass(frozen=True)
class NgramVocabulary:
    """A fitted list of (kind, n, gram)."""

    grams: tuple[tuple[str, int, str], ...]

    @classmethod
    def fit(
        cls, df: DataFrame, kinds: Sequence[str] = ("char", "word"), sizes: Sequence[int] = (2, 3), k: int = 5,
        text: str = "text",
    ) -> NgramVocabulary:
        rows = top_ngrams(df, kinds, sizes, k, text).collect()
        rows.sort(key=lambda r: (kinds.index(r["kind"]), r["n"], r["rank"]))
        return cls(tuple((r["kind"], r["n"], r["gram"]) for r in rows))

    def column_names(self) -> list[str]:
        return [
            f"{kind}_{n}gram_{gram.replace(' ', '_') if kind == 'word' else gram}" for kind, n, gram in self.grams
        ]

    def _counts(self, df: DataFrame, text: str) -> tuple[DataFrame, list[Column]]:
        kinds = sorted({kind for kind, _, _ in self.grams})
        base = df.withColumns({f"_{kind}_base": _COUNT_BASE[kind](F.coalesce(F.col(text), F.lit(""))) for kind in kinds})
        return base, [_COUNT[kind](F.col(f"_{kind}_base"), gram) for kind, _, gram in self.grams]

    def transform(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with one count column per n-gram."""
        base, counts = self._counts(df, text)
        return base.select(*named(df.columns), *[c.alias(name) for c, name in zip(counts, self.column_names())])

    def transform_long(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, kind, n, gram, count), zero counts kept."""
        base, counts = self._counts(df, text)
        entries = [
            F.struct(
                F.lit(kind).alias("kind"), F.lit(n).cast("bigint").alias("n"), F.lit(gram).alias("gram"),
                count.alias("count"),
            )
            for (kind, n, gram), count in zip(self.grams, counts)
        ]
        return base.select(key, F.explode(F.array(*entries)).alias("e")).select(key, "e.*")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, kind, n, gram) for i, (kind, n, gram) in enumerate(self.grams)]
        spark.createDataFrame(rows, "pos int, kind string, n int, gram string").coalesce(1).write.mode(
            "overwrite"
        ).parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NgramVocabulary:
        rows = spark.read.parquet(path).orderBy("pos").collect()
        return cls(tuple((r["kind"], r["n"], r["gram"]) for r in rows))

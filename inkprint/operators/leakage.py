"""Train/test leak checks on text hashes.

Texts are read once, to write their MD5 beside the key and the split; all decisions are made on that narrow table. A Bloom filter
of the train hashes lets through the test rows that may have leaked, usually few, and only their hashes are looked for in train
exactly. Copies of one text collapse in partial aggregation, and a hash that very many rows share is matched by broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprint.functions.names import quoted
from inkprint.storage import BROADCAST_ROWS, match_skewed, materialize

#: Bits of a filter per hash, positions per hash, and the size beyond which a filter grows no more but lets more through.
BITS_PER_HASH, POSITIONS, MOST_BITS = 10, 4, 1 << 30
#: Bits that Spark's bitmap functions hold in one bitmap.
BITMAP_BITS = 32_768


@dataclass(frozen=True)
class BloomFilter:
    """A bit array that knows which values it has certainly not seen."""

    bits: np.ndarray
    size: int

    @staticmethod
    def positions(value: Column, size: int) -> list[Column]:
        """Bit positions of a value, from 0."""
        return [F.pmod(F.xxhash64(F.lit(i), value), F.lit(size)) for i in range(POSITIONS)]

    @classmethod
    def build(cls, df: DataFrame, column: str) -> BloomFilter:
        """A filter of a column's values. Tasks set bits in bitmaps, which are merged before and after the shuffle: what reaches
        the driver is the filter itself, of a size that follows the number of rows up to MOST_BITS."""
        rows = df.count()
        size = min(MOST_BITS, max(BITMAP_BITS, 1 << (rows * BITS_PER_HASH).bit_length()))
        # Spark numbers bits and bitmaps from 1.
        places = df.select(F.explode(F.array(*[p + 1 for p in cls.positions(F.col(column), size)])).alias("p"))
        maps = places.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("map"))
        bits = np.zeros(size // 8, np.uint8)
        for r in maps.toLocalIterator():
            at = (r["bucket"] - 1) * BITMAP_BITS // 8
            bits[at:at + BITMAP_BITS // 8] = np.frombuffer(bytes(r["map"]), np.uint8)
        return cls(bits, size)

    def may_hold(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of ``df`` whose value may be among those seen; rows that are left out certainly are not."""
        shared = df.sparkSession.sparkContext.broadcast(self.bits)
        at = self.positions(F.col(column), self.size)
        wide = df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("_row"), *[p.alias(f"_{i}") for i, p in enumerate(at)])

        def run(batches):
            for batch in batches:
                known = np.ones(batch.num_rows, bool)
                for i in range(POSITIONS):
                    p = batch.column(i + 1).to_numpy()
                    known &= (shared.value[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
                yield pa.RecordBatch.from_arrays([batch.column(0)], names=["_row"]).filter(pa.array(known))

        return wide.mapInArrow(run, T.StructType([wide.schema["_row"]])).select("_row.*")


def text_hashes(df: DataFrame, text: str = "text", split: str = "split") -> DataFrame:
    """One row per distinct text: ``hash``, ``in_train``, ``in_test``."""
    hashed = df.select(F.md5(text).alias("hash"), F.col(split).alias("s"))
    return hashed.groupBy("hash").agg(
        F.bool_or(F.col("s") == "train").alias("in_train"), F.bool_or(F.col("s") == "test").alias("in_test")
    )


def overlap_summary(df: DataFrame, text: str = "text", split: str = "split") -> DataFrame:
    """Distinct texts in train, in test and in both: one row."""
    return text_hashes(df, text, split).agg(
        F.count_if("in_train").alias("train_hashes"),
        F.count_if("in_test").alias("test_hashes"),
        F.count_if(F.col("in_train") & F.col("in_test")).alias("shared_hashes"),
    )


def hashed_rows(df: DataFrame, key: str, text: str, split: str, keep: list[str]) -> DataFrame:
    """(key, split, keep, hash) of every row, written once: the only pass over the texts."""
    columns = list(dict.fromkeys([key, split, *keep]))
    return materialize(df.select(*[F.col(quoted(c)) for c in columns], F.md5(text).alias("hash")), "hashed")


def shared_hashes(rows: DataFrame, split: str = "split") -> DataFrame:
    """The hashes that test rows and train rows of ``rows`` have in common, one row each."""
    train, test = (rows.filter(F.col(split) == part).select("hash").filter("hash is not null") for part in ("train", "test"))
    suspects = materialize(BloomFilter.build(train, "hash").may_hold(test, "hash").distinct(), "suspects")
    if len(suspects.select(F.lit(1)).take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS:
        return train.join(F.broadcast(suspects), "hash", "left_semi").distinct()
    return train.distinct().join(suspects, "hash", "left_semi")


def _test_rows(df: DataFrame, how: str, key: str, text: str, split: str, keep: list[str] | None) -> DataFrame:
    narrow = [c for c in df.columns if c not in (text, "hash")] if keep is None else keep
    rows = hashed_rows(df, key, text, split, narrow)
    shared = materialize(shared_hashes(rows, split), "shared")
    return match_skewed(rows.filter(F.col(split) == "test"), shared, "hash", how)


def leaked_rows(
    df: DataFrame, key: str = "doc_id", text: str = "text", split: str = "split", keep: list[str] | None = None
) -> DataFrame:
    """Test rows whose text also occurs in train, as key, split, the columns ``keep`` (all but the text) and hash."""
    return _test_rows(df, "left_semi", key, text, split, keep)


def clean_rows(
    df: DataFrame, key: str = "doc_id", text: str = "text", split: str = "split", keep: list[str] | None = None
) -> DataFrame:
    """Test rows whose text does not occur in train, with the columns of ``leaked_rows``."""
    return _test_rows(df, "left_anti", key, text, split, keep)


def leak_examples(df: DataFrame, n: int = 5, key: str = "doc_id", text: str = "text", split: str = "split") -> DataFrame:
    """The first ``n`` distinct leaked texts in text order. Texts are fetched for one row of each leaked hash, by key."""
    leaked = leaked_rows(df, key, text, split, keep=[])
    chosen = materialize(leaked.groupBy("hash").agg(F.min(key).alias(key)), "examples")
    few = len(chosen.select(F.lit(1)).take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS
    texts = df.filter(F.col(split) == "test").select(key, text).join(F.broadcast(chosen) if few else chosen, key)
    # Rows that share a key may differ in text: only the one that was hashed counts.
    return texts.filter(F.md5(text) == F.col("hash")).select("hash", text).orderBy(text).limit(n)

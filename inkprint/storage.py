"""Where intermediate tables go, and how small side tables are joined.

Two rules live here so that no operator has to repeat them:

* A plan that several later jobs read (model fits, folds) is written once as a parquet table in the
  shared folder named by ``spark.checkpoint.dir``. A lost executor then costs a re-read, not a
  recomputation of the text features, and no block lives only on one executor's disk.
* A side table is broadcast only after its row count has been checked. Over the limit it stays a
  distributed table and the join shuffles, so the result is the same either way.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, read from the session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: intermediate tables need a folder every executor can read"
        )
    if context.applicationId not in _local_scratch:
        _local_scratch[context.applicationId] = tempfile.mkdtemp(prefix="inkprint-")
    return _local_scratch[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and return the written table, which has no lineage back to the text."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def set_checkpoints(spark: SparkSession) -> None:
    """Make sure that iterative fits can cut their lineage: the cluster's checkpoint folder, or one in the scratch folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{scratch_root(spark)}/checkpoints")


BROADCAST_ROWS = 100_000


def local_side(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A side table from rows the driver already holds, broadcast if there are few enough."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def match_rows(
    left: DataFrame, right: DataFrame, key: str, how: str, spread_by: str, max_rows: int = BROADCAST_ROWS,
    salts: int = 16,
) -> DataFrame:
    """Equi-join on ``key`` where one value of ``left[key]`` may hold a large share of the rows.

    ``right`` has one row per key. With at most ``max_rows`` rows (checked) it is broadcast and the left
    rows stay where they are. Otherwise left rows get one of ``salts`` salts and right rows are repeated
    once per salt, so a hot key is spread over that many tasks. Every left row still meets every right
    row of its key exactly once, so semi, anti, inner and left joins all keep their meaning.
    """
    if len(right.select(F.lit(1)).take(max_rows + 1)) <= max_rows:
        return left.join(F.broadcast(right), key, how)
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")


#: A key held by more than one row in so many is heavy. There are fewer such keys than this, whatever the table's size.
HEAVY_SHARE = 1000


def match_skewed(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Equi-join on ``key`` where a few values of ``left[key]`` may hold most rows; ``right`` has one row per key, in any number.

    Keys of ``left`` are counted first. The rows of heavy keys, of which there are fewer than HEAVY_SHARE by their very
    definition, meet their row of ``right`` by broadcast and stay where they are; the others are joined by a shuffle in which no key is large.
    ``how`` is inner, left, left_semi or left_anti. ``left`` is read twice, so give a written table.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    heavy = materialize(counts.where(F.col("_n") * HEAVY_SHARE > total).select(key), "heavy")
    if heavy.isEmpty():
        return left.join(right, key, how)
    rest = left.join(F.broadcast(heavy), key, "left_anti").join(right, key, how)
    met = left.join(F.broadcast(heavy), key, "left_semi").join(F.broadcast(right.join(F.broadcast(heavy), key, "left_semi")), key, how)
    return rest.unionByName(met)

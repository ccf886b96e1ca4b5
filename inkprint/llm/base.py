"""What the operators of this package share: table access, Arrow row functions, model averaging, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkprint.storage import materialize

#: The six ASCII white-space characters that end a word.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 byte strings, without decoding them."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: Largest Arrow batch. Each running task holds copies of one on both sides of its socket, and texts may be long.
BATCH_BYTES = "8m"
#: Rows handled together by a row function; texts may be long, so an Arrow batch is taken in slices.
SLICE_ROWS = 512


def map_rows(
    df: DataFrame, function: Callable[[pa.RecordBatch], dict[str, Iterable]], schema: str | StructType, rows: int = SLICE_ROWS,
) -> DataFrame:
    """Apply ``function`` to slices of at most ``rows`` rows; it returns one sequence per output column.

    Sets the session's Arrow batch size, in bytes, for what is run from now on.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    target = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                columns = function(batch.slice(start, rows))
                yield pa.RecordBatch.from_arrays(
                    [_array(columns[f.name], f.type) for f in target], schema=target,
                )

    target = arrow_schema(df.sparkSession, schema)
    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def arrow_schema(spark: SparkSession, schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, root) per node with an edge, root = smallest node.

    Alternates the large-star and small-star steps: each links neighbours to the smallest node seen, so the edge
    set shrinks towards one star per component in a number of rounds that grows with the logarithm of its size. Each
    round is written to the shared folder, so a lost executor never costs an earlier round. A node with very
    many neighbours meets its minimum through partial aggregation and a join that Spark may split.
    Null ends and self-links are ignored; repeated links count once.
    """
    current = materialize(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges",
    )
    before = None
    for _ in range(rounds):
        after = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after[0] == 0 or after == before:
            break
        before = after
        current = materialize(_small_star(_large_star(current)), "edges")
    else:
        raise RuntimeError("components did not settle; raise rounds")
    members = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
    linked = both.where("b > a").join(least, F.col("a") == F.col("u"))
    return linked.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    linked = edges.join(least, F.col("a") == F.col("u"))
    moved = linked.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()

"""Exact top-k search by inner product over vectors grouped by length.

Vectors are sorted by length and cut into buckets. A query needs a score of at least its threshold, that is, a cosine of at
least ``threshold / (its length * the longest vector of the bucket)``. Above 1 the bucket is skipped. Otherwise one of
two prunings picks the candidates of the bucket: by length, the prefix of vectors long enough to reach the
threshold; or, where the local cosine threshold is high, by coordinate, the vectors whose value in the query's strongest
coordinate lies in the range that such a cosine allows. The products of what is left are computed exactly.

Thresholds come from a first round against the longest vectors: the k-th best score there is a lower bound of the final one.
Queries are handled in blocks against buckets; blocks of queries are dealt over slots, so no task sees all of either side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.llm.base import arrow_schema
from inkprint.storage import materialize

#: Vectors in a bucket, queries in a block, buckets of longest vectors that give the first thresholds.
BUCKET, QUERIES, HEAD = 1024, 512, 2
#: From this local cosine threshold on, a bucket is pruned by coordinate.
BY_COORDINATE = 0.4
#: Slack for rounding in the prunings; products are exact.
SLACK = 1e-9

BLOCK = "block bigint, dim int, longest double, ids binary, vectors binary"


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


def finite(vector: Column) -> Column:
    """True for vectors without null and non-finite components; false for a null vector."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows (vec_id, v array<bigint>) packed into blocks of ``size`` vectors of one dimension and similar length, longest first.

    Rows are dealt out by ranges of (dimension, length, id), so that many vectors of one length are split as well.
    """
    spark = vectors.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = vectors.select("vec_id", "v", F.size("v").alias("dim"), F.sqrt(square).alias("length"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, "dim", F.desc("length"), "vec_id").sortWithinPartitions("dim", F.desc("length"), "vec_id")
    target = arrow_schema(spark, BLOCK)

    def run(batches):
        held_ids, held, at, made = [], [], None, 0

        def out():
            nonlocal made
            matrix = np.array(held, np.int64).reshape(len(held), at)
            longest = float(np.sqrt((matrix[0].astype(np.float64) ** 2).sum()))
            row = [[made], [at], [longest], [np.array(held_ids, np.int64).tobytes()], [matrix.tobytes()]]
            made += 1
            held_ids.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, target)], schema=target)

        for batch in batches:
            ids, vectors_, dims = (batch.column(i).to_pylist() for i in range(3))
            for vec_id, vector, dim in zip(ids, vectors_, dims):
                if held and (dim != at or len(held) == size):
                    yield out()
                at = dim
                held_ids.append(vec_id)
                held.append(vector)
        if held:
            yield out()

    packed = dealt.mapInArrow(run, BLOCK)
    return packed.withColumn("block", F.xxhash64("ids", "block"))


def _matrix(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, np.int64)
    return keys, np.frombuffer(vectors, np.int64).reshape(len(keys), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows; by floating point where no sum can leave the integers it holds exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def search_bucket(
    query_ids: np.ndarray, queries: np.ndarray, needs: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of the k best of a bucket for each query, among scores of at least its need.

    Vectors are in order of length, longest first. ``needs`` may hold -inf. Ties go to the smaller id.
    """
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    strengths = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    reach = strengths * lengths[0]
    live = needs <= reach * (1 + SLACK) + SLACK
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(needs <= 0, 0.0, needs / reach)
    by_coordinate = live & (cosine >= BY_COORDINATE) & (lengths[-1] > 0)
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    by_length = np.flatnonzero(live & ~by_coordinate)
    if len(by_length):
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(needs[by_length] > 0, needs[by_length] / strengths[by_length], 0.0).min()
        prefix = int(np.searchsorted(-lengths, -least * (1 - SLACK) + SLACK, side="right"))
        scores = products(queries[by_length], vectors[:prefix])
        row, column = np.nonzero(scores >= needs[by_length][:, None])
        hits.append((by_length[row], column, scores[row, column]))

    if by_coordinate.any():
        unit = vectors / lengths[:, None]
        for q in np.flatnonzero(by_coordinate):
            direction = queries[q] / strengths[q]
            focus = int(np.abs(direction).argmax())
            t, x = min(1.0, cosine[q]), direction[focus]
            width = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + SLACK
            value = unit[:, focus]
            near = value >= x * t - width if x >= 0 else value <= x * t + width
            near &= lengths * strengths[q] >= needs[q] * (1 - SLACK) - SLACK
            chosen = np.flatnonzero(near)
            scores = products(queries[q:q + 1], vectors[chosen])[0]
            good = scores >= needs[q]
            hits.append((np.full(good.sum(), q), chosen[good], scores[good]))

    if not hits:
        return (np.zeros(0, np.int64),) * 3
    row, column, score = (np.concatenate(x) for x in zip(*hits))
    other = ids[column] != query_ids[row]
    row, column, score = row[other], ids[column[other]], score[other]
    order = np.lexsort((column, -score, row))
    row, column, score = row[order], column[order], score[order]
    start = np.searchsorted(row, row, side="left")
    first = np.arange(len(row)) - start < k
    return query_ids[row[first]], column[first], score[first]


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """Rows (dim, ids, vectors, query_ids, queries, needs) to the best of each bucket for each query."""
    schema = "query_id bigint, vec_id bigint, score bigint"
    target = arrow_schema(pairs.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, vectors, query_ids, queries, needs = (batch.column(c)[i].as_py() for c in range(6))
                found = search_bucket(
                    *_matrix(query_ids, queries, dim), np.frombuffer(needs, np.float64), *_matrix(ids, vectors, dim), k,
                )
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], schema=target)

    return pairs.select("dim", "ids", "vectors", "query_ids", "queries", "needs").mapInArrow(run, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, slots: int = 32) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every query row, by integer inner product of quantised vectors.

    ``vectors`` has vec_id and embedding. Vectors that are null or hold null or non-finite components, and rows without id, take
    no part. A query meets all rows of its own dimension but those with its own id; fewer than k give fewer ranks.
    Equal scores are ranked by smaller id. Repeated ids are separate candidates; as queries they count once.
    """
    valid = vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
    rows = valid.select("vec_id", quantised(F.col("embedding")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    buckets = materialize(blocks(rows.select("vec_id", "v"), BUCKET), "buckets")
    queries = blocks(rows.where("is_query").dropDuplicates(["vec_id"]).select("vec_id", "v"), QUERIES)
    queries = materialize(queries.select("dim", F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries")), "queries")

    longest = Window.partitionBy("dim").orderBy(F.desc("longest"), "block")
    head = buckets.select("dim", "block", "longest").withColumn("_n", F.row_number().over(longest)).where(f"_n <= {HEAD}")
    head = buckets.join(head.select("block"), "block", "left_semi")
    nothing = F.udf(lambda ids: np.full(len(ids) // 8, -np.inf).tobytes(), "binary", useArrow=True)
    first = _search(queries.withColumn("needs", nothing("query_ids")).join(head, "dim"), k)
    bound = _best(first, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("bound")).where(f"n = {k}")
    bound = materialize(bound.select("query_id", "bound"), "bounds")
    needed = materialize(_with_needs(queries, bound), "needed")

    dealt = needed.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    slotted = buckets.withColumn("slot", F.pmod("block", F.lit(slots)).cast("int"))
    pairs = slotted.join(dealt, ["dim", "slot"]).where("longest >= least_length")
    found = _best(_search(pairs, k), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _with_needs(queries: DataFrame, bound: DataFrame) -> DataFrame:
    """Query blocks with the score that each query needs, and the least vector length with which any can reach it."""
    schema = "dim int, query_block bigint, query_ids binary, queries binary, needs binary, least_length double"
    target = arrow_schema(queries.sparkSession, schema)
    keys = F.udf(lambda ids: np.frombuffer(ids, np.int64).tolist(), "array<bigint>", useArrow=True)
    pairs = queries.select("query_block", F.explode(keys("query_ids")).alias("query_id")).join(bound, "query_id")
    bounds = pairs.groupBy("query_block").agg(F.collect_list(F.struct("query_id", "bound")).alias("bounds"))

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                ids, matrix = _matrix(row["query_ids"], row["queries"], row["dim"])
                known = {b["query_id"]: b["bound"] for b in row["bounds"] or []}
                needs = np.array([known.get(i, -np.inf) for i in ids.tolist()], np.float64)
                strengths = np.sqrt((matrix.astype(np.float64) ** 2).sum(1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where(needs > 0, needs / strengths, 0.0)
                rows.append((row["dim"], row["query_block"], row["query_ids"], row["queries"], needs.tobytes(), float(least.min()) * (1 - SLACK) - SLACK))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    joined = queries.join(bounds, "query_block", "left")
    return joined.mapInArrow(run, schema)

"""Embedding vectors: computing, pooling, naming and joining them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprint.functions.names import quoted
from inkprint.functions.text import ratio
from inkprint.operators.sampling import sample_n
from inkprint.storage import scratch_path


def hashed_trigram_encoder(dim: int = 64) -> Callable:
    """A stand-in encoder that needs no weights: hashed character trigrams of the whole text, unit length.

    Returned in the form ``predict_batch_udf`` wants, a function that makes the predict function. A real
    encoder loads its weights in the outer function, once per Python worker.
    """

    def make_predict():
        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for i, text in enumerate(texts):
                codes = np.frombuffer((text or "").lower().encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
                if len(codes) >= 3:
                    mixed = (codes[:-2] * 2654435761 + codes[1:-1] * 40503 + codes[2:] * 97) % 4294967291
                    out[i] = np.bincount((mixed % dim).astype(np.int64), minlength=dim)
                    out[i] /= max(float(np.linalg.norm(out[i])), 1e-12)
            return out

        return predict

    return make_predict


def embed_documents(
    df: DataFrame, make_predict: Callable, text: str = "text", output: str = "embedding", batch_size: int = 64
) -> DataFrame:
    """``df`` with an ``array<float>`` column from a text encoder, applied in Arrow batches.

    Each Python worker builds the encoder once. Texts reach it whole; an encoder with a context limit
    splits or truncates by itself.
    """
    encode = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(output, encode(F.coalesce(F.col(text), F.lit(""))))


def embed_sample(
    df: DataFrame, make_predict: Callable, n: int = 100, key: str = "doc_id", seed: int = 42, text: str = "text"
) -> DataFrame:
    """Embeddings of a seeded sample of ``n`` documents; keys are sampled before any text is read."""
    chosen = sample_n(df.select(key), n, key, seed)
    return embed_documents(df.join(chosen, key, "left_semi"), make_predict, text)


#: Tokens that an encoder sees of a text, those of begin and end included.
TOKEN_LIMIT = 512
POOLINGS = ("first", "last", "mean")
_PRIME = 4294967291


def hashed_word_tokens(dim: int = 16, limit: int | None = TOKEN_LIMIT) -> Callable:
    """A stand-in token encoder that needs no weights: one vector per word from a hash of its characters, between a begin token
    that depends on all words and an end token that depends on the last.

    Returned in the form ``token_table`` wants: a function, called once per Python worker, that makes the encode function. That
    one takes texts and gives (mask, vectors) for each. ``limit`` bounds the tokens, begin and end included; None takes all words.
    """

    def code(word: str) -> int:
        out = 0
        for c in word:
            out = (out * 31 + ord(c)) % _PRIME
        return out

    def make_encode():
        at = np.arange(dim, dtype=np.int64)

        def encode(texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
            out = []
            for text in texts:
                words = text.split()
                words = words if limit is None else words[:max(0, limit - 2)]
                codes = [code(w) for w in words]
                codes = np.array([sum(codes) % _PRIME, *codes, ((codes[-1] if codes else 0) * 7 + 3) % _PRIME], np.int64)
                vectors = (codes[:, None] * (at + 1) + at * at * 97) % 2039 / 1024 - 1
                out.append((np.ones(len(codes), np.int32), vectors.astype(np.float32)))
            return out

        return encode

    return make_encode


def _encoded(make_encode: Callable, finish: Callable, batch_size: int) -> Callable:
    """An Arrow function that encodes texts in batches of at most ``batch_size`` and hands keys and results to ``finish``."""

    def run(batches):
        encode = make_encode()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start in range(0, len(texts), batch_size):
                yield finish(batch.column(0).slice(start, batch_size), encode(texts[start:start + batch_size]))

    return run


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))


def token_table(df: DataFrame, make_encode: Callable, key: str = "doc_id", text: str = "text", batch_size: int = 16) -> DataFrame:
    """(key, pos, mask, vec): one row per token of every text, as its encoder gives them; null texts count as empty.

    A map over Arrow batches: the rows of a text stay in the task that encoded it, and few texts are in memory at a time. Feeds
    ``pool_first``, ``pool_last`` and ``pool_mean``, each of which reduces a text inside its task before anything is shuffled.
    """

    def finish(keys: pa.Array, found: list) -> pa.RecordBatch:
        counts = [len(mask) for mask, _ in found]
        vectors = [v for _, v in found]
        columns = [
            keys.take(pa.array(np.repeat(np.arange(len(found)), counts))),
            pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in counts])),
            pa.array(np.concatenate([mask for mask, _ in found]).astype(np.int32)), _lists(np.concatenate(vectors).astype(np.float32)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[key, "pos", "mask", "vec"])

    schema = T.StructType([
        df.schema[key], T.StructField("pos", T.IntegerType()), T.StructField("mask", T.IntegerType()),
        T.StructField("vec", T.ArrayType(T.FloatType())),
    ])
    return df.select(quoted(key), quoted(text)).mapInArrow(_encoded(make_encode, finish, batch_size), schema)


def embed_pooled(
    df: DataFrame, make_encode: Callable, poolings: Sequence[str] = POOLINGS, key: str = "doc_id", text: str = "text",
    batch_size: int = 16,
) -> DataFrame:
    """(key, one array<double> column per pooling): each text's token vectors are pooled in the task that encoded them.

    The same numbers as ``token_table`` and the poolers give, without a row per token and without a shuffle.
    """
    pool = {
        "first": lambda mask, v: v[0], "last": lambda mask, v: v[-1],
        "mean": lambda mask, v: (v.astype(np.float64) * mask[:, None]).sum(0) / max(1, mask.sum()),
    }
    if unknown := set(poolings) - set(pool):
        raise ValueError(f"unknown pooling: {sorted(unknown)}")

    def finish(keys: pa.Array, found: list) -> pa.RecordBatch:
        columns = [_lists(np.array([pool[p](mask, v) for mask, v in found], np.float64)) for p in poolings]
        return pa.RecordBatch.from_arrays([keys, *columns], names=[key, *poolings])

    schema = T.StructType([df.schema[key], *[T.StructField(p, T.ArrayType(T.DoubleType())) for p in poolings]])
    return df.select(quoted(key), quoted(text)).mapInArrow(_encoded(make_encode, finish, batch_size), schema)


def pool_first(tokens: DataFrame, doc: str = "doc", pos: str = "pos", vec: str = "vec", size: int | None = None) -> DataFrame:
    """The vector of the first token of each document. ``size`` is the vectors' length, if it is known."""
    return _pool_end(tokens, F.min_by, doc, pos, vec, size)


def pool_last(tokens: DataFrame, doc: str = "doc", pos: str = "pos", vec: str = "vec", size: int | None = None) -> DataFrame:
    """The vector of the last token of each document. ``size`` is the vectors' length, if it is known."""
    return _pool_end(tokens, F.max_by, doc, pos, vec, size)


def _pool_end(tokens: DataFrame, end: Callable, doc: str, pos: str, vec: str, size: int | None) -> DataFrame:
    """The vector that ``end`` picks by position. An aggregate that holds an array makes Spark sort all tokens first, in every task;
    with ``size`` the entries are held as that many columns, which a hash aggregate reduces in place. A vector of another length is an error."""
    if size is None:
        return tokens.groupBy(doc).agg(end(vec, pos).alias(vec))
    checked = F.when(F.size(vec) != size, F.raise_error(F.lit(f"a vector does not have {size} entries"))).otherwise(F.size(vec) == size)
    entries = [end(F.get(vec, F.lit(i)), pos).alias(f"_e{i}") for i in range(size)]
    picked = tokens.withColumn("_whole", checked).groupBy(doc).agg(end("_whole", pos).alias("_whole"), *entries)
    return picked.select(doc, F.when(F.col("_whole"), F.array(*[f"_e{i}" for i in range(size)])).alias(vec))


def pool_mean(
    tokens: DataFrame, size: int, doc: str = "doc", mask: str = "mask", vec: str = "vec"
) -> DataFrame:
    """Mean over the tokens whose mask is set, per dimension.

    The sums are ``size`` columns of one partial aggregation, so a document with very many tokens is
    reduced inside each task and its vectors never travel.
    """
    sums = ", ".join(f"sum(_m * get({quoted(vec)}, {i}))" for i in range(size))
    pooled = (
        tokens.withColumn("_m", F.col(mask).cast("double"))
        .groupBy(doc)
        .agg(F.sum("_m").alias("_w"), F.expr(f"array({sums})").alias("_sums"))
    )
    return pooled.select(doc, F.transform("_sums", lambda s: ratio(s, F.col("_w"))).alias(vec))


def vector_columns(df: DataFrame, vec: str, prefix: str, size: int) -> DataFrame:
    """``df`` with the vector spread over columns ``<prefix>0 .. <prefix>size-1``."""
    rest = [c for c in df.columns if c != vec]
    return df.selectExpr(
        *[quoted(c) for c in rest], *[f"cast(get({quoted(vec)}, {i}) as double) as {quoted(prefix + str(i))}" for i in range(size)]
    )


def vector_size(df: DataFrame, vec: str) -> int:
    row = df.select(F.size(vec).alias("n")).filter("n > 0").first()
    return row["n"] if row else 0


#: Buckets of a feature block; blocks of one number of buckets are joined where they lie.
BLOCK_BUCKETS = 64


def write_block(df: DataFrame, key: str = "doc_id", buckets: int = BLOCK_BUCKETS) -> DataFrame:
    """``df`` written once as a table bucketed and sorted by ``key`` in the shared folder, and read from there.

    Blocks with the same number of buckets join by key without an exchange or a sort, as often as they are used. The table is
    external and has a generated name; ``drop_block`` forgets it.
    """
    spark = df.sparkSession
    name = f"inkprint_block_{uuid.uuid4().hex}"
    placed = df.repartition(buckets, quoted(key))
    placed.write.bucketBy(buckets, key).sortBy(key).option("path", scratch_path(spark, "block")).saveAsTable(name)
    return spark.table(name).alias(name)


def drop_block(block: DataFrame) -> None:
    """Forget the table of a ``write_block``; its files stay in the scratch folder."""
    plan = block._jdf.queryExecution().analyzed().toString()
    for name in set(re.findall(r"inkprint_block_[0-9a-f]{32}", plan)):
        block.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def combine_features(
    blocks: Sequence[DataFrame], embeddings: dict[str, DataFrame] | None = None, key: str = "doc_id",
    vec: str = "embedding", how: str = "inner", fill: float = 0.0, sizes: dict[str, int] | None = None,
) -> DataFrame:
    """Feature blocks and named embedding tables side by side, matched by key.

    An embedding table may cover a sample only. With ``how="inner"`` the result has the documents present in every block; with
    ``how="left"`` it has those of the first block, and embedding columns of documents without one are ``fill``. ``sizes`` gives
    vector lengths by name; without them one row of each table is read for it.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    combined = blocks[0]
    for part in blocks[1:]:
        combined = combined.join(part, key, how)
    for name, table in (embeddings or {}).items():
        table = table.select(key, vec)
        size = (sizes or {}).get(name) or vector_size(table, vec)
        wide = vector_columns(table, vec, f"{name}_emb_", size)
        combined = combined.join(wide, key, how)
        if how == "left":
            added = set(wide.columns) - {key}
            combined = combined.select(*[
                F.coalesce(F.col(quoted(c)), F.lit(fill)).alias(c) if c in added else F.col(quoted(c)) for c in combined.columns
            ])
    return combined

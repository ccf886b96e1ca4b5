"""Tag tables, token tables, feature blocks, sketches and sparse weights, each against plain Python or the plain way."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.operators import profile, stylometry, tagging, vectors
from inkprint.operators.tfidf import TfidfModel
from inkprint.plans import QUERIES
from inkprint.storage import materialize

TEXTS = ["The dog runs quickly", None, "", "dog dog DOG barks_1 und run", "no known words 1 2", "Run, dog! Run?", "The dog runs quickly"]
TAGS = [("dog", "NN"), ("Dog", "NNS"), ("run", "VB"), ("run", "NN"), ("runs", "VBZ"), ("quickly", "RB"), ("x", "XX"), (None, "NN"), ("the", None)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i % 5, t) for i, t in enumerate(TEXTS)] + [(100 + i, "the dog " * 20) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


@pytest.mark.parametrize("max_rows", [100, 0])
def test_tag_counts_from_a_table(spark, docs, max_rows, tmp_path):
    """On the broadcast path and on the shuffled one, where 'the' and 'dog' are on most rows."""
    spark.createDataFrame(TAGS, "word string, tag string").write.parquet(str(tmp_path / "lexicon"))
    lexicon = spark.read.parquet(str(tmp_path / "lexicon"))
    classes = {name: {w.lower() for w, t in TAGS if w and t and t.startswith(p)} for name, p in tagging.TAG_CLASSES.items()}
    assert classes["noun_count"] == {"dog", "run"} and "run" in classes["verb_count"]
    want = sorted(
        (r["doc_id"], *[sum(t in words for t in re.findall(r"\w+", (r["text"] or "").lower())) for words in classes.values()])
        for r in docs.collect()
    )
    found = tagging.tag_counts(docs, lexicon, max_rows=max_rows)
    shape = plan(found)
    if max_rows:
        # Only sums per document cross the one exchange.
        assert "BroadcastHashJoin" in shape and "SortMergeJoin" not in shape and shape.count("Exchange hashpartitioning(_row") == 1
    assert found.columns == ["doc_id", *tagging.TAG_CLASSES] and sorted(map(tuple, found.collect())) == want


def test_token_table_pools_like_pooling_in_place(docs):
    for limit in (None, 2, 6, 512):
        encoder = vectors.hashed_word_tokens(8, limit)
        tokens = materialize(vectors.token_table(docs.filter("doc_id > 99 or text is null or doc_id = 3"), encoder, batch_size=2))
        lengths = Counter(r["doc_id"] for r in tokens.collect())
        assert all(n <= (limit or 99) for n in lengths.values()) and max(lengths.values()) == min(limit or 99, 42)
        keyed = docs.filter("doc_id > 99")
        pooled = vectors.embed_pooled(keyed, encoder, batch_size=3)
        by_table = {
            "first": vectors.pool_first(tokens, doc="doc_id"), "last": vectors.pool_last(tokens, doc="doc_id"),
            "mean": vectors.pool_mean(tokens, 8, doc="doc_id"),
        }
        for how, table in by_table.items():
            want = {r["doc_id"]: list(r["vec"]) for r in table.collect()}
            assert all(np.allclose(r[how], want[r["doc_id"]], atol=1e-12) for r in pooled.collect())
        assert "hashpartitioning" not in plan(vectors.embed_pooled(keyed, encoder))
    with pytest.raises(ValueError):
        vectors.embed_pooled(docs, vectors.hashed_word_tokens(4), ["middle"])


def test_masked_tokens_do_not_count_in_the_mean(spark):
    def make():
        return lambda texts: [(np.array([1, 0, 1], np.int32), np.array([[1, 2], [50, 50], [3, 4]], np.float32)) for _ in texts]

    df = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    assert vectors.embed_pooled(df, make, ["mean"]).first()["mean"] == [2.0, 3.0]
    assert vectors.pool_mean(vectors.token_table(df, make), 2, doc="doc_id").first()["vec"] == [2.0, 3.0]


def test_written_blocks_join_without_an_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        left = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") * 2).alias("a"))
        middle = spark.range(0, 500).select(F.col("id").alias("doc_id"), (F.col("id") * 3).alias("b c"))
        sample = spark.range(0, 500, 3).select(F.col("id").alias("doc_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
        blocks = [vectors.write_block(df, buckets=4) for df in (left, middle, sample)]
        for how, rows in (("left", 500), ("inner", 167)):
            combined = vectors.combine_features(blocks[:2], {"s": blocks[2]}, how=how, fill=-1.0, sizes={"s": 2})
            shape = plan(combined)
            assert "Exchange" not in shape and shape.count("SortMergeJoin") == 2
            found = {r["doc_id"]: r for r in combined.collect()}
            assert len(found) == rows
            for i, r in found.items():
                assert (r["a"], r["b c"]) == (2 * i, 3 * i)
                assert (r["s_emb_0"], r["s_emb_1"]) == ((float(i), 1.0) if i % 3 == 0 else (-1.0, -1.0))
        for block in blocks:
            vectors.drop_block(block)
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("inkprint_block")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        vectors.combine_features([left], how="outer")


def test_style_block_ends_with_the_sentence_embedding(docs):
    encoder = vectors.hashed_trigram_encoder(4)
    block = stylometry.style_features(docs, encoder=encoder, encoder_size=4)
    assert block.columns == ["doc_id", *stylometry.style_columns(), *[f"sent_emb_{i}" for i in range(4)]]
    want = vectors.embed_documents(docs, encoder).select("doc_id", "embedding").collect()
    assert sorted((r["doc_id"], *map(float, r["embedding"])) for r in want) == sorted(
        (r["doc_id"], *[r[f"sent_emb_{i}"] for i in range(4)]) for r in block.collect()
    )


def test_sketches_decide_within_their_bounds(spark):
    """Around the decision bound: no repeated value, one, a few, and so many that the sketch alone can tell."""
    n = 20_000
    df = spark.range(n).select(
        F.col("id").cast("double").alias("unique"), F.greatest("id", F.lit(1)).cast("double").alias("one twice"),
        (F.col("id") % (n - 200)).cast("double").alias("near"), (F.col("id") % (n // 2)).alias("half"),
        F.when(F.col("id") > 0, F.col("id")).alias("holes"), F.lit(None).cast("int").alias("none"), (F.col("id") * 7).alias("whole"),
    )
    df = materialize(df.repartition(5))
    sketches = profile.distinct_sketches(df, df.columns)
    exact = {"unique": n, "one twice": n - 1, "near": n - 200, "half": n // 2, "holes": n - 1, "none": 0, "whole": n}
    for r in profile.distinct_estimates(sketches).collect():
        assert r["least"] <= exact[r["feature"]] <= r["most"], r
        assert r["n"] == (0 if r["feature"] == "none" else n - (r["feature"] == "holes"))
    assert [r["feature"] for r in profile.id_like_features(df, df.columns).collect()] == ["unique", "whole"]
    assert profile.distinct_estimates(sketches).filter("feature = 'half' and most < n").count() == 1


def test_sketches_of_two_tables_merge(spark):
    parts = [spark.range(a, b).select((F.col("id") % 3000).cast("double").alias("x"), F.lit("k").alias("k")) for a, b in ((0, 2500), (2000, 4000))]
    merged = profile.merge_sketches(profile.distinct_sketches(parts[0], ["x"], ["k"]).union(profile.distinct_sketches(parts[1], ["x"], ["k"])), ["k"])
    row = profile.distinct_estimates(merged).first()
    assert row["n"] == 4500 and row["least"] <= 3000 <= row["most"] and abs(row["estimate"] - 3000) < 300


def test_sparse_rows_with_a_large_vocabulary(spark):
    """100,000 terms: the rows of a text are those of its own terms."""
    rng = random.Random(1)
    terms = tuple(sorted("w%05d" % i for i in range(100_000)))
    model = TfidfModel(terms, tuple(rng.randint(1, 50) for _ in terms), 1000)
    texts = [" ".join(rng.choices(terms, k=30)) + " unknown" for _ in range(20)] + ["", None, "unknown only"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    idf, at = model.idf(), {t: i for i, t in enumerate(terms)}
    want = {}
    for i, text in enumerate(texts):
        raw = {t: n * idf[at[t]] for t, n in Counter((text or "").split()).items() if t in at}
        norm = sum(w * w for w in raw.values()) ** 0.5
        want.update({(i, t): w / norm for t, w in raw.items()})
    found = {(r["doc_id"], r["term"]): r["tfidf"] for r in model.transform_long(df).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_pools_of_known_size_hash_instead_of_sorting(spark):
    rows = [(1, 2, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (2, 5, None), (2, 6, [5.0, None]), (None, 0, [7.0, 8.0]), (3, None, [9.0, 9.0])]
    tokens = spark.createDataFrame(rows, "doc bigint, pos int, vec array<float>")
    for pool in (vectors.pool_first, vectors.pool_last):
        known = pool(tokens, size=2)
        assert "SortAggregate" not in plan(known) and "HashAggregate" in plan(known)
        assert {r["doc"]: r["vec"] for r in known.collect()} == {r["doc"]: r["vec"] for r in pool(tokens).collect()}
        with pytest.raises(Exception, match="does not have 3 entries"):
            pool(tokens, size=3).collect()


def test_texts_without_a_trigram_have_no_counts(spark, tmp_path):
    rows = [(1, ""), (2, "ab"), (3, None), (4, "abc")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["style_with_sentence_embedding"](spark, str(tmp_path)).collect()}
    total = {k: [r[f"sent_emb_{i}"] for i in range(16)] for k, r in got.items()}
    assert total[1] == total[2] == [0] * 16 and sum(total[4]) == 1 and total[3] == [None] * 16
    assert [r["doc_id"] for r in QUERIES["embed_documents"](spark, str(tmp_path)).collect()] == [4]

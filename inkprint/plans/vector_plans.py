"""Embedding vectors: pooling, columns, scaling, feature scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from inkprint.operators import scaling, vectors
from inkprint.plans import sqltext as q
from inkprint.plans.registry import documents, query, rounded, table

DIM = 64
NAMES = [f"e_{i}" for i in range(DIM)]
# `embeddings` read as a token table: label is the document, vec_id the position.
TOKENS = "tok AS (SELECT label AS doc, vec_id AS pos, CASE WHEN vec_id % 3 <> 0 THEN 1 ELSE 0 END AS mask, embedding AS vec FROM embeddings)"


def _tokens(spark, sf_dir):
    mask = F.when(F.col("vec_id") % 3 != 0, 1).otherwise(0)
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("doc"), F.col("vec_id").alias("pos"), mask.alias("mask"), F.col("embedding").alias("vec")
    )


def _wide_sql(source: str, vec: str, digits: int = 6, prefix: str = "e_") -> str:
    return ", ".join(f"round(CAST({source}{vec}[{i + 1}] AS DOUBLE), {digits}) AS {prefix}{i}" for i in range(DIM))


def _trigram_sql(source: str) -> str:
    """The encoder's bucket counts: hashes of three neighbouring code points, counted per bucket."""
    code = "((c[i] * 2654435761 + c[i + 1] * 40503 + c[i + 2] * 97) % 4294967291) % {}".format(DIM)
    return f"""codes AS (SELECT doc_id, list_transform(string_split(lower(text), ''), lambda x: CAST(unicode(x) AS BIGINT)) AS c FROM {source}),
buckets AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(c) - 2), lambda i: {code})) AS dim FROM codes)
SELECT doc_id, CAST(dim AS BIGINT) AS dim, count(*) AS n FROM buckets GROUP BY ALL"""


def _trigram_counts(embedded):
    """Unit vectors back to bucket counts: entries are in proportion to counts, which add up to the number of trigrams."""
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    scale = (F.char_length("text") - 2) / F.nullif(total, F.lit(0.0))
    entries = embedded.select("doc_id", scale.alias("s"), F.posexplode("embedding").alias("dim", "e")).filter("e > 0")
    return entries.select("doc_id", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("e") * F.col("s")).cast("bigint").alias("n"))


@query("embed_documents", f"WITH {_trigram_sql('documents')}")
def embed_documents(spark, sf_dir):
    """Every component of every vector, as the count it stands for; zero components are left out."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    return _trigram_counts(vectors.embed_documents(docs, vectors.hashed_trigram_encoder(DIM)))


@query("embed_sample", f"""WITH chosen AS (SELECT doc_id, text FROM documents
ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), doc_id LIMIT 100), {_trigram_sql('chosen')}""")
def embed_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _trigram_counts(vectors.embed_sample(docs, vectors.hashed_trigram_encoder(DIM), 100))


TOKEN_DIM = 16


def _token_sql(source: str, limit: int) -> str:
    """The hashed token encoder: a code per word, one before for all words and one behind from the last."""
    code = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(w, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967291)"
    vec = ", ".join(f"(code * {j + 1} + {j * j * 97}) % 2039 / CAST(1024 AS DOUBLE) - 1 AS e_{j}" for j in range(TOKEN_DIM))
    return f"""tw AS (SELECT doc_id, list_transform(list_slice({q.words_of('text')}, 1, {limit - 2}), lambda w: {code}) AS c FROM {source}),
tc AS (SELECT doc_id, list_concat(list_concat([CAST(coalesce(list_sum(c), 0) AS BIGINT) % 4294967291], c), [(coalesce(c[len(c)], 0) * 7 + 3) % 4294967291]) AS codes FROM tw),
tokens AS (SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, 1 AS mask, {vec} FROM
  (SELECT doc_id, unnest(codes) AS code, generate_subscripts(codes, 1) AS pos FROM tc))"""


def _fixed(value: str) -> str:
    """A vector entry in steps of 2**-20: whole numbers, which every engine prints alike."""
    return f"CAST(floor({value} * 1048576) AS BIGINT)"


def _in_steps(df, vec):
    rest = [c for c in df.columns if c != vec]
    return df.selectExpr(*rest, *[f"{_fixed(f'cast(get({vec}, {j}) as double)')} as e_{j}" for j in range(TOKEN_DIM)])


@query("token_table", f"WITH {_token_sql('documents', 32)} SELECT doc_id, pos, mask, {', '.join(_fixed(f'e_{j}') + f' AS e_{j}' for j in range(TOKEN_DIM))} FROM tokens")
def token_table(spark, sf_dir):
    """Token vectors of every text, cut at 32 tokens, a row per token; entries in steps of 2**-20."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    return _in_steps(vectors.token_table(docs, vectors.hashed_word_tokens(TOKEN_DIM, 32)), "vec")


def _pooled_sql(how: str) -> str:
    entry = {"first": "arg_min(e_{0}, pos)", "last": "arg_max(e_{0}, pos)", "mean": "avg(e_{0})"}[how]
    return f"SELECT '{how}' AS pooling, doc_id, {', '.join(_fixed(entry.format(j)) + f' AS e_{j}' for j in range(TOKEN_DIM))} FROM tokens GROUP BY doc_id"


_POOL_SQL = f"WITH {_token_sql('documents', 512)} " + " UNION ALL ".join(map(_pooled_sql, vectors.POOLINGS))


@query("pool_tokens", _POOL_SQL)
def pool_tokens(spark, sf_dir):
    """Encoder output of at most 512 tokens a text, pooled three ways from the token table; entries in steps of 2**-20."""
    tokens = vectors.token_table(documents(spark, sf_dir, "doc_id", "text"), vectors.hashed_word_tokens(TOKEN_DIM, 512))
    pooled = {
        "first": vectors.pool_first(tokens, doc="doc_id", size=TOKEN_DIM), "last": vectors.pool_last(tokens, doc="doc_id", size=TOKEN_DIM),
        "mean": vectors.pool_mean(tokens, TOKEN_DIM, doc="doc_id"),
    }
    parts = [_in_steps(df, "vec").withColumn("pooling", F.lit(how)) for how, df in pooled.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("embed_pooled", _POOL_SQL)
def embed_pooled(spark, sf_dir):
    """The same vectors, pooled where they are encoded: a map without a shuffle."""
    wide = vectors.embed_pooled(documents(spark, sf_dir, "doc_id", "text"), vectors.hashed_word_tokens(TOKEN_DIM, 512))
    each = F.array(*[F.struct(F.lit(p).alias("pooling"), F.col(p).alias("vec")) for p in vectors.POOLINGS])
    return _in_steps(wide.select("doc_id", F.inline(each)), "vec")


@query("pool_first", f"WITH {TOKENS} SELECT doc, {_wide_sql('', 'v')} FROM (SELECT doc, arg_min(vec, pos) AS v FROM tok GROUP BY doc)")
def pool_first(spark, sf_dir):
    return rounded(vectors.vector_columns(vectors.pool_first(_tokens(spark, sf_dir), size=DIM), "vec", "e_", DIM))


@query("pool_last", f"WITH {TOKENS} SELECT doc, {_wide_sql('', 'v')} FROM (SELECT doc, arg_max(vec, pos) AS v FROM tok GROUP BY doc)")
def pool_last(spark, sf_dir):
    return rounded(vectors.vector_columns(vectors.pool_last(_tokens(spark, sf_dir), size=DIM), "vec", "e_", DIM))


@query("pool_mean", f"""WITH {TOKENS} SELECT doc, {', '.join(f'round(sum(mask * CAST(vec[{i + 1}] AS DOUBLE)) / sum(mask), 6) AS e_{i}' for i in range(DIM))}
FROM tok GROUP BY doc""")
def pool_mean(spark, sf_dir):
    return rounded(vectors.vector_columns(vectors.pool_mean(_tokens(spark, sf_dir), DIM), "vec", "e_", DIM))


@query("embedding_columns", f"SELECT vec_id, label, {_wide_sql('', 'embedding', prefix='sent_emb_')} FROM embeddings")
def embedding_columns(spark, sf_dir):
    return rounded(vectors.vector_columns(table(spark, sf_dir, "embeddings"), "embedding", "sent_emb_", DIM))


def _wide(spark, sf_dir):
    return vectors.vector_columns(table(spark, sf_dir, "embeddings"), "embedding", "e_", DIM)


@query("standard_scale", f"""WITH w AS (SELECT vec_id, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS e_{i}' for i in range(DIM))} FROM embeddings),
s AS (SELECT {', '.join(f'avg(e_{i}) AS m_{i}, stddev_pop(e_{i}) AS s_{i}' for i in range(DIM))} FROM w)
SELECT vec_id, {', '.join(f'round((e_{i} - m_{i}) / CASE WHEN s_{i} = 0 THEN 1 ELSE s_{i} END, 6) AS e_{i}' for i in range(DIM))} FROM w, s""")
def standard_scale(spark, sf_dir):
    wide = _wide(spark, sf_dir).drop("label")
    return rounded(scaling.StandardScale.fit(wide, NAMES).transform(wide))


def _with_separator(spark, sf_dir):
    """The embedding columns and one that is constant in every class: its F is infinite and it is chosen first."""
    return _wide(spark, sf_dir).withColumn("e_sep", F.col("label").cast("double"))


_F_CTES = f"""long AS (SELECT label, vec_id, 'e_' || (i - 1) AS feature, CAST(embedding[i] AS DOUBLE) AS x
  FROM embeddings, (SELECT unnest(generate_series(1, {DIM})) AS i)
  UNION ALL SELECT label, vec_id, 'e_sep', CAST(label AS DOUBLE) FROM embeddings),
pc AS (SELECT feature, label, count(*) AS n, avg(x) AS mean FROM long GROUP BY feature, label),
gm AS (SELECT feature, avg(x) AS grand, count(*) AS n FROM long GROUP BY feature),
bw AS (SELECT pc.feature, sum(pc.n * (mean - grand) * (mean - grand)) AS b, count(*) AS k, any_value(gm.n) AS n
  FROM pc JOIN gm ON pc.feature = gm.feature GROUP BY pc.feature),
wi AS (SELECT l.feature, sum((x - mean) * (x - mean)) AS w FROM long l JOIN pc ON l.feature = pc.feature AND l.label = pc.label GROUP BY l.feature),
fs AS (SELECT bw.feature, CASE WHEN w = 0 THEN 'inf'::DOUBLE ELSE (b / (k - 1)) / (w / (n - k)) END AS f_score FROM bw JOIN wi ON bw.feature = wi.feature)"""


@query("anova_f_scores", f"WITH {_F_CTES} SELECT feature, round(f_score, 6) AS f_score FROM fs")
def anova_f_scores(spark, sf_dir):
    return rounded(scaling.anova_f_scores(_with_separator(spark, sf_dir), [*NAMES, "e_sep"], "label"))


@query("select_k_best", f"""WITH {_F_CTES}, best AS (SELECT feature FROM fs ORDER BY f_score DESC, feature LIMIT 20)
SELECT l.vec_id, l.feature, round(l.x, 6) AS value FROM long l JOIN best ON best.feature = l.feature""")
def select_k_best(spark, sf_dir):
    """The 20 best columns, returned long because which columns they are depends on the data."""
    kept = scaling.select_k_best(_with_separator(spark, sf_dir), [*NAMES, "e_sep"], "label", 20, keys=["vec_id"])
    return rounded(kept.unpivot("vec_id", [c for c in kept.columns if c != "vec_id"], "feature", "value"))


@query("pca", f"""SELECT {DIM}::BIGINT AS components, round({' + '.join(f'var_samp(CAST(embedding[{i + 1}] AS DOUBLE))' for i in range(DIM))}, 6) AS variance,
true AS decreasing, true AS uncorrelated FROM embeddings""")
def pca(spark, sf_dir):
    """All principal components: their variances add up to those of the columns, decrease, and no two components correlate."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Correlation

    data = scaling.assemble(_wide(spark, sf_dir), NAMES)
    moved = scaling.fit_pca(data, DIM).transform(data).select("pca")
    x = vector_to_array("pca")
    one = moved.agg(F.array(*[F.var_samp(F.get(x, F.lit(i))) for i in range(DIM)]).alias("v"))
    drops = F.forall(F.sequence(F.lit(1), F.lit(DIM - 1)), lambda i: F.get("v", i) <= F.get("v", i - 1) + 1e-9)
    matrix = Correlation.corr(moved, "pca").first()[0].toArray()
    apart = float(abs(matrix - np.eye(DIM)).max()) < 1e-6
    return one.select(
        F.size("v").cast("bigint").alias("components"), F.round(F.aggregate("v", F.lit(0.0), lambda s, v: s + v), 6).alias("variance"),
        drops.alias("decreasing"), F.lit(apart).alias("uncorrelated"),
    )


@query("reduce_features", f"""WITH emb AS (SELECT vec_id AS doc_id, CAST(CAST(label AS DOUBLE) AS VARCHAR) AS lang, NULL AS text FROM embeddings),
{q.split_cte(0.2, source='emb')}
SELECT method, doc_id AS vec_id, width FROM split, (VALUES ('pca', 20::BIGINT), ('selectkbest', 20::BIGINT), ('none', {DIM}::BIGINT)) m(method, width)
WHERE split = 'test'""")
def reduce_features(spark, sf_dir):
    """The three reductions fitted on train and applied to test: width of the result and rows."""
    from pyspark.ml.functions import vector_to_array

    from inkprint.operators.sampling import stratified_split

    data = scaling.assemble(_wide(spark, sf_dir).withColumn("label", F.col("label").cast("double")), NAMES)
    split = stratified_split(data, "label", 0.2, key="vec_id")
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    out = None
    for method in ("pca", "selectkbest", "none"):
        _, reduced, _ = scaling.reduce_features(train, test, method, 20, DIM)
        rows = reduced.select(
            F.lit(method).alias("method"), "vec_id", F.size(vector_to_array("reduced")).cast("bigint").alias("width")
        )
        out = rows if out is None else out.unionByName(rows)
    return out

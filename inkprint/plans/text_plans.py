"""Document features: one query per feature or small group of features, then the assembled block."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprint.functions.names import quoted
from inkprint.functions import text as tx
from inkprint.functions.lexicons import TECHNICAL_TERMS
from inkprint.operators import frames, stylometry, tagging
from inkprint.operators.ngrams import NgramVocabulary
from inkprint.plans import sqltext as q
from inkprint.plans.registry import QUERIES, ORACLES, documents, query, rounded
from inkprint.storage import materialize

# Query name -> the style columns it returns.
COLUMN_QUERIES = {
    "word_counts": ["word_count", "sentence_length"],
    "char_count": ["char_count"],
    "avg_word_length": ["avg_word_length"],
    "sentence_end_marks": ["period_count", "exclamation_count", "question_count", "punctuation_count"],
    "comma_semicolon_colon": ["comma_count", "semicolon_count", "colon_count"],
    "quote_counts": ["double_quote_count", "single_quote_count", "quote_count"],
    "digit_symbol_counts": ["digit_count", "symbol_count"],
    "longest_word": ["longest_word"],
    "stopword_ratio": ["stopword_ratio"],
    "function_words": stylometry.function_word_columns(),
    "sentence_count": ["sentence_count"],
    "avg_sentence_length": ["avg_sentence_length"],
    "std_sentence_length": ["std_sentence_length"],
    "lexical_diversity": ["unique_words", "lexical_diversity"],
    "uppercase": ["uppercase_count", "uppercase_ratio"],
    "flesch_reading_ease": ["flesch_reading_ease"],
    "gunning_fog": ["gunning_fog"],
    "avg_syllables_per_word": ["avg_syllables_per_word"],
    "punctuation_ratio": ["punctuation_ratio"],
    "hapax_legomena_ratio": ["hapax_legomena_ratio"],
    "yules_k": ["yules_k"],
    "char_entropy": ["char_entropy"],
    "stylometry_core": stylometry.style_columns(),
}


def _column_query(columns):
    def run(spark, sf_dir):
        docs = documents(spark, sf_dir, "doc_id", "text")
        return rounded(stylometry.with_style(docs, columns).select("doc_id", *columns))

    return run


for _name, _columns in COLUMN_QUERIES.items():
    QUERIES[_name] = _column_query(_columns)
    ORACLES[_name] = q.style_select(_columns)


@query("pos_tag_counts", q.style_select(stylometry.POS, lexicon=True))
def pos_tag_counts(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    return stylometry.with_style(docs, stylometry.POS, lexicon=q.LEXICON).select("doc_id", *stylometry.POS)


_LEXICON_SQL = """lexicon AS (SELECT w AS word, CASE length(w) % 4 WHEN 0 THEN 'NN' WHEN 1 THEN 'VBZ' WHEN 2 THEN 'JJ' ELSE 'RB' END AS tag
  FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents WHERE doc_id % 2 = 0) WHERE length(w) > 2
  UNION ALL SELECT DISTINCT w, 'VB' FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents WHERE doc_id % 2 = 0) WHERE w LIKE 't%')"""


def _lexicon(spark, sf_dir):
    """A large (word, tag) table: a made-up tag for every longer word of half of the corpus, and a second one for those that begin with t."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    words = documents(spark, sf_dir, "doc_id", "text").filter("doc_id % 2 = 0").select(F.explode(tokens).alias("word")).distinct()
    size = F.length("word") % 4
    tag = F.when(size == 0, "NN").when(size == 1, "VBZ").when(size == 2, "JJ").otherwise("RB")
    tagged = words.filter(F.length("word") > 2).withColumn("tag", tag)
    return tagged.union(words.filter(F.col("word").startswith("t")).withColumn("tag", F.lit("VB")))


@query("pos_tag_counts_from_table", f"""WITH {_LEXICON_SQL},
classes AS (SELECT word, {', '.join(f"max(CASE WHEN tag LIKE '{tag}%' THEN 1 ELSE 0 END) AS {c}" for c, tag in tagging.TAG_CLASSES.items())} FROM lexicon GROUP BY word),
tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM documents),
sums AS (SELECT doc_id, {', '.join(f'sum({c}) AS {c}' for c in tagging.TAG_CLASSES)} FROM tokens JOIN classes ON tokens.word = classes.word GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in tagging.TAG_CLASSES)} FROM documents d LEFT JOIN sums s ON s.doc_id = d.doc_id""")
def pos_tag_counts_from_table(spark, sf_dir):
    """Tag counts from a lexicon that is a table written as parquet, with two tags for some words."""
    lexicon = materialize(_lexicon(spark, sf_dir), "lexicon")
    return tagging.tag_counts(documents(spark, sf_dir, "doc_id", "text"), lexicon)


@query(
    "sentence_split",
    f"""WITH parts AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[.!?]{q.SPACE}+'),
    lambda s: len({q.words_of('s')}) > 0)) AS sentence FROM documents)
    SELECT d.doc_id, count(sentence) AS n, CAST(coalesce(sum(length(sentence)), 0) AS BIGINT) AS chars,
      md5(min(sentence)) AS first_hash, md5(max(sentence)) AS last_hash
    FROM documents d LEFT JOIN parts p ON d.doc_id = p.doc_id GROUP BY d.doc_id""",
)
def sentence_split(spark, sf_dir):
    """Sentences of every document, summarised to a count, their length and the outer two in sort order."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    parts = docs.select("doc_id", tx.sentences(F.col("text")).alias("s"))
    chars = F.aggregate("s", F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x))
    return parts.select(
        "doc_id", F.size("s").cast("bigint").alias("n"), chars.alias("chars"),
        F.md5(F.array_min("s")).alias("first_hash"), F.md5(F.array_max("s")).alias("last_hash"),
    )


@query("technicality_score", f"SELECT doc_id, round({q.technicality('text')}, 6) AS technicality_score FROM documents")
def technicality_score(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    score = tx.technicality(F.col("text"), TECHNICAL_TERMS).alias("technicality_score")
    return rounded(docs.select("doc_id", score))


@query(
    "add_technicality",
    f"SELECT doc_id, text, lang, source, n_chars, round({q.technicality('text')}, 6) AS technicality_score FROM documents",
)
def add_technicality(spark, sf_dir):
    """The table itself with the score as one more column."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source", "n_chars")
    return rounded(docs.withColumn("technicality_score", tx.technicality(F.col("text"), TECHNICAL_TERMS)))


@query("text_md5", "SELECT doc_id, md5(text) AS hash FROM documents")
def text_md5(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.md5("text").alias("hash"))


def _gram_ctes() -> str:
    """Top character and word n-grams by position-by-position generation."""
    chars = " UNION ALL ".join(
        f"SELECT {n} AS n, unnest(list_transform(generate_series(1, length(t) - {n - 1}), lambda i: substr(t, i, {n}))) AS g "
        f"FROM sq WHERE length(t) >= {n}"
        for n in (2, 3)
    )
    words = " UNION ALL ".join(
        f"SELECT {n} AS n, unnest(list_transform(generate_series(1, len(lw) - {n - 1}), "
        f"lambda i: array_to_string(list_slice(lw, i, i + {n - 1}), ' '))) AS g FROM lws WHERE len(lw) >= {n}"
        for n in (2, 3)
    )
    return f"""
sq AS (SELECT doc_id, replace(lower(text), ' ', '') AS t FROM documents),
lws AS (SELECT doc_id, {q.words_of('lower(text)')} AS lw FROM documents),
cg AS ({chars.replace('SELECT ', 'SELECT doc_id, ', 2)}),
wg AS ({words.replace('SELECT ', 'SELECT doc_id, ', 2)}),
grams AS (SELECT doc_id, 'char' AS kind, n, g FROM cg UNION ALL SELECT doc_id, 'word' AS kind, n, g FROM wg),
totals AS (SELECT kind, n, g, count(*) AS total FROM grams GROUP BY kind, n, g),
top AS (SELECT kind, CAST(n AS BIGINT) AS n, g AS gram, total, rank FROM
  (SELECT *, row_number() OVER (PARTITION BY kind, n ORDER BY total DESC, g) AS rank FROM totals) WHERE rank <= 5),
hits AS (SELECT doc_id, kind, n, g, count(*) AS c FROM grams GROUP BY doc_id, kind, n, g),
counted AS (SELECT d.doc_id, top.kind, top.n, top.gram, coalesce(h.c, 0) AS "count"
  FROM documents d CROSS JOIN top
  LEFT JOIN hits h ON h.doc_id = d.doc_id AND h.kind = top.kind AND h.n = top.n AND h.g = top.gram)"""


def _topk_sql(kind):
    return f"WITH {_gram_ctes()} SELECT n, gram, total, rank FROM top WHERE kind = '{kind}'"


def _counts_sql(kind):
    return f"WITH {_gram_ctes()} SELECT doc_id, kind, n, gram, \"count\" FROM counted WHERE kind = '{kind}'"


def _ngram_queries(kind):
    from inkprint.operators.ngrams import top_ngrams

    @query(f"{kind}_ngram_topk", _topk_sql(kind))
    def topk(spark, sf_dir):
        return top_ngrams(documents(spark, sf_dir, "text"), (kind,)).select("n", "gram", "total", "rank")

    @query(f"{kind}_ngram_counts", _counts_sql(kind))
    def counts(spark, sf_dir):
        docs = documents(spark, sf_dir, "doc_id", "text")
        return NgramVocabulary.fit(docs, kinds=(kind,)).transform_long(docs)


_ngram_queries("char")
_ngram_queries("word")


@query(
    "stylometric_features",
    f"""WITH {q.style_cte()}, {_gram_ctes()},
slots AS (SELECT kind || '_' || n || '_' || rank AS slot, kind, n, gram FROM top),
wide AS (SELECT doc_id, {', '.join(f"max(CASE WHEN slot = '{k}_{n}_{r}' THEN c.count END) AS {k}_{n}_{r}"
         for k in ('char', 'word') for n in (2, 3) for r in range(1, 6))}
  FROM counted c JOIN slots s ON c.kind = s.kind AND c.n = s.n AND c.gram = s.gram GROUP BY doc_id)
SELECT style.doc_id, {', '.join(q.column(c) for c in q.ALL_STYLE)},
  {', '.join(f'{k}_{n}_{r}' for k in ('char', 'word') for n in (2, 3) for r in range(1, 6))}
FROM style JOIN wide ON style.doc_id = wide.doc_id""",
)
def stylometric_features(spark, sf_dir):
    """The whole block: 43 fixed columns plus the counts of the corpus's top n-grams. The n-gram columns
    get position names here (kind_size_rank) because their real names are corpus text."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    vocabulary = NgramVocabulary.fit(docs)
    named = vocabulary.transform(docs)
    wide = stylometry.with_style(named, stylometry.style_columns())
    slots, seen = [], {}
    for (kind, n, _), name in zip(vocabulary.grams, vocabulary.column_names()):
        seen[kind, n] = seen.get((kind, n), 0) + 1
        slots.append(F.col(quoted(name)).alias(f"{kind}_{n}_{seen[kind, n]}"))
    return rounded(wide.select("doc_id", *stylometry.style_columns(), *slots))


def _sentence_sql() -> str:
    """Bucket counts of the trigram encoder, a column per bucket."""
    code = "((c[i] * 2654435761 + c[i + 1] * 40503 + c[i + 2] * 97) % 4294967291) % 16"
    return f"""codes AS (SELECT doc_id, list_transform(string_split(lower(text), ''), lambda x: CAST(unicode(x) AS BIGINT)) AS c FROM documents),
buckets AS (SELECT doc_id, list_transform(generate_series(1, len(c) - 2), lambda i: {code}) AS b FROM codes),
sentence AS (SELECT doc_id, {', '.join(f'CAST(len(list_filter(b, lambda x: x = {i})) AS BIGINT) AS sent_emb_{i}' for i in range(16))} FROM buckets)"""


@query("style_with_sentence_embedding", f"""WITH {q.style_cte()}, {_sentence_sql()}
SELECT style.doc_id, {', '.join(q.column(c) for c in q.ALL_STYLE)}, {', '.join(f'sent_emb_{i}' for i in range(16))}
FROM style JOIN sentence ON style.doc_id = sentence.doc_id""")
def style_with_sentence_embedding(spark, sf_dir):
    """The fixed block with sentence-embedding columns at its end, from one map stage. The entries of a vector are shown as
    the counts they stand for: they are in proportion to counts that add up to the number of trigrams."""
    from inkprint.operators.vectors import hashed_trigram_encoder

    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("trigrams", F.length("text") - 2)
    wide = stylometry.style_features(docs, keys=["doc_id", "trigrams"], encoder=hashed_trigram_encoder(16), encoder_size=16)
    total = sum((F.col(f"sent_emb_{i}") for i in range(1, 16)), F.col("sent_emb_0"))
    # A text of fewer than three characters has no trigram: all its entries are 0, and so are its counts.
    none = F.when(F.col("trigrams").isNotNull(), F.lit(0).cast("bigint"))
    counts = [
        F.when(total > 0, F.round(F.col(f"sent_emb_{i}") * F.col("trigrams") / total).cast("bigint")).otherwise(none).alias(f"sent_emb_{i}")
        for i in range(16)
    ]
    return rounded(wide.select("doc_id", *stylometry.style_columns(), *counts))


@query(
    "stopword_lookup",
    f"""WITH w AS (SELECT doc_id, unnest({q.words_of('lower(text)')}) AS w FROM documents)
    SELECT d.doc_id, CAST(count_if(w IN ({q.quoted(q.STOP_WORDS)})) AS BIGINT) AS stop_words
    FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id GROUP BY d.doc_id""",
)
def stopword_lookup(spark, sf_dir):
    """Word-in-set test: stop words per document."""
    docs = documents(spark, sf_dir, "doc_id", "text").select("doc_id", tx.words(F.lower("text")).alias("w"))
    return docs.select("doc_id", tx.count_among("w", q.STOP_WORDS).alias("stop_words"))


@query("select_feature_set", q.style_select(
    [c for c in q.ALL_STYLE if c.startswith(tuple(frames.STYLE_PREFIXES)) or c.endswith(tuple(frames.STYLE_SUFFIXES))]
))
def select_feature_set(spark, sf_dir):
    features = stylometry.style_features(documents(spark, sf_dir, "doc_id", "text"))
    return rounded(frames.feature_set(features, "stylometric", keys=["doc_id"]))


@query("drop_intermediate", q.style_select(["quote_count", "punctuation_count", "sentence_count"]))
def drop_intermediate(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    wide = stylometry.with_style(
        docs, ["period_count", "double_quote_count", "single_quote_count", "quote_count", "punctuation_count",
               "sentence_count"],
    ).withColumn("sentences", tx.sentences(F.col("text")))
    return frames.drop_helpers(wide).drop("text")


@query(
    "align_features",
    f"""WITH {q.style_cte()} SELECT doc_id, comma_count, word_count, 0.0::DOUBLE AS unseen_feature,
    {q.column('char_entropy')} FROM style""",
)
def align_features(spark, sf_dir):
    features = stylometry.style_features(documents(spark, sf_dir, "doc_id", "text"))
    names = ["comma_count", "word_count", "unseen_feature", "char_entropy"]
    return rounded(frames.align_features(features, names, keys=["doc_id"]))


@query(
    "finite_check",
    f"""WITH {q.style_cte()}, long AS (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in q.ALL_STYLE)} FROM style)
      ON {', '.join(q.ALL_STYLE)} INTO NAME feature VALUE v)
    SELECT feature, CAST(count_if(isnan(v)) AS BIGINT) AS n_nan, CAST(count_if(isinf(v)) AS BIGINT) AS n_inf
    FROM long GROUP BY feature""",
)
def finite_check(spark, sf_dir):
    features = stylometry.style_features(documents(spark, sf_dir, "doc_id", "text"))
    return frames.non_finite_counts(features, stylometry.style_columns())

"""Corpus tables, profiles, TF-IDF, joins and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprint.functions import text as tx
from inkprint.operators import frames, labels, leakage, profile, sampling, stylometry, tfidf, vectors
from inkprint.plans import fixtures
from inkprint.plans import sqltext as q
from inkprint.plans.registry import documents, query, rounded, table
from inkprint.sources import corpus, sinks
from inkprint.storage import materialize

STRIP = r"regexp_replace(regexp_replace(text, '^" + q.SPACE + r"+', ''), '" + q.SPACE + r"+$', '')"
AUTHORS = ["de", "en", "fr"]


@query("load_corpus", f"SELECT doc_id, text, lang AS label FROM documents WHERE lang IN ({q.quoted(AUTHORS)})")
def load_corpus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    return corpus.author_filter(docs, AUTHORS)


@query("build_dataset", f"SELECT doc_id, label, text FROM (SELECT doc_id, lang AS label, {STRIP} AS text FROM documents) WHERE text <> ''")
def build_dataset(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"), "text")
    return corpus.stripped(docs, drop_empty=True)


@query("load_samples", f"SELECT doc_id, lang AS label, {STRIP} AS text FROM documents WHERE lang IN ({q.quoted(AUTHORS)})")
def load_samples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"), "text")
    return corpus.stripped(corpus.author_filter(docs, AUTHORS))


@query("project_text_label", "SELECT text, lang AS label FROM documents")
def project_text_label(spark, sf_dir):
    return frames.text_and_label(table(spark, sf_dir, "documents").withColumnRenamed("lang", "label"))


@query("drop_empty_docs", f"SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '[^{q.SPACE[1:-1]}]')")
def drop_empty_docs(spark, sf_dir):
    return frames.drop_blank(table(spark, sf_dir, "documents")).select("doc_id", "lang")


@query("fill_missing", """SELECT d.doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic,
    coalesce(CAST(quality AS DOUBLE), 0.0::DOUBLE) AS score
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def fill_missing(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    scored = joined.withColumn("score", F.coalesce(F.col("quality").cast("double"), F.lit(float("nan"))))
    return frames.fill_missing(scored)


@query("label_column_fallback", "SELECT doc_id, source AS label FROM documents")
def label_column_fallback(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("author"), F.col("lang").alias("label"))
    return labels.label_column(docs).select("doc_id", "label")


@query("numeric_columns", "SELECT doc_id, n_chars FROM documents")
def numeric_columns(spark, sf_dir):
    return frames.select_numeric(table(spark, sf_dir, "documents"))


@query("text_snippet", "SELECT doc_id, replace(substring(text, 1, 120), chr(10), ' ') AS text_snippet FROM documents")
def text_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text")).alias("text_snippet"))


@query("class_distribution", "SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang")
def class_distribution(spark, sf_dir):
    return profile.class_distribution(table(spark, sf_dir, "documents"), "lang")


@query("avg_words_by_label", f"SELECT lang, round(avg(len({q.words_of('text')})), 6) AS avg_words FROM documents GROUP BY lang")
def avg_words_by_label(spark, sf_dir):
    return rounded(profile.average_words(documents(spark, sf_dir, "lang", "text"), "lang"))


@query("length_histogram", f"""WITH w AS (SELECT lang, len({q.words_of('text')}) AS x FROM documents),
r AS (SELECT lang, min(x) AS lo, max(x) AS hi FROM w GROUP BY lang),
b AS (SELECT w.lang, CASE WHEN hi > lo THEN least((x - lo) * 30 // (hi - lo), 29) ELSE 15 END AS bin FROM w JOIN r ON w.lang = r.lang),
c AS (SELECT lang, bin, count(*) AS n FROM b GROUP BY lang, bin)
SELECT r.lang, r.lo, r.hi, g.bin, coalesce(c.n, 0) AS n FROM r CROSS JOIN (SELECT unnest(generate_series(0, 29)) AS bin) g
LEFT JOIN c ON c.lang = r.lang AND c.bin = g.bin""")
def length_histogram(spark, sf_dir):
    return profile.length_histogram(documents(spark, sf_dir, "lang", "text"), "lang")


@query("feature_density_by_class", """WITH r AS (SELECT CAST(min(n_chars) AS DOUBLE) AS lo, CAST(max(n_chars) AS DOUBLE) AS hi, count(n_chars) AS total FROM documents)
SELECT lang, CAST(least(floor((n_chars - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, count(*) AS n,
  round(count(*) / (any_value(total) * any_value((hi - lo) / 20)), 10) AS density
FROM documents, r GROUP BY 1, 2""")
def feature_density_by_class(spark, sf_dir):
    return rounded(profile.feature_density(table(spark, sf_dir, "documents"), "n_chars", "lang"), 10)


PROFILE_EXTRA = "doc_id AS row_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS BIGINT) AS label_index"


def _profile_sql(tail: str) -> str:
    columns = [*q.ALL_STYLE, "row_id", "label_index"]
    return f"""WITH {q.style_cte()}, feat AS (SELECT *, {PROFILE_EXTRA} FROM style),
long AS (UNPIVOT (SELECT lang, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in columns)} FROM feat)
  ON {', '.join(columns)} INTO NAME feature VALUE v)
{tail}"""


def _profile_table(spark, sf_dir):
    """Style columns plus a row id and the label's index, two columns a profile must find."""
    docs = documents(spark, sf_dir, "doc_id", "lang", "text")
    wide = stylometry.style_features(docs, keys=["doc_id", "lang"]).withColumn("row_id", F.col("doc_id"))
    encoder = labels.LabelEncoder.fit(table(spark, sf_dir, "documents"), "lang")
    return encoder.encode(wide, "lang", "label_index"), [*stylometry.style_columns(), "row_id", "label_index"]


@query("constant_features", _profile_sql("SELECT feature FROM long GROUP BY feature HAVING count(DISTINCT v) = 1"))
def constant_features(spark, sf_dir):
    return profile.constant_features(*_profile_table(spark, sf_dir))


@query("class_constant_features", _profile_sql("""SELECT feature FROM (SELECT feature, lang, count(DISTINCT v) AS d FROM long GROUP BY feature, lang)
GROUP BY feature HAVING max(d) = 1 AND min(d) = 1 AND feature IN (SELECT feature FROM long GROUP BY feature HAVING count(DISTINCT v) > 1)"""))
def class_constant_features(spark, sf_dir):
    return profile.class_constant_features(*_profile_table(spark, sf_dir), "lang")


@query("id_like_features", _profile_sql("SELECT feature FROM long GROUP BY feature HAVING count(DISTINCT v) = count(*)"))
def id_like_features(spark, sf_dir):
    """Two passes over the features, so the table is written once."""
    wide, columns = _profile_table(spark, sf_dir)
    return profile.id_like_features(materialize(wide, "profile"), columns)


# --- TF-IDF ---------------------------------------------------------------------------------------

def _tfidf_ctes(fit: str, apply: str, max_features: int) -> str:
    return f"""
fit_docs AS ({fit}), apply_docs AS ({apply}),
ft AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM fit_docs),
stats AS (SELECT term, count(*) AS total, count(DISTINCT doc_id) AS doc_freq FROM ft
  WHERE term NOT IN ({q.quoted(q.STOP_WORDS)}) GROUP BY term),
vocab AS (SELECT * FROM stats ORDER BY total DESC, term LIMIT {max_features}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text),
  '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM apply_docs) GROUP BY doc_id, term),
raw AS (SELECT doc_id, tf.term, tf * (ln((1 + (SELECT count(*) FROM fit_docs)) / CAST(1 + doc_freq AS DOUBLE)) + 1) AS r
  FROM tf JOIN vocab ON tf.term = vocab.term),
weights AS (SELECT doc_id, term, round(r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM raw)"""


ALL_DOCS = "SELECT doc_id, text FROM documents"


@query("tfidf_vocab", f"WITH {_tfidf_ctes(ALL_DOCS, ALL_DOCS, 500)} SELECT term, total, doc_freq FROM vocab")
def tfidf_vocab(spark, sf_dir):
    return tfidf.top_terms(documents(spark, sf_dir, "text"), 500)


@query("vocab_lookup", f"""WITH {_tfidf_ctes(ALL_DOCS, ALL_DOCS, 100)}
SELECT d.doc_id, CAST(coalesce(sum(tf), 0) AS BIGINT) AS in_vocabulary FROM documents d
LEFT JOIN (SELECT doc_id, tf FROM tf JOIN vocab ON tf.term = vocab.term) h ON h.doc_id = d.doc_id GROUP BY d.doc_id""")
def vocab_lookup(spark, sf_dir):
    """Word-in-set test against a fitted vocabulary: tokens of each document that are in it."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    vocabulary = [r["term"] for r in tfidf.top_terms(docs, 100).select("term").collect()]
    tokens = docs.select("doc_id", tx.vocabulary_tokens(F.col("text")).alias("t"))
    return tokens.select("doc_id", tx.count_among("t", vocabulary).alias("in_vocabulary"))


@query("tfidf", f"WITH {_tfidf_ctes(ALL_DOCS, ALL_DOCS, 500)} SELECT * FROM weights")
def tfidf_weights(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    return rounded(tfidf.TfidfModel.fit(docs, 500).transform_long(docs))


def _split_docs(part: str) -> str:
    return f"SELECT doc_id, text FROM split WHERE split = '{part}'"


@query("tfidf_transform", f"WITH {q.split_cte(0.2)}, {_tfidf_ctes(_split_docs('train'), _split_docs('test'), 100)} SELECT * FROM weights")
def tfidf_transform(spark, sf_dir):
    """Fitted on the train split, applied to the test split."""
    docs = sampling.stratified_split(documents(spark, sf_dir, "doc_id", "lang", "text"), "lang", 0.2)
    model = tfidf.TfidfModel.fit(docs.filter("split = 'train'"), 100)
    return rounded(model.transform_long(docs.filter("split = 'test'")))


# --- labels, joins --------------------------------------------------------------------------------

@query("label_encode", "SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS BIGINT) AS label_index FROM documents")
def label_encode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return labels.LabelEncoder.fit(docs, "lang").encode(docs, "lang", "label_index")


@query("label_decode", f"WITH {q.rule_cte()} SELECT doc_id, true_label, predicted_label FROM preds")
def label_decode(spark, sf_dir):
    """Predicted indices back to names, by the sorted truth labels."""
    preds = fixtures.predictions(spark, sf_dir)
    truth = table(spark, sf_dir, "documents").select(F.col("lang").alias("true_label"))
    encoder = labels.LabelEncoder.fit(truth, "true_label")
    indexed = encoder.encode(preds, "predicted_label", "predicted_index").drop("predicted_label")
    decoded = labels.decode_predictions(indexed, "predicted_index", "predicted_label", truth="true_label")
    return decoded.drop("predicted_index")


@query("label_subset", f"""WITH {q.rule_cte()}, {q.split_cte(0.2)}, known AS (SELECT DISTINCT lang FROM split WHERE split = 'train'),
found AS (SELECT DISTINCT predicted_label AS value FROM preds UNION SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)
SELECT value FROM found WHERE value NOT IN (SELECT lang FROM known)""")
def label_subset(spark, sf_dir):
    """Of the predicted labels and the names of the sources, those that are no label of the train split."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    known = sampling.stratified_split(docs, "lang", 0.2).filter("split = 'train'").select("lang")
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("predicted_label")).dropna()
    found = fixtures.predictions(spark, sf_dir).select("predicted_label").union(sources)
    return labels.unknown_values(found, "predicted_label", known, "lang")


@query("features_with_labels", f"""WITH {q.style_cte()} SELECT quality, count(*) AS n, round(avg(word_count), 6) AS word_count,
round(avg(char_entropy), 6) AS char_entropy FROM style JOIN labels ON style.doc_id = labels.doc_id GROUP BY quality""")
def features_with_labels(spark, sf_dir):
    """Features and labels kept in two tables, matched by document, profiled per label."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    features = stylometry.with_style(docs, ["word_count", "char_entropy"]).drop("text")
    joined = features.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return rounded(
        joined.groupBy("quality").agg(
            F.count("*").alias("n"), F.avg("word_count").alias("word_count"), F.avg("char_entropy").alias("char_entropy")
        )
    )


def _combined_sql(join: str, embedding: str) -> str:
    return f"""WITH {q.style_cte()}, {_tfidf_ctes(ALL_DOCS, ALL_DOCS, 10)},
slots AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS slot FROM vocab),
wide AS (SELECT d.doc_id, {', '.join(f"coalesce(max(CASE WHEN slot = {i} THEN tfidf END), 0.0::DOUBLE) AS tfidf_{i}" for i in range(10))}
  FROM documents d LEFT JOIN (SELECT doc_id, slot, tfidf FROM weights JOIN slots ON weights.term = slots.term) w ON w.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT style.doc_id, {', '.join(q.column(c) for c in q.ALL_STYLE)}, {', '.join(f'tfidf_{i}' for i in range(10))},
  {', '.join(f'round({embedding.format(i + 1)}, 6) AS base_emb_{i}' for i in range(64))}
FROM style JOIN wide ON style.doc_id = wide.doc_id {join} ON e.vec_id = style.doc_id"""


def _text_block(spark, sf_dir):
    """Style and TF-IDF columns of the same rows: one scan and one projection."""
    from pyspark.ml.functions import vector_to_array

    docs = documents(spark, sf_dir, "doc_id", "text")
    model = tfidf.TfidfModel.fit(docs, 10)
    weighted = model.transform(docs).withColumn("_weights", vector_to_array("tfidf"))
    styled = stylometry.style_features(weighted, keys=["doc_id", "_weights"])
    return vectors.vector_columns(styled, "_weights", "tfidf_", len(model.terms))


def _embedding_block(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")


@query("combine_features", _combined_sql("JOIN embeddings e", "CAST(embedding[{}] AS DOUBLE)"))
def combine_features(spark, sf_dir):
    """Style columns, TF-IDF columns and a named embedding block side by side."""
    return rounded(vectors.combine_features([_text_block(spark, sf_dir)], {"base": _embedding_block(spark, sf_dir)}, sizes={"base": 64}))


@query("combine_features_left", _combined_sql(
    "LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 3 = 0) e", "coalesce(CAST(embedding[{}] AS DOUBLE), 0.0::DOUBLE)"))
def combine_features_left(spark, sf_dir):
    """Every document, with the embedding of those that a sample of the embeddings covers and zeros for the others.

    Both blocks are written bucketed by document first, so the join itself moves nothing.
    """
    blocks = [vectors.write_block(df) for df in (_text_block(spark, sf_dir), _embedding_block(spark, sf_dir).filter("doc_id % 3 = 0"))]
    return rounded(vectors.combine_features(blocks[:1], {"base": blocks[1]}, how="left", sizes={"base": 64}))


# --- leak checks ----------------------------------------------------------------------------------

def _split(spark, sf_dir, fraction=0.1):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return sampling.stratified_split(docs, "lang", fraction)


_TRAIN = "(SELECT md5(text) FROM split WHERE split = 'train')"


@query("leaked_rows", f"WITH {q.split_cte(0.1)} SELECT doc_id, lang, md5(text) AS hash FROM split WHERE split = 'test' AND md5(text) IN {_TRAIN}")
def leaked_rows(spark, sf_dir):
    return leakage.leaked_rows(_split(spark, sf_dir)).select("doc_id", "lang", "hash")


@query("train_test_clean", f"WITH {q.split_cte(0.1)} SELECT doc_id, lang, md5(text) AS hash FROM split WHERE split = 'test' AND md5(text) NOT IN {_TRAIN}")
def train_test_clean(spark, sf_dir):
    return leakage.clean_rows(_split(spark, sf_dir)).select("doc_id", "lang", "hash")


@query("intersect_hashes", f"""WITH {q.split_cte(0.1)} SELECT
(SELECT count(DISTINCT md5(text)) FROM split WHERE split = 'train') AS train_hashes,
(SELECT count(DISTINCT md5(text)) FROM split WHERE split = 'test') AS test_hashes,
(SELECT count(*) FROM (SELECT md5(text) FROM split WHERE split = 'train' INTERSECT SELECT md5(text) FROM split WHERE split = 'test')) AS shared_hashes""")
def intersect_hashes(spark, sf_dir):
    return leakage.overlap_summary(_split(spark, sf_dir))


@query("leak_examples", f"""WITH {q.split_cte(0.1)} SELECT DISTINCT md5(text) AS hash, text FROM split
WHERE split = 'test' AND md5(text) IN {_TRAIN} ORDER BY text LIMIT 5""")
def leak_examples(spark, sf_dir):
    return leakage.leak_examples(_split(spark, sf_dir))


# --- splits, folds, samples -----------------------------------------------------------------------

@query("stratified_split", f"WITH {q.split_cte(0.2)} SELECT doc_id, lang, split FROM split")
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 0.2)


@query("random_split", f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {q.seeded()}, doc_id)
<= (SELECT ceil(count(*) * 0.2::DOUBLE) FROM documents) THEN 'test' ELSE 'train' END AS split FROM documents""")
def random_split(spark, sf_dir):
    return sampling.random_split(table(spark, sf_dir, "documents").select("doc_id"), 0.2)


@query("stratified_folds", f"WITH {q.folds_cte(3, ordered=False)} SELECT doc_id, lang, fold FROM folds")
def stratified_folds(spark, sf_dir):
    return sampling.stratified_folds(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 3)


@query("stratified_folds_ordered", f"WITH {q.folds_cte(3, ordered=True)} SELECT doc_id, lang, fold FROM folds")
def stratified_folds_ordered(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.stratified_folds(docs, "lang", 3, seed=None)


@query("sample_n", f"SELECT doc_id, lang FROM documents ORDER BY {q.seeded()}, doc_id LIMIT 100")
def sample_n(spark, sf_dir):
    return sampling.sample_n(table(spark, sf_dir, "documents").select("doc_id", "lang"), 100)


def _per_class_sql(order):
    return f"""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {order}) AS r
    FROM documents) WHERE r <= 2"""


@query("sample_per_class", _per_class_sql(f"{q.seeded()}, doc_id"))
def sample_per_class(spark, sf_dir):
    return sampling.sample_per_class(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang")


@query("head_per_class", _per_class_sql("doc_id"))
def head_per_class(spark, sf_dir):
    return sampling.head_per_class(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang")


@query("topk_sorted", "SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def topk_sorted(spark, sf_dir):
    return sampling.top_k(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "n_chars", 10, ["doc_id"])


# --- metrics on rule-based predictions ------------------------------------------------------------

def _metric(name, sql, fn):
    query(name, f"WITH {q.rule_cte()} {sql}")(lambda spark, sf_dir: rounded(fn(fixtures.predictions(spark, sf_dir))))


def _register_metrics():
    from inkprint.operators import evaluation as ev

    cls = """, labs AS (SELECT true_label AS label FROM preds UNION SELECT predicted_label FROM preds),
pc AS (SELECT label,
  (SELECT count(*) FROM preds WHERE true_label = label AND predicted_label = label) AS tp,
  (SELECT count(*) FROM preds WHERE predicted_label = label) AS np,
  (SELECT count(*) FROM preds WHERE true_label = label) AS support FROM labs),
m AS (SELECT label, tp, support, CASE WHEN np = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / np END AS precision,
  CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / support END AS recall,
  CASE WHEN np + support = 0 THEN 0.0::DOUBLE ELSE 2 * CAST(tp AS DOUBLE) / (np + support) END AS f1 FROM pc)"""
    acc = "(SELECT avg(CASE WHEN true_label = predicted_label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM preds)"
    _metric("accuracy", f"SELECT round({acc}, 6) AS accuracy", ev.accuracy)
    _metric("classification_report", f"""{cls}, rep AS (
  SELECT label, precision, recall, f1, support FROM m
  UNION ALL SELECT 'accuracy', {acc}, {acc}, {acc}, (SELECT count(*) FROM preds)
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM m
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support)::BIGINT FROM m)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep""",
            ev.classification_report)
    _metric("confusion_matrix", f"""{cls} SELECT a.label AS true_label, b.label AS predicted_label,
  (SELECT count(*) FROM preds WHERE true_label = a.label AND predicted_label = b.label) AS n
FROM labs a CROSS JOIN labs b""", ev.confusion_matrix)
    _metric("per_class_metrics", f"""{cls} SELECT label, metric, round(value, 6) AS value FROM (
  UNPIVOT (SELECT label, precision, recall, f1 FROM m) ON precision, recall, f1 INTO NAME metric VALUE value)""",
            ev.per_class_metrics)
    _metric("per_class_accuracy", """SELECT true_label AS label,
  round(avg(CASE WHEN true_label = predicted_label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM preds GROUP BY 1""",
            ev.per_class_accuracy)
    _metric("common_misclassifications", """SELECT true_label, predicted_label, count(*) AS n FROM preds
WHERE true_label <> predicted_label GROUP BY 1, 2""", ev.common_misclassifications)
    table_sql = "SELECT doc_id, true_label, predicted_label, true_label = predicted_label AS correct FROM preds"
    for name in ("prediction_table", "correct_flag"):
        _metric(name, table_sql, lambda p: ev.prediction_table(p, "true_label", "predicted_label"))


_register_metrics()


@query("misclassified_rows", f"WITH {q.rule_cte()} SELECT p.doc_id, true_label, predicted_label, d.text FROM preds p JOIN documents d ON p.doc_id = d.doc_id WHERE true_label <> predicted_label")
def misclassified_rows(spark, sf_dir):
    return frames.misclassified(fixtures.predictions(spark, sf_dir), table(spark, sf_dir, "documents"))


_WRONG = """wrong AS (SELECT 'by_word' AS model, lang AS true_label, by_word AS predicted_label, text FROM rules WHERE lang <> by_word
UNION ALL SELECT 'by_letter', lang, by_letter, text FROM rules WHERE lang <> by_letter)"""


def _wrong(spark, sf_dir):
    return fixtures.predictions_by_rule(spark, sf_dir, "text").filter("true_label <> predicted_label")


@query("misclass_summary", f"""WITH {q.rule_cte()}, {_WRONG} SELECT model, true_label, predicted_label,
replace(substring(text, 1, 120), chr(10), ' ') AS text_snippet FROM wrong""")
def misclass_summary(spark, sf_dir):
    return sinks.misclassification_summary(_wrong(spark, sf_dir))


@query("misclass_top10", f"""WITH {q.rule_cte()}, {_WRONG} SELECT true_label, predicted_label, count(*) AS n FROM wrong
GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10""")
def misclass_top10(spark, sf_dir):
    return profile.misclassification_patterns(_wrong(spark, sf_dir))


_FOLD_SCORES = f"""{q.folds_cte(5, ordered=False)}, {q.rule_cte()},
guesses AS (SELECT f.fold, r.lang, 'by_word' AS model, by_word AS guess FROM rules r JOIN folds f ON f.doc_id = r.doc_id
  UNION ALL SELECT f.fold, r.lang, 'by_letter', by_letter FROM rules r JOIN folds f ON f.doc_id = r.doc_id),
fs AS (SELECT model, fold, avg(CASE WHEN lang = guess THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM guesses GROUP BY model, fold),
summ AS (SELECT model, avg(score) AS mean_accuracy, stddev_pop(score) AS std_accuracy, list(score ORDER BY fold) AS scores FROM fs GROUP BY model)"""


@query("cv_summary", f"""WITH {_FOLD_SCORES} SELECT model, round(mean_accuracy, 6) AS mean_accuracy, round(std_accuracy, 6) AS std_accuracy,
{', '.join(f'round(scores[{i + 1}], 6) AS fold_{i}' for i in range(5))} FROM summ""")
def cv_summary(spark, sf_dir):
    summary = profile.summarize_folds(fixtures.fold_scores(spark, sf_dir))
    folds = [F.get("fold_scores", F.lit(i)).alias(f"fold_{i}") for i in range(5)]
    return rounded(summary.select("model", "mean_accuracy", "std_accuracy", *folds))


@query("best_model", f"WITH {_FOLD_SCORES} SELECT model, round(mean_accuracy, 6) AS mean_accuracy FROM summ ORDER BY mean_accuracy DESC, model LIMIT 1")
def best_model(spark, sf_dir):
    summary = profile.summarize_folds(fixtures.fold_scores(spark, sf_dir))
    return rounded(profile.best_model(summary).select("model", "mean_accuracy"))


def _with_failure(spark, sf_dir):
    """The rules' comparison table; the letter rule is marked failed."""
    summary = profile.summarize_folds(fixtures.fold_scores(spark, sf_dir)).select("model", "mean_accuracy")
    failed = F.col("model") == "by_letter"
    return summary.withColumn("mean_accuracy", F.when(~failed, F.col("mean_accuracy"))).withColumn(
        "status", F.when(failed, "failed").otherwise("success")
    )


@query("success_only", f"WITH {_FOLD_SCORES} SELECT model, round(mean_accuracy, 6) AS mean_accuracy, 'success' AS status FROM summ WHERE model <> 'by_letter'")
def success_only(spark, sf_dir):
    return rounded(frames.successful(_with_failure(spark, sf_dir)))


@query("upsert_result", f"""WITH {_FOLD_SCORES} SELECT model, round(mean_accuracy, 6) AS mean_accuracy FROM summ WHERE model NOT LIKE 'by_w%'
UNION ALL SELECT 'by_word_5', round(mean_accuracy, 6) FROM summ WHERE model = 'by_word'""")
def upsert_result(spark, sf_dir):
    summary = profile.summarize_folds(fixtures.fold_scores(spark, sf_dir)).select("model", "mean_accuracy")
    newer = summary.filter("model = 'by_word'").withColumn("model", F.lit("by_word_5"))
    return rounded(frames.upsert_by_prefix(summary, "by_w", newer))

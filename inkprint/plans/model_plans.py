"""Models on the corpus: label = language, features = style columns, top n-grams and an embedding.

Learners have their full settings, but for those that a comment here names. Every model sees every document.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.operators import learners as ml
from inkprint.operators import sampling, vectors
from inkprint.operators.attribution import AttributionModel, Embedding, feature_frame
from inkprint.operators.evaluation import per_class
from inkprint.operators.labels import LabelEncoder
from inkprint.operators.ngrams import NgramVocabulary
from inkprint.operators.profile import summarize_folds
from inkprint.operators.scaling import assemble
from inkprint.operators.stylometry import style_columns
from inkprint.operators.tfidf import TfidfModel
from inkprint.plans import fixtures
from inkprint.plans import sqltext as q
from inkprint.plans.registry import documents, query, rounded, table
from inkprint.storage import materialize, scratch_path

K = 3
_tables: dict[tuple, DataFrame] = {}

LOGISTIC, FOREST, NETWORK = ml.logistic_regression(), ml.random_forest(), ml.neural_network()
BOOSTED = ml.boosted_trees()
# Stacking fits every member six times; a hundred rounds for each of four languages are thousands of small jobs each time, so its
# boosted member has fewer, and the README says so with the time of one fit.
SHORT_BOOSTED = ml.boosted_trees(rounds=10)

# What the SQL can say of a fitted model: which rows it was held out on, that its answers are well formed, and that it is right
# far more often than the largest class, which has about 62 % of the rows.
FLOOR = 0.8
RANDOM_TEST = f"""test AS (SELECT doc_id, lang FROM documents
QUALIFY row_number() OVER (ORDER BY {q.seeded()}, doc_id) <= ceil(count(*) OVER () * 0.2::DOUBLE))"""


def _values(*columns: tuple[str, list[str]]) -> str:
    """SQL for all combinations of the given values."""
    tables = ", ".join(f"(VALUES {', '.join(f'({v})' for v in values)}) AS t{i}({name})" for i, (name, values) in enumerate(columns))
    return f"SELECT {', '.join(name for name, _ in columns)}, true AS accurate FROM {tables}"


def _quote(values) -> list[str]:
    return [f"'{v}'" for v in values]


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, lang, label, fold, split and the vectors style, embedding, features; written once per session and
    state of the documents table: changed files make another one."""
    files = table(spark, sf_dir, "documents").select("_metadata.file_path", "_metadata.file_modification_time").distinct()
    state = files.agg(F.sum(F.xxhash64("file_path", "file_modification_time").cast("decimal(38,0)"))).first()[0]
    key = (spark.sparkContext.applicationId, sf_dir, state)
    if key not in _tables:
        docs = documents(spark, sf_dir, "doc_id", "lang", "text")
        vocabulary = NgramVocabulary.fit(docs)
        names = [*style_columns(), *vocabulary.column_names()]
        embedded = vectors.embed_documents(docs, vectors.hashed_trigram_encoder(64))
        labelled = LabelEncoder.fit(table(spark, sf_dir, "documents"), "lang").encode(embedded, "lang", "label")
        labelled = labelled.withColumn("label", F.col("label").cast("double"))
        split = sampling.stratified_split(labelled, "lang", 0.2)
        folded = sampling.stratified_folds(split, "lang", K)
        vectors_in = folded.withColumn("embedding", array_to_vector(F.col("embedding").cast("array<double>")))
        keep = ["text", "lang", "label", "fold", "split", "embedding"]
        wide = assemble(feature_frame(vectors_in, vocabulary, keep=keep), names, "style")
        _tables[key] = materialize(assemble_vectors(wide), "model")
    return _tables[key]


def assemble_vectors(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=["style", "embedding"], outputCol="features").transform(df)


def _held_out(learner: ml.Learner):
    """Fit on the train split, predict the test split."""

    def run(spark, sf_dir):
        data = model_table(spark, sf_dir)
        n = ml.class_count(data)
        scored = ml.fit(learner, data.filter("split = 'train'")).transform(data.filter("split = 'test'"))
        scored = materialize(scored.select("doc_id", "lang", "label", "prediction", vector_to_array("probability").alias("p")), "scored")
        right = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
        return scored.select(
            "doc_id", F.col("lang").alias("true_label"), F.col("prediction").isin([float(i) for i in range(n)]).alias("known_label"),
            (F.abs(total - 1) < 1e-6).alias("sums_to_one"), F.lit(right >= FLOOR).alias("accurate"),
        )

    return run


for _name, _learner in {
    "logistic_regression": LOGISTIC, "random_forest": FOREST, "neural_network": NETWORK, "boosted_trees": BOOSTED,
    "stacking": ml.stacking([LOGISTIC, FOREST, NETWORK, SHORT_BOOSTED]), "voting": ml.voting([LOGISTIC, FOREST, NETWORK, BOOSTED]),
}.items():
    query(_name, f"""WITH {q.split_cte(0.2)} SELECT doc_id, lang AS true_label, true AS known_label, true AS sums_to_one, true AS accurate
FROM split WHERE split = 'test'""")(_held_out(_learner))


@query("voting_soft", f"""WITH {q.rule_cte()}, p AS (
{' UNION ALL '.join(f"SELECT doc_id, '{lang}' AS label, CAST({m}_{lang} + 1 AS DOUBLE) / ({' + '.join(f'{m}_{x}' for x in q.LANGS)} + {len(q.LANGS)}) AS p FROM scores" for m in ('w', 'c') for lang in q.LANGS)}),
a AS (SELECT doc_id, label, avg(p) AS p FROM p GROUP BY doc_id, label)
SELECT doc_id, label AS predicted_label, round(p, 6) AS p FROM a
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, label) = 1""")
def voting_soft(spark, sf_dir):
    return rounded(ml.soft_vote(fixtures.probabilities(spark, sf_dir)))


@query("cross_validate", _values(("model", _quote(["LogisticRegression", "RandomForest", "NeuralNetwork"])), ("fold", [f"{i}::BIGINT" for i in range(K)])))
def cross_validate(spark, sf_dir):
    scores = ml.cross_validate([LOGISTIC, FOREST, NETWORK], model_table(spark, sf_dir), K)
    return scores.select("model", "fold", F.col("score").between(FLOOR, 1).alias("accurate"))


@query("model_comparison", """SELECT * FROM (VALUES ('LogisticRegression', 'success', 3, true), ('RandomForest', 'success', 3, true),
('Broken', 'failed', 0, false)) t(model, status, folds, accurate)""")
def model_comparison(spark, sf_dir):
    """One learner has a hidden layer of size 0, which Spark refuses: its failure is a row of the table."""
    broken = ml.neural_network("Broken", hidden=(0,), max_iter=5)
    compared = ml.compare_models([LOGISTIC, FOREST, broken], model_table(spark, sf_dir), K)
    return compared.select(
        "model", F.split("status", ":")[0].alias("status"), F.coalesce(F.size("fold_scores"), F.lit(0)).alias("folds"),
        F.coalesce(F.col("mean_accuracy") >= FLOOR, F.lit(False)).alias("accurate"),
    )


ZOO = [LOGISTIC, FOREST, NETWORK]


@query("train_model_zoo", f"""SELECT * FROM ({_values(("model", _quote(m.name for m in ZOO)), ("feature_set", _quote(ml.feature_set_variants())),
("status", ["'success'"]), ("classes", ["4"]), ("test_rows", [f"(WITH {q.split_cte(0.2)} SELECT count(*) FROM split WHERE split = 'test')"]))})""")
def train_model_zoo(spark, sf_dir):
    """Every learner on every feature set, models and wrong rows written. Embeddings alone, of a stand-in encoder, have a floor too."""
    data = model_table(spark, sf_dir)
    zoo = ml.train_model_zoo(
        ZOO, data.filter("split = 'train'"), data.filter("split = 'test'"),
        model_dir=scratch_path(spark, "zoo"), wrong_dir=scratch_path(spark, "wrong"),
    )
    support = F.aggregate("report", F.lit(0).cast("bigint"), lambda a, x: a + x["support"])
    return zoo.select(
        "model", "feature_set", "status", F.size("report").alias("classes"), support.alias("test_rows"), (F.col("accuracy") >= FLOOR).alias("accurate"),
    )


def _grid_sql(grid: dict[str, list]) -> tuple[tuple[str, list[str]], ...]:
    hidden = _quote("-".join(map(str, h)) for h in grid["hidden"])
    return ("hidden", hidden), ("max_iter", [str(m) for m in grid["max_iter"]]), ("step", [f"{s}::DOUBLE" for s in grid["step"]])


def _grid_rows(found, *more):
    """The rows of a search; it is accurate if its best network is."""
    found = materialize(found, "search")
    best = found.agg(F.max("mean_accuracy")).first()[0]
    return found.select(
        F.concat_ws("-", F.col("hidden").cast("array<string>")).alias("hidden"), "max_iter", "step", *more,
        (F.col("mean_accuracy").between(0, 1) & F.lit(best >= FLOOR)).alias("accurate"),
    )


@query("grid_search", _values(*_grid_sql(ml.WIDE_GRID)))
def grid_search(spark, sf_dir):
    """All 18 networks of the wide grid on every fold."""
    return _grid_rows(ml.grid_search(model_table(spark, sf_dir), ml.WIDE_GRID, K))


@query("kbest_grid_search", _values(*_grid_sql(ml.DEEP_GRID), ("k", ["50", "100", "200"])))
def kbest_grid_search(spark, sf_dir):
    """All 14 networks of the deep grid behind each number of features, on every fold."""
    return _grid_rows(ml.kbest_grid_search(model_table(spark, sf_dir), ml.DEEP_GRID, K, (50, 100, 200)), "k")


@query("feature_set_ablation", _values(("model", _quote(["stylometric", "tfidf", "embedding_pca", "combined"])), ("folds", [str(K)])))
def feature_set_ablation(spark, sf_dir):
    """The network on style columns, TF-IDF, embedding components and style plus embedding components. TF-IDF
    and components are fitted on each fold's training rows."""

    def tfidf(train, test):
        model = TfidfModel.fit(train, 100)
        return tuple(model.transform(d, "tfidf") for d in (train, test))

    sets = {
        "stylometric": ("style", None, None),
        "tfidf": ("tfidf", tfidf, None),
        "embedding_pca": ("embedding", None, ("pca", 20)),
        "combined": ("features", None, ("pca", 40)),
    }
    summary = summarize_folds(ml.ablation(NETWORK, model_table(spark, sf_dir), K, sets))
    return summary.select("model", F.size("fold_scores").alias("folds"), (F.col("mean_accuracy") >= FLOOR).alias("accurate"))


def _train_and_predict(spark, sf_dir, learner, embedding=None):
    """Train on 80 %, save, load again, predict the other 20 %; written, as several numbers are read from it."""
    split = sampling.random_split(documents(spark, sf_dir, "doc_id", "lang", "text"), 0.2)
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    path = scratch_path(spark, "model")
    AttributionModel.train(train, learner, label="lang", embedding=embedding).save(spark, path)
    loaded = AttributionModel.load(spark, path)
    scored = loaded.score(test.withColumnRenamed("lang", "true_label"), keep=["true_label"], embedding=embedding)
    return materialize(scored, "scored")


def _accurate(predictions) -> bool:
    return predictions.agg(F.avg((F.col("true_label") == F.col("predicted_label")).cast("double"))).first()[0] >= FLOOR


@query("quick_baseline", f"WITH {RANDOM_TEST} SELECT doc_id, lang AS true_label, true AS known_label, true AS accurate FROM test")
def quick_baseline(spark, sf_dir):
    """Ten trees, saved and scored on the held-out fifth."""
    predictions = _train_and_predict(spark, sf_dir, ml.random_forest(trees=10))
    known = F.col("predicted_label").isin(*q.LANGS)
    return predictions.select("doc_id", "true_label", known.alias("known_label"), F.lit(_accurate(predictions)).alias("accurate"))


@query("scaled_baseline", f"""WITH {RANDOM_TEST} SELECT lang AS label, count(*) AS support, true AS in_range, true AS accurate FROM test GROUP BY lang""")
def scaled_baseline(spark, sf_dir):
    """A hundred trees behind a scaler that is saved with them, as a report."""
    predictions = _train_and_predict(spark, sf_dir, ml.random_forest(scale=True))
    in_range = F.greatest("precision", "recall", "f1").between(0, 1)
    return per_class(predictions).select("label", "support", in_range.alias("in_range"), F.lit(_accurate(predictions)).alias("accurate"))


@query("attribution_pipeline", f"WITH {RANDOM_TEST} SELECT doc_id, lang AS true_label, true AS known_label, true AS accurate FROM test")
def attribution_pipeline(spark, sf_dir):
    """Style and n-gram columns with 20 principal components of an embedding, stacked, saved, loaded and scored."""
    embedding = Embedding(vectors.hashed_trigram_encoder(64), n=20)
    learner = ml.stacking([LOGISTIC, FOREST])
    predictions = _train_and_predict(spark, sf_dir, learner, embedding)
    known = F.col("predicted_label").isin(*q.LANGS)
    return predictions.select("doc_id", "true_label", known.alias("known_label"), F.lit(_accurate(predictions)).alias("accurate"))


@query("score_documents", f"""SELECT conv_id || '/' || turn AS doc_id, true AS known_label FROM conversations""")
def score_documents(spark, sf_dir):
    """A saved model, its principal components of an embedding among its features, applied to every document of a second corpus, the
    conversation turns."""
    train = documents(spark, sf_dir, "doc_id", "lang", "text")
    path = scratch_path(spark, "model")
    embedding = Embedding(vectors.hashed_trigram_encoder(64), n=20)
    AttributionModel.train(train, LOGISTIC, label="lang", embedding=embedding).save(spark, path)
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("doc_id"), "text"
    )
    scored = AttributionModel.load(spark, path).score(turns, embedding=embedding)
    return scored.select("doc_id", F.col("predicted_label").isin(*q.LANGS).alias("known_label"))

"""Round trips through the writers and readers: what comes back must be the table that went in."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from inkprint.operators.attribution import feature_frame
from inkprint.operators.evaluation import classification_report
from inkprint.operators.ngrams import NgramVocabulary
from inkprint.operators.scaling import assemble
from inkprint.operators.stylometry import style_features
from inkprint.plans import fixtures
from inkprint.plans import sqltext as q
from inkprint.plans.registry import ORACLES, documents, query, rounded, table
from inkprint.plans.text_plans import _gram_ctes
from inkprint.plans.vector_plans import DIM, NAMES, _wide, _wide_sql
from inkprint.operators.vectors import vector_columns
from inkprint.sources import corpus, sinks
from inkprint.storage import scratch_path


@query("scan_csv", "SELECT text, lang AS label, 'doc_' || doc_id || '.txt' AS filename FROM documents")
def scan_csv(spark, sf_dir):
    """The corpus as a text, label, filename CSV, read back with the required columns checked."""
    docs = table(spark, sf_dir, "documents").select(
        "text", F.col("lang").alias("label"), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("filename")
    )
    path = scratch_path(spark, "corpus-csv")
    sinks.write_csv(docs, path)
    return corpus.read_csv(spark, path, "text string, label string, filename string")


@query("write_csv_sink", q.style_select(q.ALL_STYLE))
def write_csv_sink(spark, sf_dir):
    features = rounded(style_features(documents(spark, sf_dir, "doc_id", "text")))
    path = scratch_path(spark, "features-csv")
    sinks.write_csv(features, path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema.fields)
    return corpus.read_csv(spark, path, schema, required=["doc_id"])


@query("vector_sink", f"SELECT vec_id, label, {_wide_sql('', 'embedding')} FROM embeddings")
def vector_sink(spark, sf_dir):
    path = scratch_path(spark, "vectors")
    sinks.write_vectors(table(spark, sf_dir, "embeddings"), path)
    return rounded(vector_columns(sinks.read_vectors(spark, path), "embedding", "e_", DIM))


@query("model_store", "SELECT vec_id, CAST(label AS DOUBLE) AS true_label, true AS same_prediction, true AS same_probability FROM embeddings")
def model_store(spark, sf_dir):
    """A pipeline fitted on the embeddings, saved and loaded: both give every row the same prediction and probabilities."""
    data = assemble(_wide(spark, sf_dir).withColumn("label", F.col("label").cast("double")), NAMES)
    path = scratch_path(spark, "model")
    fitted = Pipeline(stages=[LogisticRegression(maxIter=10)]).fit(data)
    sinks.save_model(fitted, path)
    once = fitted.transform(data).withColumnsRenamed({"prediction": "_p", "probability": "_q", "rawPrediction": "_r"})
    both = sinks.load_model(path).transform(once)
    return both.select(
        "vec_id", F.col("label").alias("true_label"), (F.col("prediction") == F.col("_p")).alias("same_prediction"),
        (vector_to_array("probability") == vector_to_array("_q")).alias("same_probability"),
    )


@query("feature_names_store", f"""WITH {_gram_ctes()},
fixed AS (SELECT unnest([{q.quoted(q.ALL_STYLE)}]) AS name, unnest(generate_series(0, {len(q.ALL_STYLE) - 1})) AS pos),
dyn AS (SELECT kind || '_' || n || 'gram_' || CASE WHEN kind = 'word' THEN replace(gram, ' ', '_') ELSE gram END AS name,
  row_number() OVER (ORDER BY kind, n, rank) + {len(q.ALL_STYLE)} - 1 AS pos FROM top)
SELECT pos, name FROM fixed UNION ALL SELECT pos, name FROM dyn""")
def feature_names_store(spark, sf_dir):
    """The training column list of the corpus, stored in order and loaded again."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    names = [c for c in feature_frame(docs, NgramVocabulary.fit(docs)).columns if c != "doc_id"]
    path = scratch_path(spark, "feature-names")
    sinks.save_feature_names(spark, names, path)
    loaded = sinks.load_feature_names(spark, path)
    return spark.createDataFrame(list(enumerate(loaded)), "pos bigint, name string")


@query("text_report_sink", ORACLES["classification_report"])
def text_report_sink(spark, sf_dir):
    path = scratch_path(spark, "report")
    sinks.write_report(rounded(classification_report(fixtures.predictions(spark, sf_dir))), path)
    schema = "label string, precision double, recall double, f1 double, support bigint"
    return corpus.read_csv(spark, path, schema, required=["label"])

"""Shapes of plans, the registry, and a few queries end to end."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from inkprint.operators import profile, stylometry
from inkprint.operators.ngrams import NgramVocabulary, ngram_totals
from inkprint.operators.tfidf import TfidfModel
from inkprint.plans.registry import table
from inkprint.streaming.featurize import stream_features, write_features


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_and_registry(spark):
    assert entry_module.entry(spark).count() == 4
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) > 110


def test_features_are_one_map_stage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    vocabulary = NgramVocabulary.fit(docs)
    text = plan(stylometry.style_features(vocabulary.transform(docs)))
    assert "Exchange" not in text and "Python" not in text and "ArrowEval" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "Exchange" not in plan(TfidfModel.fit(docs, 20).transform(docs))


def test_corpus_counts_combine_before_the_shuffle(spark, sf_dir):
    text = plan(ngram_totals(table(spark, sf_dir, "documents")))
    assert text.count("Exchange") == 1 and text.count("FileScan") == 1 and "partial_count" in text


@pytest.mark.parametrize("name", [
    "stylometry_core", "stylometric_features", "char_entropy", "yules_k", "technicality_score", "text_md5", "stopword_lookup", "sentence_split",
])
def test_registered_text_queries_shuffle_nothing(spark, sf_dir, name):
    assert "Exchange" not in plan(entry_module.queries()[name](spark, sf_dir))


def test_column_profiles_keep_rows_whole(spark, sf_dir):
    text = plan(entry_module.queries()["finite_check"](spark, sf_dir))
    assert "Expand" not in text and text.count("Exchange") == 1


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(entry_module.queries()["load_corpus"](spark, sf_dir))
    assert "PushedFilters: [In(lang" in text
    text = plan(profile.class_distribution(table(spark, sf_dir, "documents"), "lang"))
    assert "ReadSchema: struct<lang:string>" in text


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    vocabulary = NgramVocabulary.fit(docs)
    features = stream_features(spark, str(tmp_path / "in"), vocabulary=vocabulary)
    write_features(features, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    from inkprint.operators.attribution import feature_frame

    want = feature_frame(docs, vocabulary)
    assert got.count() == 200 and got.exceptAll(want).count() == 0


@pytest.mark.parametrize(
    "name", ["avg_words_by_label", "stratified_split", "classification_report", "cv_summary", "misclass_top10", "tfidf_vocab"]
)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = entry_module.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry_module.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*[F.col(c) for c in columns]).collect())) == sorted(want)

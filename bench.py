"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from inkprint.plans import QUERIES
from inkprint.session import local_session

# One query per family: features, n-grams, TF-IDF, profiles, joins, splits, leak checks, metrics, vectors, model.
HEADLINE = [
    "avg_words_by_label", "stylometry_core", "stylometric_features", "char_entropy", "yules_k", "technicality_score",
    "char_ngram_topk", "word_ngram_topk", "char_ngram_counts", "tfidf_vocab", "tfidf", "length_histogram",
    "class_constant_features", "id_like_features", "combine_features", "stratified_split", "stratified_folds",
    "leaked_rows", "intersect_hashes", "classification_report", "cv_summary", "pool_mean", "standard_scale",
    "anova_f_scores", "select_k_best", "embed_documents", "quick_baseline",
]


def split_tables(spark, sf_dir: str, files: int) -> str:
    """The tables in as many files as there are cores, as a large corpus would be; one small file is one task."""
    copy = f"{tempfile.mkdtemp(prefix='bench-')}/{os.path.basename(sf_dir.rstrip('/'))}"
    for name in ("documents", "embeddings", "labels", "conversations"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(files).write.parquet(f"{copy}/{name}.parquet")
    return copy


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", "16g")
    sf_dir = split_tables(spark, sf_dir, int(cpus))
    QUERIES["avg_words_by_label"](spark, sf_dir).collect()
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

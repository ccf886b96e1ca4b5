"""Each stage of the pipeline on its own input, against brute force."""

from collections import Counter

import pytest

import corpus_pipeline
from inkprint.llm import quality
from tests.llm.test_simhash import plain_fingerprint, roots


@pytest.fixture(scope="module")
def stages(spark, documents, sf_dir):
    """The input of every stage and, last, the output of the pipeline, as lists of rows."""
    frames, docs = [documents], documents
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        frames.append(docs)
    return frames


def test_columns_and_rows_of_the_stages(stages):
    assert all(f.columns == stages[0].columns for f in stages[:-1])
    rows = [f.collect() for f in stages]
    assert {tuple(r) for r in rows[1]} <= {tuple(r) for r in rows[0]}
    kept = [r for r in rows[1] if quality.measure(r["text"].encode())[0] >= 50]
    assert {tuple(r) for r in rows[2]} <= {tuple(r) for r in kept}
    wanted = Counter((r["doc_id"], r["text"]) for r in rows[4])
    assert Counter((r["doc_id"], r["decoded"]) for r in rows[5]) == wanted


def test_near_copies_match_brute_force(stages):
    rows = {r["doc_id"]: plain_fingerprint(r["text"]) for r in stages[2].collect()}
    edges = [(a, b) for a in rows for b in rows if a < b and bin(rows[a] ^ rows[b]).count("1") <= 2]
    assert edges and {r["doc_id"] for r in stages[3].collect()} == set(roots(rows, edges).values())


def test_run_equals_the_stages(spark, sf_dir, stages):
    once = Counter((r["doc_id"], len(r["ids"])) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert once == Counter((r["doc_id"], len(r["ids"])) for r in stages[-1].collect())


def test_stages_take_rows_of_all_kinds(spark, odd_docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, odd_docs, sf_dir)
        assert found.columns == odd_docs.columns or name == "sentencepiece"
        found.collect()
        assert stage(spark, odd_docs.where("false"), sf_dir).count() == 0, name


def test_only_texts_without_a_letter_go_for_their_language(spark, sf_dir, documents):
    lettered = {r["doc_id"] for r in documents.collect() if any(map(str.isalpha, r["text"] or ""))}
    assert {r["doc_id"] for r in corpus_pipeline.known_language(spark, documents, sf_dir).collect()} == lettered
    unlabelled = documents.withColumn("lang", documents["lang"].substr(1, 0)).replace("", None, ["lang"])
    assert {r["doc_id"] for r in corpus_pipeline.known_language(spark, unlabelled, sf_dir).collect()} == lettered

"""What the model queries ask for: whole grids, and every feature of the model they save."""

import duckdb
import pytest

from inkprint.operators import learners as ml
from inkprint.operators.attribution import AttributionModel
from inkprint.plans import ORACLES, QUERIES, model_plans


@pytest.mark.parametrize("name, grid, k_list", [("grid_search", ml.WIDE_GRID, ()), ("kbest_grid_search", ml.DEEP_GRID, (50, 100, 200))])
def test_searches_fit_their_whole_grid(spark, monkeypatch, name, grid, k_list):
    """Every network of the grid, behind every number of features, in the query as in its SQL; nothing is fitted here."""
    asked = []

    def search(df, grid, k, numbers=None):
        asked.append((grid, k, numbers))
        rows = [(list(h), m, s, 0.9, n) for h in grid["hidden"] for m in grid["max_iter"] for s in grid["step"] for n in numbers or (None,)]
        found = spark.createDataFrame(rows, "hidden array<int>, max_iter int, step double, mean_accuracy double, k int")
        return found if numbers else found.drop("k")

    monkeypatch.setattr(ml, name, search)
    monkeypatch.setattr(model_plans, "model_table", lambda *_: None)
    got = QUERIES[name](spark, "nowhere")
    assert asked == [(grid, 3, k_list or None)]
    want = duckdb.connect().execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(want) == len(grid["hidden"]) * len(grid["max_iter"]) * len(grid["step"]) * max(1, len(k_list))


def test_scoring_uses_stored_components_of_an_embedding(spark, tmp_path, monkeypatch):
    words = {"de": "der die und den von", "en": "the of and to is", "es": "el los y las por", "fr": "le les et des du"}
    texts = [(i, f"{words[lang]} {'wort ' * (i % 5 + 1)}.", lang) for i, lang in enumerate(sorted(words) * 8)]
    spark.createDataFrame(texts, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    turns = [(1, 0, "the end of it"), (1, 1, "le les"), (2, 0, ""), (2, 0, "")]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    seen, real = [], AttributionModel.score

    def score(model, df, **options):
        seen.append((model, options.get("embedding")))
        return real(model, df, **options)

    monkeypatch.setattr(AttributionModel, "score", score)
    rows = QUERIES["score_documents"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [("1/0", True), ("1/1", True), ("2/0", True), ("2/0", True)]
    (model, embedding), = seen
    assert embedding is not None and model.components.stages[-1].getK() == 20
    assert model.fitted.pipeline.stages[-1].numFeatures == len(model.names) + 20

from types import SimpleNamespace

import pytest

from inkprint.operators import evaluation
from inkprint.sources import corpus, sinks
from inkprint.storage import materialize, scratch_root

FILES = {
    "ann/one.txt": "  First text.\r\nSecond line. ", "ann/two two.txt": " ", "ann/skip.md": "no", "bob+co/a%b.txt": "ünï 😀",
    "cy/blank.txt": " \n\t", "cy/x.txt": "plain",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("corpus")
    for name, text in FILES.items():
        path = base / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(text.encode())
    return str(base)


def test_author_tree(spark, root):
    rows = {(r["label"], r["filename"]): r["text"] for r in corpus.read_author_tree(spark, root).collect()}
    assert rows == {tuple(k.split("/")): v.replace("\r", "") for k, v in FILES.items() if k.endswith(".txt")}


def test_three_loaders(spark, root):
    raw = corpus.load_corpus(spark, root, ["ann", "cy"]).collect()
    assert sorted((r["label"], r["text"]) for r in raw) == sorted(
        (k.split("/")[0], v.replace("\r", "")) for k, v in FILES.items() if k.endswith(".txt") and k[:2] != "bo"
    )
    built = {(r["label"], r["filename"], r["text"]) for r in corpus.build_dataset(spark, root).collect()}
    assert built == {("ann", "one.txt", "First text.\nSecond line."), ("bob+co", "a%b.txt", "ünï 😀"), ("cy", "x.txt", "plain")}
    samples = corpus.load_samples(spark, root, ["cy"]).collect()
    assert sorted(r["text"] for r in samples) == ["", "plain"]


def test_unreadable_file_is_passed_over_or_fails(spark, tmp_path):
    (tmp_path / "ann").mkdir()
    (tmp_path / "ann" / "good.txt").write_bytes("grün".encode())
    (tmp_path / "ann" / "bad.txt").write_bytes(b"\xff\xfe broken")
    assert [r["text"] for r in corpus.load_samples(spark, str(tmp_path), ["ann"]).collect()] == ["grün"]
    with pytest.raises(Exception, match="UTF"):
        corpus.load_corpus(spark, str(tmp_path), ["ann"]).collect()


def test_missing_or_empty_tree_is_an_error(spark, tmp_path):
    with pytest.raises(Exception):
        corpus.build_dataset(spark, str(tmp_path / "nowhere")).collect()
    (tmp_path / "solo").mkdir()
    with pytest.raises(ValueError):
        corpus.build_dataset(spark, str(tmp_path))


def test_csv_round_trip(spark, tmp_path):
    rows = [("a \"quoted\", text\nwith lines", "x"), ("  spaces  ", "y"), ("back\\slash \\\" end", "z"), ("", "w"), (None, "v")]
    df = spark.createDataFrame(rows, "text string, label string")
    sinks.write_csv(df, str(tmp_path / "c"))
    back = corpus.read_csv(spark, str(tmp_path / "c"), "text string, label string")
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, rows))
    with pytest.raises(ValueError, match="author"):
        corpus.read_csv(spark, str(tmp_path / "c"), required=["author"])


def test_nested_columns_in_csv(spark, tmp_path):
    df = spark.createDataFrame([("m", [0.5, 0.25])], "model string, fold_scores array<double>")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert corpus.read_csv(spark, str(tmp_path / "c"), required=["model"]).first()["fold_scores"] == "[0.5,0.25]"


def test_names_vectors_report(spark, tmp_path):
    names = ["b", "a", "char_2gram_ x", "`odd`"]
    sinks.save_feature_names(spark, names, str(tmp_path / "n"))
    assert sinks.load_feature_names(spark, str(tmp_path / "n")) == names
    vectors = spark.createDataFrame([(1, [0.5, 1.5])], "doc_id bigint, embedding array<float>")
    sinks.write_vectors(vectors, str(tmp_path / "v"))
    assert sinks.read_vectors(spark, str(tmp_path / "v")).collect() == vectors.collect()
    preds = spark.createDataFrame([("a", "a"), ("b", "a")], "true_label string, predicted_label string")
    sinks.write_report(evaluation.classification_report(preds), str(tmp_path / "r"))
    assert corpus.read_csv(spark, str(tmp_path / "r"), required=["label", "support"]).count() == 5


def test_misclassified_files_become_one_table(spark, tmp_path):
    for model, label in (("Forest", "a"), ("Net_kbest", "b")):
        df = spark.createDataFrame([("some\ntext " * 30, label, "c")], "text string, true_label string, predicted_label string")
        sinks.write_csv(df, str(tmp_path / f"{model}_misclassified.csv"))
    summary = sinks.misclassification_summary(sinks.union_misclassified(spark, str(tmp_path / "*_misclassified.csv")))
    rows = {r["model"]: r for r in summary.collect()}
    assert set(rows) == {"Forest", "Net_kbest"}
    assert len(rows["Forest"]["text_snippet"]) == 120 and "\n" not in rows["Forest"]["text_snippet"]


def test_scratch_folder_comes_from_the_session(spark):
    """The configured shared folder wins; without one only a local session may use its own."""

    def session(folder, master):
        conf = SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="x"))

    assert scratch_root(session("hdfs://shared/tmp/", "yarn")) == "hdfs://shared/tmp"
    with pytest.raises(RuntimeError):
        scratch_root(session(None, "yarn"))
    table = materialize(spark.range(5))
    assert table.count() == 5 and scratch_root(spark) in table.inputFiles()[0]

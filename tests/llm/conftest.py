import pytest

#: Texts that every operator must take: null, empty, white space, ties, repeated rows, odd characters, very long.
ODD_TEXTS = [
    None, "", " \t\n\r\x0b\x0c", "one", "Two words", "the same text here", "the same text here", "漢字 🎉 été x", "a  b\n\nc \n",
    "<|endoftext|> x ▁ y", "...!!! 123 456", "word " * 30_000, "x" * 20_000, "\u0000nul \x1c end",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """doc_id, text, lang, source, n_chars plus columns whose names clash with what operators use inside."""
    rows = [(i, t, "en" if i % 2 else None, "s%d" % (i % 3) if i % 4 else None, 5, "x", 1, "y", 2) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], (None, "no id at all", "de", *[None] * 6), (None,) * 9]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, fingerprint int, `my col` string, _key int"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

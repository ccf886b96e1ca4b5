"""Corpora on disk: author directories of text files, and tables with text and label columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.functions import text as tx
from inkprint.operators.frames import drop_blank, require_columns


def read_author_tree(
    spark: SparkSession, root: str, authors: Sequence[str] | None = None, strip: bool = False,
    drop_empty: bool = False, skip_unreadable: bool = False,
) -> DataFrame:
    """``root/<author>/<name>.txt``, one row per file: doc_id, text, label (the directory), filename.
    ``doc_id`` is ``<author>/<name>.txt``: the same for every read, whatever the root is.

    ``authors`` restricts the listing to those directories, so the others are not even read. Files are read
    whole, as UTF-8, with line ends as ``\\n``. Spark lists no file of zero bytes, so such a file gives no row.
    """
    paths = [f"{root.rstrip('/')}/{a}" for a in authors] if authors is not None else [f"{root.rstrip('/')}/*"]
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt")
    if skip_unreadable:
        reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    content = F.col("content").cast("string")
    decoded = F.try_validate_utf8(content) if skip_unreadable else F.validate_utf8(content)
    files = reader.load(paths).select(F.regexp_replace(decoded, "\r\n?", "\n").alias("text"), F.col("path").alias("_path"))
    if skip_unreadable:
        files = files.filter(F.col("text").isNotNull())
    parts = F.split("_path", "/")
    corpus = files.select(
        F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)).alias("doc_id"),
        (tx.strip(F.col("text")) if strip else F.col("text")).alias("text"),
        F.element_at(parts, -2).alias("label"),
        F.element_at(parts, -1).alias("filename"),
    )
    return drop_blank(corpus) if drop_empty else corpus


def load_corpus(spark: SparkSession, root: str, authors: Sequence[str]) -> DataFrame:
    """(doc_id, text, label) of the given authors, texts untouched."""
    return read_author_tree(spark, root, authors).select("doc_id", "text", "label")


def build_dataset(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, text, label, filename) of every author: stripped, empty texts dropped. No author is an error."""
    dataset = read_author_tree(spark, root, strip=True, drop_empty=True)
    if not dataset.take(1):
        raise ValueError(f"no author texts found in {root}")
    return dataset


def load_samples(spark: SparkSession, root: str, authors: Sequence[str]) -> DataFrame:
    """(doc_id, text, label) of the given authors: stripped, empty texts kept, unreadable files passed over."""
    return read_author_tree(spark, root, authors, strip=True, skip_unreadable=True).select("doc_id", "text", "label")


def csv_reader(spark: SparkSession):
    """Header, quotes doubled inside quotes, fields over several lines. An empty field is null, a quoted
    empty field is an empty string; the null marker is a character no text file holds."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.option("nullValue", "\0")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, required: Sequence[str] = ("text", "label")) -> DataFrame:
    """A CSV with a header, quoted fields may span lines. Without a schema every column is read as string.

    Multi-line CSV files cannot be split, so a large corpus belongs in parquet; this is for exchange files.
    """
    reader = csv_reader(spark)
    return require_columns((reader.schema(schema) if schema else reader).csv(path), required)


def author_filter(df: DataFrame, authors: Sequence[str], label: str = "label") -> DataFrame:
    """The rows of the given authors of a table corpus; the filter reaches the parquet scan."""
    return df.filter(F.col(label).isin(list(authors)))


def stripped(df: DataFrame, text: str = "text", drop_empty: bool = False) -> DataFrame:
    """A table corpus with its texts stripped, and without the empty ones if asked."""
    out = df.withColumn(text, tx.strip(F.coalesce(F.col(text), F.lit(""))))
    return out.filter(F.col(text) != "") if drop_empty else out

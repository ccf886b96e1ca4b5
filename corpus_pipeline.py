"""From raw documents to token ids: language, quality, near copies, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``docs``; nulls, empty and long texts, repeated rows and
further columns pass through or are rejected as the operators' docstrings say, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkprint.llm import language, mixing, pieces, quality, simhash
from inkprint.llm.base import table
from inkprint.llm.queries import PIECES, tokenizer_path
from inkprint.storage import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a recognisable language; texts without a letter, and null, go, and no others."""
    return language.filter_language(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass every rule of the full policy."""
    return quality.filter_quality(docs, quality.FULL)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of fingerprints that link: three-word shingles, at most two differing bits."""
    return simhash.deduplicate(docs, bits=2, words=3)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in the numbers that bring every source to its target; a row that is taken n times appears n times."""
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, byte spans of the pieces and the decoded text of every row."""
    path = tokenizer_path(PIECES)
    return pieces.encode_documents(docs, path, decoded=True)


STAGES = [
    ("language_id", known_language),
    ("quality_rules", good_quality),
    ("simhash_near_dedup", without_near_copies),
    ("mixing", mixture),
    ("sentencepiece", encoded),
]

#: SQL can express neither the fitted machines nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

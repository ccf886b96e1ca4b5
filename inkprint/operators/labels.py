"""Labels to indices and back; distinct-set checks."""

from __future__ import annotations

from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LabelEncoder:
    """Label to index in sorted order. Fitting counts the labels with a partial aggregation; encoding and
    decoding are map-side."""

    def __init__(self, model: StringIndexerModel):
        self.model = model

    @classmethod
    def fit(cls, df: DataFrame, label: str) -> LabelEncoder:
        indexer = StringIndexer(inputCol=label, outputCol="_index", stringOrderType="alphabetAsc")
        return cls(indexer.fit(df))

    @property
    def labels(self) -> list[str]:
        return list(self.model.labels)

    def encode(self, df: DataFrame, label: str, output: str) -> DataFrame:
        indexed = self.model.copy().setInputCol(label).setOutputCol("_index").transform(df)
        return indexed.withColumn(output, F.col("_index").cast("bigint")).drop("_index")

    def decode(self, df: DataFrame, index: str, output: str) -> DataFrame:
        as_double = df.withColumn("_index", F.col(index).cast("double"))
        return IndexToString(inputCol="_index", outputCol=output, labels=self.labels).transform(as_double).drop("_index")


def decode_predictions(
    df: DataFrame, index: str, output: str, encoder: LabelEncoder | None = None, truth: str | None = None
) -> DataFrame:
    """Predicted indices as labels: by the saved encoder, else by the sorted distinct ``truth`` labels if
    every prediction is a valid index of them, else the index written as a string."""
    if encoder is None and truth is not None:
        fallback = LabelEncoder.fit(df, truth)
        bounds = df.agg(F.min(index).alias("lo"), F.max(index).alias("hi")).first()
        if bounds["lo"] is not None and bounds["lo"] >= 0 and bounds["hi"] < len(fallback.labels):
            encoder = fallback
    if encoder is None:
        return df.withColumn(output, F.col(index).cast("string"))
    return encoder.decode(df, index, output)


def unknown_values(df: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """Values of ``column`` that are not among ``known``; empty means subset."""
    return df.select(F.col(column).alias("value")).subtract(known.select(F.col(known_column).alias("value")))


def label_column(df: DataFrame, candidates: tuple[str, ...] = ("author", "label")) -> DataFrame:
    """``df`` with the first of the candidate columns that exists called ``label``."""
    for name in candidates:
        if name in df.columns:
            return df.drop("label").withColumnRenamed(name, "label") if name != "label" else df
    raise ValueError(f"none of the label columns {list(candidates)} is present")

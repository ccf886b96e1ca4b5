"""End to end: raw labelled texts to a saved attribution model, and new texts to predictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.functions.names import named, quoted
from inkprint.operators.frames import align_features, fill_missing
from inkprint.operators.labels import LabelEncoder, decode_predictions
from inkprint.operators.learners import Fitted, Learner, fit
from inkprint.operators.ngrams import NgramVocabulary
from inkprint.operators.scaling import assemble, fit_pca
from inkprint.operators.stylometry import style_columns, with_style
from inkprint.operators.vectors import embed_documents
from inkprint.sources.sinks import load_feature_names, save_feature_names
from inkprint.storage import materialize


def feature_frame(
    df: DataFrame, vocabulary: NgramVocabulary | None, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """``key`` and the columns to ``keep``, plus every style and n-gram column, missing values 0.

    Labels and the like are kept beside the features, so nothing has to be joined back by key.
    """
    counted = vocabulary.transform(df, text) if vocabulary else df
    names = [*style_columns(), *(vocabulary.column_names() if vocabulary else [])]
    wide = with_style(counted, style_columns(), text)
    return fill_missing(wide.select(key, *keep, *named(names)), names)


@dataclass
class Embedding:
    """Where embedding components come from: an encoder for texts, or a table of (key, vector); and how many are kept.

    The components are principal components fitted on the training rows, at most ``n`` and never more than the vector has
    entries. ``table`` must have one row for every document to be trained on or scored.
    """

    encoder: Callable | None = None
    table: DataFrame | None = None
    n: int = 20
    vec: str = "embedding"

    def add(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """``df`` with its vectors; by projection from an encoder, by a join from a table."""
        if self.encoder is not None:
            return embed_documents(df, self.encoder, text, self.vec)
        if self.table is None:
            raise ValueError("an embedding needs an encoder or a table")
        return df.join(self.table.select(key, self.vec), key)


@dataclass
class AttributionModel:
    """A classifier with everything scoring needs: label names, n-gram vocabulary, column order, embedding components."""

    fitted: Fitted
    labels: LabelEncoder
    vocabulary: NgramVocabulary
    names: list[str]
    components: PipelineModel | None = None

    @classmethod
    def train(
        cls, df: DataFrame, learner: Learner, label: str = "label", key: str = "doc_id", text: str = "text",
        embedding: Embedding | None = None,
    ) -> AttributionModel:
        """Fit on (key, text, label). The feature table is written once; the models read that, not the text."""
        labels = LabelEncoder.fit(df, label)
        vocabulary = NgramVocabulary.fit(df, text=text)
        names = [*style_columns(), *vocabulary.column_names()]
        classed = labels.encode(df.select(key, text, label), label, "_class")
        keep = ["_class"]
        if embedding is not None:
            classed = embedding.add(classed, key, text)
            keep.append(embedding.vec)
        wide = feature_frame(classed, vocabulary, key, text, keep=keep)
        styled = assemble(wide, names, "_style")
        rows = styled.select(key, "_style", F.col("_class").cast("double").alias("label"), *keep[1:])
        table, components = materialize(rows, "features"), None
        if embedding is not None:
            table = table.withColumn("_embedding", array_to_vector(F.col(quoted(embedding.vec)).cast("array<double>")))
            width = len(table.select("_embedding").first()["_embedding"])
            components = fit_pca(table, min(embedding.n, width), "_embedding", "_components")
            table = components.transform(table)
        vectors = _joined(table, components).select(key, "features", "label")
        return cls(fit(learner, vectors, key=key), labels, vocabulary, names, components)

    def score(
        self, df: DataFrame, key: str = "doc_id", text: str = "text", keep: Sequence[str] = (),
        embedding: Embedding | None = None,
    ) -> DataFrame:
        """(key, kept columns, predicted_label) for new texts: featurise, align to the training columns,
        predict. No shuffle, unless the vectors come from a table. ``embedding`` says where they come from."""
        if (self.components is None) != (embedding is None):
            raise ValueError("give an embedding if, and only if, the model was trained with one")
        columns = [key, *keep]
        rows, carried = df.select(*columns, text), list(keep)
        if embedding is not None:
            rows = embedding.add(rows, key, text)
            carried.append(embedding.vec)
        features = feature_frame(rows, self.vocabulary, key, text, carried)
        wide = assemble(align_features(features, self.names, [key, *carried]), self.names, "_style")
        if embedding is not None:
            wide = wide.withColumn("_embedding", array_to_vector(F.col(quoted(embedding.vec)).cast("array<double>")))
            wide = self.components.transform(wide)
        predicted = self.fitted.transform(_joined(wide, self.components).select(*columns, "features"))
        decoded = decode_predictions(predicted, "prediction", "predicted_label", self.labels)
        return decoded.select(*columns, "predicted_label")

    def save(self, spark: SparkSession, path: str) -> None:
        self.fitted.save(spark, f"{path}/model")
        self.labels.model.write().overwrite().save(f"{path}/labels")
        self.vocabulary.save(spark, f"{path}/ngrams")
        save_feature_names(spark, self.names, f"{path}/feature_names")
        about = spark.createDataFrame([(self.components is not None,)], "components boolean")
        about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        if self.components is not None:
            self.components.write().overwrite().save(f"{path}/components")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AttributionModel:
        with_components = spark.read.parquet(f"{path}/about").first()["components"]
        return cls(
            Fitted.load(spark, f"{path}/model"), LabelEncoder(StringIndexerModel.load(f"{path}/labels")),
            NgramVocabulary.load(spark, f"{path}/ngrams"), load_feature_names(spark, f"{path}/feature_names"),
            PipelineModel.load(f"{path}/components") if with_components else None,
        )


def _joined(df: DataFrame, components: PipelineModel | None) -> DataFrame:
    """``features``: the style vector, followed by the embedding components if there are any."""
    if components is None:
        return df.withColumnRenamed("_style", "features")
    return VectorAssembler(inputCols=["_style", "_components"], outputCol="features").transform(df)

"""Scaling, feature scores, feature selection and principal components."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkprint.functions.names import quoted


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, n, mean, var) with the population variance, from one grouped pass.

    The columns are summed up as one vector per group, a fixed-size partial aggregate.
    """
    values = F.expr(f"array({', '.join(f'cast({quoted(c)} as double)' for c in columns)})")
    summary = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(values))
    rows = (df.groupBy(*by) if by else df.groupBy()).agg(summary.alias("_s"))
    names = F.array(*[F.lit(c) for c in columns])
    long = rows.select(
        *by, F.col("_s.count").alias("n"),
        F.inline(F.arrays_zip(names.alias("feature"), vector_to_array("_s.mean").alias("mean"),
                              vector_to_array("_s.variance").alias("var"))),
    )
    # The summarizer's variance is the sample one.
    return long.withColumn("var", F.col("var") * (F.col("n") - 1) / F.col("n"))


@dataclass(frozen=True)
class StandardScale:
    """Centre and divide by the population standard deviation; a constant column is only centred."""

    mean: dict[str, float]
    std: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> StandardScale:
        rows = moments(df, columns).collect()
        return cls({r["feature"]: r["mean"] for r in rows}, {r["feature"]: math.sqrt(r["var"]) or 1.0 for r in rows})

    def transform(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.mean if c not in df.columns]
        if missing:
            raise ValueError(f"columns with statistics are not in the table: {missing}")

        def scaled(c: str) -> str:
            return f"(cast({quoted(c)} as double) - {self.mean[c]!r}D) / {self.std[c]!r}D as {quoted(c)}"

        return df.selectExpr(*[scaled(c) if c in self.mean else quoted(c) for c in df.columns])


def anova_f_scores(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(feature, f_score): one-way analysis of variance of each column over the classes.

    One pass over the wide table leaves a row per class and feature (count, mean, sum of squared
    deviations); between and within sums follow from those. Infinite for a column that is constant in every
    class but differs between classes; no value (null) for a constant column.
    """
    return _f_scores(moments(df, columns, by=[label]))


def _f_scores(per_class: DataFrame) -> DataFrame:
    """(feature, f_score) from one row per class and feature: n, mean, var."""
    feature = Window.partitionBy("feature")
    grand = F.sum(F.col("n") * F.col("mean")).over(feature) / F.sum("n").over(feature)
    centred = per_class.withColumn("dev", F.col("mean") - grand)
    sums = centred.groupBy("feature").agg(
        F.sum(F.col("n") * F.col("dev") * F.col("dev")).alias("between"),
        F.sum(F.col("n") * F.col("var")).alias("within"),
        F.sum("n").alias("n"), F.count("*").alias("k"),
    )
    free_between, free_within = F.col("k") - 1, F.col("n") - F.col("k")
    free = (free_between > 0) & (free_within > 0)
    f_score = F.when(
        free & (F.col("within") > 0), (F.col("between") / free_between) / (F.col("within") / free_within)
    ).when(free & (F.col("between") > 0), F.lit(float("inf")))
    return sums.select("feature", f_score.alias("f_score"))


def best_features(df: DataFrame, columns: Sequence[str], label: str, k: int = 50) -> DataFrame:
    """The ``k`` columns with the highest F (all if there are fewer); ties in column-name order."""
    return anova_f_scores(df, columns, label).orderBy(F.desc_nulls_last("f_score"), "feature").limit(k)


def select_k_best(
    df: DataFrame, columns: Sequence[str], label: str, k: int = 50, keys: Sequence[str] = ()
) -> DataFrame:
    """``df`` cut down to ``keys`` and its ``k`` best columns, which stay in table order."""
    best = {r["feature"] for r in best_features(df, columns, label, k).collect()}
    return df.select(*keys, *[F.col(quoted(c)) for c in columns if c in best])


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """The columns as one vector column; nulls are refused, as for a model."""
    safe = df.withColumnsRenamed({c: f"_f{i}" for i, c in enumerate(columns)})
    names = [f"_f{i}" for i in range(len(columns))]
    return VectorAssembler(inputCols=names, outputCol=output, handleInvalid="error").transform(safe).drop(*names)


def pca_stages(k: int, features: str = "features", output: str = "pca") -> list:
    """Pipeline stages for centred principal components. Spark's PCA learns on centred data but projects
    uncentred rows, so the centring is its own stage."""
    return [
        StandardScaler(inputCol=features, outputCol=f"_{output}_centred", withMean=True, withStd=False),
        PCA(k=k, inputCol=f"_{output}_centred", outputCol=output),
    ]


def fit_pca(df: DataFrame, k: int, features: str = "features", output: str = "pca"):
    return Pipeline(stages=pca_stages(k, features, output)).fit(df)


class BestByF(Estimator):
    """A pipeline stage that keeps the ``k`` entries of a vector with the highest F, in their order.

    F is worked out on the rows it is fitted on, by one grouped pass; it ranks by F itself, since p-values are all 0
    once there are many rows. The fitted stage is a ``VectorSlicer``. Ties go to the earlier entry.
    """

    def __init__(self, k: int, features: str, output: str, label: str):
        super().__init__()
        self.k, self.features, self.output, self.label = k, features, output, label

    def _fit(self, dataset: DataFrame) -> VectorSlicer:
        summary = Summarizer.metrics("count", "mean", "variance").summary(F.col(self.features))
        rows = dataset.groupBy(self.label).agg(summary.alias("_s"))
        entries = F.arrays_zip(vector_to_array("_s.mean").alias("mean"), vector_to_array("_s.variance").alias("var"))
        long = rows.select(F.col("_s.count").alias("n"), F.posexplode(entries).alias("feature", "e")).select(
            "feature", "n", F.col("e.mean").alias("mean"), (F.col("e.var") * (F.col("n") - 1) / F.col("n")).alias("var")
        )
        best = _f_scores(long).orderBy(F.desc_nulls_last("f_score"), "feature").limit(self.k).collect()
        indices = sorted(r["feature"] for r in best)
        return VectorSlicer(inputCol=self.features, outputCol=self.output, indices=indices)


def reduction_stages(
    method: str, n: int, n_features: int, features: str = "features", output: str = "reduced", label: str = "label"
) -> list:
    """Pipeline stages for 'pca', 'selectkbest' or anything else (nothing), capped at the features there are."""
    n = min(n, n_features)
    if method == "pca":
        return pca_stages(n, features, output)
    if method == "selectkbest":
        return [BestByF(n, features, output, label)]
    return []


def reduce_features(
    train: DataFrame, test: DataFrame, method: str, n: int, n_features: int, features: str = "features",
    output: str = "reduced", label: str = "label",
):
    """Fit the reduction on ``train`` and apply it to both; returns (train, test, fitted pipeline or None)."""
    stages = reduction_stages(method, n, n_features, features, output, label)
    if not stages:
        return train.withColumn(output, F.col(features)), test.withColumn(output, F.col(features)), None
    model = Pipeline(stages=stages).fit(train)
    return model.transform(train), model.transform(test), model

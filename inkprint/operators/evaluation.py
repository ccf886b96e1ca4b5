"""Classification metrics from a (true_label, predicted_label) table.

Every metric starts from the same small aggregate, the counts per (true, predicted) pair, so the
prediction table is scanned once and reduced before the shuffle however uneven the classes are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.functions.text import ratio

TRUE, PREDICTED = "true_label", "predicted_label"


def prediction_table(df: DataFrame, truth: str, predicted: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """True label, predicted label and whether they agree."""
    return df.select(
        *keys, F.col(truth).alias(TRUE), F.col(predicted).alias(PREDICTED),
        (F.col(truth) == F.col(predicted)).alias("correct"),
    )


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col(TRUE) == F.col(PREDICTED)).cast("double")).alias("accuracy"))


def pair_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(TRUE, PREDICTED).agg(F.count("*").alias("n"))


def class_counts(df: DataFrame) -> DataFrame:
    """(label, tp, n_predicted, support) for every label that is true or predicted somewhere."""
    hit = F.when(F.col(TRUE) == F.col(PREDICTED), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col(TRUE).alias("label"), hit.alias("tp"), zero.alias("n_predicted"), F.col("n").alias("support")),
        F.struct(F.col(PREDICTED).alias("label"), zero.alias("tp"), F.col("n").alias("n_predicted"),
                 zero.alias("support")),
    )
    return (
        pair_counts(df)
        .select(F.inline(sides))
        .groupBy("label")
        .agg(F.sum("tp").alias("tp"), F.sum("n_predicted").alias("n_predicted"), F.sum("support").alias("support"))
    )


def per_class(df: DataFrame) -> DataFrame:
    """precision, recall, f1 and support per label; 0 where a denominator is 0."""
    precision, recall = ratio(F.col("tp"), F.col("n_predicted")), ratio(F.col("tp"), F.col("support"))
    f1 = ratio(2 * F.col("tp"), F.col("n_predicted") + F.col("support"))
    return class_counts(df).select(
        "label", "tp", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support"
    )


def classification_report(df: DataFrame) -> DataFrame:
    """Per-class rows followed by accuracy, macro average and support-weighted average.

    The accuracy row carries the accuracy in all three metric columns. A rollup over the per-class rows
    gives the overall rows without reading the predictions again.
    """
    metrics = ["precision", "recall", "f1"]
    rolled = per_class(df).rollup("label").agg(
        F.grouping("label").alias("_all"),
        F.sum("support").alias("support"),
        ratio(F.sum("tp"), F.sum("support")).alias("_accuracy"),
        *[F.avg(m).alias(m) for m in metrics],
        *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"_weighted_{m}") for m in metrics],
    )

    def row(name, columns):
        return F.struct(name.alias("label"), *[F.col(c).alias(m) for c, m in zip(columns, metrics)], F.col("support"))

    single = F.array(row(F.col("label"), metrics))
    summary = F.array(
        row(F.lit("accuracy"), ["_accuracy"] * 3),
        row(F.lit("macro avg"), metrics),
        row(F.lit("weighted avg"), [f"_weighted_{m}" for m in metrics]),
    )
    return rolled.select(F.inline(F.when(F.col("_all") == 0, single).otherwise(summary)))


def confusion_matrix(df: DataFrame) -> DataFrame:
    """Long form, one row per (true, predicted) pair of labels, zero cells kept."""
    cells = pair_counts(df)
    labels = cells.agg(
        F.array_sort(F.array_union(F.collect_set(TRUE), F.collect_set(PREDICTED))).alias("_labels")
    )
    zeros = labels.select(F.explode("_labels").alias(TRUE), "_labels").select(
        TRUE, F.explode("_labels").alias(PREDICTED), F.lit(0).cast("bigint").alias("n")
    )
    return cells.unionByName(zeros).groupBy(TRUE, PREDICTED).agg(F.sum("n").alias("n"))


def per_class_metrics(df: DataFrame) -> DataFrame:
    """(label, metric, value) without the summary rows."""
    return per_class(df).unpivot("label", ["precision", "recall", "f1"], "metric", "value")


def per_class_accuracy(df: DataFrame) -> DataFrame:
    hit = (F.col(TRUE) == F.col(PREDICTED)).cast("double")
    return df.groupBy(F.col(TRUE).alias("label")).agg(F.avg(hit).alias("accuracy"))


def common_misclassifications(df: DataFrame) -> DataFrame:
    """Off-diagonal pairs that occur, most frequent first."""
    wrong = pair_counts(df).filter(F.col(TRUE) != F.col(PREDICTED))
    return wrong.orderBy(F.desc("n"), TRUE, PREDICTED)

"""Tables Spark derives from the corpus for the metric and report queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.functions import text as tx
from inkprint.operators.sampling import stratified_folds
from inkprint.plans.registry import documents
from inkprint.plans.sqltext import LANGS, RULE_LETTERS, RULE_WORDS


def _argmax(prefix: str) -> Column:
    """The language with the highest score; ties go to the name that sorts first."""
    out = None
    for a in LANGS:
        wins = F.lit(True)
        for b in LANGS:
            if b != a:
                wins = wins & (F.col(f"{prefix}_{a}") >= F.col(f"{prefix}_{b}"))
        out = F.when(wins, a) if out is None else out.when(wins, a)
    return out


def _among(words: list[str]):
    return lambda w: w.isin(words)


def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: function-word hits (``w_<lang>``) and typical-letter hits (``c_<lang>``)."""
    docs = documents(spark, sf_dir, "doc_id", "lang", "text").withColumn("_low", F.lower("text"))
    docs = docs.withColumn("_lw", tx.words(F.col("_low")))
    word_hits = {
        f"w_{k}": F.size(F.filter("_lw", _among(v))) for k, v in RULE_WORDS.items()
    }
    letter_hits = {f"c_{k}": tx.count_of(F.col("_low"), f"[{v}]") for k, v in RULE_LETTERS.items()}
    return docs.withColumns({**word_hits, **letter_hits}).drop("_low", "_lw")


def rule_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_scores(spark, sf_dir).select(
        "doc_id", "lang", "text", _argmax("w").alias("by_word"), _argmax("c").alias("by_letter")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, true_label, predicted_label) of the function-word rule."""
    return rule_guesses(spark, sf_dir).select(
        "doc_id", F.col("lang").alias("true_label"), F.col("by_word").alias("predicted_label")
    )


def predictions_by_rule(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """(model, doc_id, true_label, predicted_label) of both rules."""
    both = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted_label")) for m in ("by_letter", "by_word")]
    )
    guesses = rule_guesses(spark, sf_dir)
    return guesses.select("doc_id", F.col("lang").alias("true_label"), *extra, F.inline(both))


def fold_scores(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """(model, fold, score): accuracy of each rule per fold."""
    folds = stratified_folds(rule_guesses(spark, sf_dir).select("doc_id", "lang", "by_word", "by_letter"), "lang", k)
    both = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(m).alias("guess")) for m in ("by_letter", "by_word")]
    )
    rows = folds.select("fold", "lang", F.inline(both))
    return rows.groupBy("model", "fold").agg(F.avg((F.col("lang") == F.col("guess")).cast("double")).alias("score"))


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, model, label, p): the rules' scores plus one, scaled to sum 1 per document and rule."""
    scored = rule_scores(spark, sf_dir)
    entries = []
    for model, prefix in (("by_word", "w"), ("by_letter", "c")):
        total = sum((F.col(f"{prefix}_{k}") for k in LANGS), F.lit(len(LANGS)))
        for k in LANGS:
            share = (F.col(f"{prefix}_{k}") + 1).cast("double") / total
            entries.append(F.struct(F.lit(model).alias("model"), F.lit(k).alias("label"), share.alias("p")))
    return scored.select("doc_id", F.inline(F.array(*entries)))

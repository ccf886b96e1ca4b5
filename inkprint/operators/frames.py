"""Column choice, alignment, null handling and row predicates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprint.functions.names import named, quoted
from inkprint.functions import text as tx
from inkprint.operators.stylometry import HELPERS

# The name patterns that make up the two column families.
STYLE_PREFIXES = ["flesch", "gunning", "yules", "hapax"]
STYLE_SUFFIXES = [
    "_count", "_ratio", "_entropy", "_avg", "_length", "_k", "_stdev", "_var", "_mean", "_type",
]
EMBEDDING_PREFIXES = ["sent_emb_", "roberta_emb_", "xlnet_emb_"]


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def text_and_label(df: DataFrame, text: str = "text", label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Only the columns a model may see; file names and the like are left out."""
    return require_columns(df, [text, label]).select(*keys, text, label)


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """Without rows whose text is empty or only white space."""
    return df.filter(~tx.is_blank(F.col(text)))


def drop_helpers(df: DataFrame) -> DataFrame:
    """Without the columns that only served to compute others."""
    return df.drop(*HELPERS)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def select_numeric(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*named(keys), *named(c for c in numeric_columns(df) if c not in keys))


def feature_set(df: DataFrame, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """The 'stylometric', 'embeddings' or 'all' columns, chosen by name. A family nobody is in means all."""
    columns = [c for c in df.columns if c not in keys]
    if name == "stylometric":
        chosen = [c for c in columns if c.startswith(tuple(STYLE_PREFIXES)) or c.endswith(tuple(STYLE_SUFFIXES))]
    elif name == "embeddings":
        chosen = [c for c in columns if c.startswith(tuple(EMBEDDING_PREFIXES))]
    elif name == "all":
        chosen = columns
    else:
        raise ValueError(f"unknown feature set {name!r}")
    return df.select(*named(keys), *named(chosen or columns))


def align_features(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Exactly the columns ``names`` in that order: extra ones dropped, missing ones 0."""
    present = set(df.columns)
    return df.select(*keys, *[F.col(quoted(n)) if n in present else F.lit(0.0).alias(n) for n in names])


def fill_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls and NaNs in numeric columns become 0."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    names = set(numeric_columns(df) if columns is None else columns)

    def filled(name: str):
        value = F.col(quoted(name))
        if name in floats:
            value = F.when(F.isnan(value), F.lit(None)).otherwise(value)
        return F.coalesce(value, F.lit(0)).cast(df.schema[name].dataType).alias(name)

    return df.select(*[filled(c) if c in names else F.col(quoted(c)) for c in df.columns])


def non_finite_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n_nan, n_inf), one row per column, from one pass."""
    return per_column(df, columns, {
        "n_nan": lambda v: F.count_if(F.isnan(v)), "n_inf": lambda v: F.count_if(F.abs(v) == float("inf")),
    })


def per_column(
    df: DataFrame, columns: Sequence[str], measures: dict[str, Callable[[Column], Column]], by: Sequence[str] = ()
) -> DataFrame:
    """(by, feature, measures): aggregates of every column, as double, from one pass that keeps a row a row.

    All aggregates stand side by side in one partial aggregation; they are turned into rows afterwards.
    """
    entries = []
    for c in columns:
        value = F.col(quoted(c)).cast("double")
        entries.append(F.struct(F.lit(c).alias("feature"), *[measure(value).alias(name) for name, measure in measures.items()]))
    grouped = df.groupBy(*by) if by else df.groupBy()
    return grouped.agg(F.array(*entries).alias("_entries")).select(*by, F.inline("_entries"))


def assert_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    bad = non_finite_counts(df, columns).filter("n_nan + n_inf > 0").collect()
    if bad:
        raise ValueError("not finite: " + ", ".join(r["feature"] for r in bad))
    return df


def misclassified(
    predictions: DataFrame, texts: DataFrame, key: str = "doc_id", truth: str = "true_label",
    predicted: str = "predicted_label",
) -> DataFrame:
    """Wrong predictions with their text: the wrong rows are picked before the join."""
    wrong = predictions.filter(F.col(truth) != F.col(predicted)).select(key, truth, predicted)
    return wrong.join(texts.select(key, "text"), key)


def successful(comparison: DataFrame) -> DataFrame:
    """Comparison rows of models that ran."""
    return comparison.filter(F.col("mean_accuracy").isNotNull())


def upsert_by_prefix(table: DataFrame, prefix: str, rows: DataFrame, column: str = "model") -> DataFrame:
    """``table`` without rows whose name starts with ``prefix``, plus ``rows``."""
    return table.filter(~F.col(column).startswith(prefix)).unionByName(rows)

"""Frequencies within one row, with no shuffle.

Word and character frequencies of a document could be had by exploding and grouping on the document,
but that sends every distinct (document, item) pair over the network. Sorting the row's own array and
measuring the runs of equal items gives the same counts inside the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.functions.names import named


def with_item_counts(df: DataFrame, items: str, prefix: str) -> DataFrame:
    """Add ``<prefix>_items`` (sorted distinct items) and ``<prefix>_counts`` (how often each occurs).

    The steps are separate projections so that the sorted array is an attribute, computed once, and
    not an expression copied into each lambda.
    """
    ordered, starts = f"_{prefix}_sorted", f"_{prefix}_starts"
    size = F.size(ordered)
    at_start = F.filter(
        F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
    )
    counts = F.transform(starts, lambda start, j: (F.coalesce(F.get(starts, j + 1), size) - start).cast("bigint"))
    return (
        df.withColumn(ordered, F.sort_array(items))
        .withColumn(starts, F.when(size > 0, at_start).otherwise(F.array().cast("array<int>")))
        .select(
            *named(df.columns), F.transform(starts, lambda i: F.get(ordered, i)).alias(f"{prefix}_items"),
            counts.alias(f"{prefix}_counts"),
        )
    )


def repeats(items: str) -> Column:
    """How often each item that occurs more than once is repeated, one less than it occurs. Items are words without white space.

    In the sorted items, joined, each one that the same item follows becomes a line break, so line breaks in a row are one item's repeats.
    """
    joined = F.concat(F.lit(" "), F.array_join(F.sort_array(items), " "), F.lit(" "))
    marked = F.regexp_replace(joined, r" ([^ ]++)(?= \1 )", "\n")
    return F.transform(F.regexp_extract_all(marked, F.lit("\n+"), F.lit(0)), F.octet_length)


def char_runs(squeezed_text: Column) -> Column:
    """How often each distinct character occurs: lengths of the runs in the sorted text."""
    in_order = F.array_join(F.sort_array(F.split(squeezed_text, "")), "")
    return F.transform(F.regexp_extract_all(in_order, F.lit(r"(?s)(.)\1*"), F.lit(0)), F.length)


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, n: acc + n)


def squares_beyond_one(repeats: Column) -> Column:
    """What the squares of all frequencies add up to more than the frequencies of 1 do, from ``repeats``."""
    return F.aggregate(repeats, F.lit(0).cast("bigint"), lambda acc, n: acc + (n.cast("bigint") + 1) * (n + 1))


#: ASCII characters in the order in which they are counted, frequent ones first; the order decides the cost, never the result.
FREQUENT = "enitarsoldhcumgpbfvwkyzjxq.,\n0123456789-'\"?!;:()"


def _n_log_n(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))


def char_entropy(squeezed_text: str) -> Column:
    """Shannon entropy of the characters of a column, log2 N - (1/N) sum n log2 n; 0 for an empty text.

    FREQUENT characters are taken out of the ASCII part one after the other, and each counts as many as the rest gets shorter, so most of
    a text is gone after a few. What remains then, and all other characters, is counted by runs.
    """
    text = F.col(squeezed_text)
    ascii_part, others = (F.regexp_replace(text, f"[{c}]+", "") for c in (r"^\x00-\x7f", r"\x00-\x7f"))

    def state(rest: Column, size: Column, s: Column) -> Column:
        return F.struct(rest.alias("rest"), size.alias("size"), s.alias("s"))

    def counted(acc: Column) -> Column:
        """The sum with the character that was taken out last."""
        return acc["s"] + _n_log_n(acc["size"] - F.octet_length(acc["rest"]))

    def remaining(acc: Column) -> Column:
        return F.aggregate(char_runs(F.concat(acc["rest"], others)), counted(acc), lambda s, n: s + _n_log_n(n))

    total = F.aggregate(
        F.array(*[F.lit(c) for c in FREQUENT]), state(ascii_part, F.octet_length(ascii_part), F.lit(0.0)),
        lambda acc, c: state(F.replace(acc["rest"], c, F.lit("")), F.octet_length(acc["rest"]), counted(acc)), remaining,
    )
    n = F.length(text)
    return F.when(n > 0, F.log2(n) - total / n).otherwise(F.lit(0.0))

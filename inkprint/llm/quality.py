"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one integer whose bits say which rules
failed. A policy is a version name and a mask of the rules it enforces: applying one, comparing versions and asking what each
rule costs (ablation) are bit operations on the ledger and never read a text again.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from inkprint.llm.base import SPACES, map_rows, text_bytes

SYMBOLS = b"#*$%&|<>"
#: Everything in ASCII that is not a letter; what is left of a word without it holds a letter.
NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words")
SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COLUMNS)


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; ``bit`` is its place in the ledger and never changes meaning."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule(3, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(4, "duplicate_lines", "n_dup_lines > 2 and 10 * n_dup_lines > 3 * n_lines"),
    Rule(5, "letters", "10 * n_letter_words < 6 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {rule.name: rule.bit for rule in RULES}
        return sum(1 << bits[name] for name in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
FULL = Policy("full-1", tuple(rule.name for rule in RULES))


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of COLUMNS; null counts as empty."""
    if not text:
        return (0,) * len(COLUMNS)
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    letters = sum(k for w, k in Counter(words).items() if w.strip(NOT_LETTERS))
    return (
        len(words), len(text.translate(None, SPACES).decode()), len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(words), len(lines), letters,
    )


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three found twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, covered = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(covered, i)
            covered = i + 3
    return total


def _measure_slice(batch: pa.RecordBatch) -> dict[str, list]:
    measured = list(zip(*map(measure, text_bytes(batch, "text")))) or [()] * len(COLUMNS)
    return {"doc_id": batch.column(0), **dict(zip(COLUMNS, measured))}


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, the measurements, fail_bits. Texts are read whole; repeated rows stay separate rows.

    Null and empty texts have no words and fail ``few_words``. Other columns of ``docs`` are ignored.
    """
    measured = map_rows(docs.select("doc_id", "text"), _measure_slice, SCHEMA)
    return measured.withColumn("fail_bits", fail_bits(rules))


def fail_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = F.lit(0).cast("bigint")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), 1 << rule.bit).otherwise(0).cast("bigint"))
    return bits


def passes(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def ablation(ledger_rows: DataFrame, policy: Policy = FULL, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of ``policy``: documents it fails, documents it alone rejects, documents kept with and without it.

    Rows are first counted by failure bits, so at most 2 ** len(rules) rows meet in the last step. An empty ledger
    gives zeros.
    """
    counts = ledger_rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    n = F.col("n")
    sums = [F.sum(F.when(F.col("bits") == 0, n)).alias("kept")]
    chosen = [rule for rule in rules if policy.mask >> rule.bit & 1]
    for rule in chosen:
        bit = F.lit(1 << rule.bit)
        sums.append(F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, n)).alias(f"failed_{rule.bit}"))
        sums.append(F.sum(F.when(F.col("bits") == bit, n)).alias(f"alone_{rule.bit}"))
    one = counts.agg(*sums)
    rows = F.array(*[
        F.struct(
            F.lit(policy.version).alias("version"), F.lit(rule.name).alias("rule"),
            F.coalesce(f"failed_{rule.bit}", F.lit(0)).alias("failed"), F.coalesce(f"alone_{rule.bit}", F.lit(0)).alias("failed_alone"),
            F.coalesce("kept", F.lit(0)).alias("kept"),
            (F.coalesce("kept", F.lit(0)) + F.coalesce(f"alone_{rule.bit}", F.lit(0))).alias("kept_without"),
        ) for rule in chosen
    ])
    return one.select(F.inline(rows))


def filter_quality(docs: DataFrame, policy: Policy = FULL) -> DataFrame:
    """The rows of ``docs`` whose text passes ``policy``, with all their columns, in one pass and without a join.

    The measurements are made beside the rows, so repeated keys and columns of any name are kept as they are.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text"))
    schema = StructType([packed.schema["_row"], *[StructField(c, LongType()) for c in COLUMNS]])

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        measured = list(zip(*map(measure, text_bytes(batch, "text")))) or [()] * len(COLUMNS)
        return {"_row": batch.column(0), **dict(zip(COLUMNS, measured))}

    judged = map_rows(packed, run, schema).withColumn("fail_bits", fail_bits())
    return judged.where(passes(policy)).select("_row.*")

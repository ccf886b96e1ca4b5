"""The document feature block: one row in, the same row with its style columns out.

Everything is a map-side projection. A document's words, sentence lengths and frequency counts are
built once in inner projections and shared by the columns that need them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.functions import runs, text as tx
from inkprint.functions.names import named
from inkprint.functions.lexicons import FUNCTION_WORDS, STOP_WORDS
from inkprint.operators.vectors import embed_documents, vector_columns

# Helper columns the feature block leaves out of its result.
HELPERS = ["sentences", "period_count", "double_quote_count", "single_quote_count"]

LENGTH = ["sentence_length", "word_count", "char_count", "avg_word_length", "longest_word"]
PUNCTUATION = [
    "period_count", "exclamation_count", "question_count", "punctuation_count", "comma_count", "semicolon_count",
    "colon_count", "double_quote_count", "single_quote_count", "quote_count", "punctuation_ratio",
]
CHARACTER = ["digit_count", "symbol_count", "uppercase_count", "uppercase_ratio", "char_entropy"]
SENTENCE = ["sentence_count", "avg_sentence_length", "std_sentence_length"]
VOCABULARY = ["unique_words", "lexical_diversity", "hapax_legomena_ratio", "yules_k", "stopword_ratio"]
POS = ["noun_count", "verb_count", "adj_count", "adv_count"]
READABILITY = ["flesch_reading_ease", "gunning_fog", "avg_syllables_per_word"]


def function_word_columns(words: Sequence[str] = FUNCTION_WORDS) -> list[str]:
    return [f"fw_{w}" for w in words]


def style_columns(function_words: Sequence[str] = FUNCTION_WORDS) -> list[str]:
    """The fixed feature columns, in the order the feature block returns them."""
    return [
        "sentence_length", "word_count", "char_count", "avg_word_length", "exclamation_count", "question_count",
        "punctuation_count", "comma_count", "semicolon_count", "colon_count", "quote_count", "digit_count",
        "symbol_count", "longest_word", "stopword_ratio", *function_word_columns(function_words), "sentence_count",
        "avg_sentence_length", "std_sentence_length", "unique_words", "lexical_diversity", "uppercase_count",
        "uppercase_ratio", *POS, "flesch_reading_ease", "gunning_fog", "punctuation_ratio", "avg_syllables_per_word",
        "hapax_legomena_ratio", "yules_k", "char_entropy",
    ]


def _shared(df: DataFrame, text: str) -> DataFrame:
    """Columns several features read, each an attribute of an inner projection."""
    source = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    raw = F.col("_text")
    first = source.withColumns(
        {
            "_low": F.lower("_text"), "_spaced": tx.spaced(raw), "_rest": tx.beyond_letters(raw),
            "_n_chars": F.length("_text").cast("bigint"),
        }
    )
    rest, spaced = F.col("_rest"), F.col("_spaced")
    second = first.withColumns(
        {
            "_squeezed": F.replace("_low", F.lit(" "), F.lit("")),
            "_words": tx.spaced_off(spaced), "_lens": tx.sentence_lengths(spaced), "_spaced_low": tx.spaced(F.col("_low")),
            "_upper": tx.uppercase_count(rest), "_period": tx.count_char(rest, "."),
            "_exclamation": tx.count_char(rest, "!"), "_question": tx.count_char(rest, "?"),
        }
    )
    low = F.col("_spaced_low")
    return second.withColumns(
        {
            "_lwords": tx.spaced_off(low), "_groups": tx.vowel_groups(low),
            "_tokens": F.regexp_extract_all("_low", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)),
            "_n_words": F.size("_words").cast("bigint"), "_mean_len": _mean(F.col("_lens")),
        }
    )


def _mean(values: Column) -> Column:
    return tx.ratio(runs.total(values), F.size(values))


def _expressions(stop_words: Sequence[str], function_words: Sequence[str]) -> dict[str, Callable[[], Column]]:
    """Column name to a function that builds its expression, so that only the wanted ones are built."""
    rest, n_words, n_chars = F.col("_rest"), F.col("_n_words"), F.col("_n_chars")
    marks = {c: F.col(f"_{c}") for c in ("period", "exclamation", "question")}
    punctuation = marks["period"] + marks["exclamation"] + marks["question"]
    upper = F.col("_upper")
    n_sentences = F.size("_lens")

    def std() -> Column:
        centred = F.aggregate(
            "_lens", F.lit(0.0), lambda acc, n: acc + (n - F.col("_mean_len")) * (n - F.col("_mean_len"))
        )
        return F.when(n_sentences > 1, F.sqrt(centred / (n_sentences - 1))).otherwise(F.lit(0.0))

    squares = F.col("_once") + runs.squares_beyond_one(F.col("_repeats"))
    out = {
        "sentence_length": lambda: n_words,
        "word_count": lambda: n_words,
        "char_count": lambda: n_chars,
        "avg_word_length": lambda: tx.ratio(F.length(F.array_join("_words", "")), n_words),
        "longest_word": lambda: F.coalesce(F.array_max(F.transform("_words", F.length)), F.lit(0)).cast("bigint"),
        "period_count": lambda: marks["period"],
        "exclamation_count": lambda: marks["exclamation"],
        "question_count": lambda: marks["question"],
        "punctuation_count": lambda: punctuation,
        "comma_count": lambda: tx.count_char(rest, ","),
        "semicolon_count": lambda: tx.count_char(rest, ";"),
        "colon_count": lambda: tx.count_char(rest, ":"),
        "double_quote_count": lambda: tx.count_char(rest, '"'),
        "single_quote_count": lambda: tx.count_char(rest, "'"),
        "quote_count": lambda: tx.count_char(rest, '"') + tx.count_char(rest, "'"),
        "punctuation_ratio": lambda: tx.ratio(punctuation, n_chars),
        "digit_count": lambda: tx.digit_count(rest),
        "symbol_count": lambda: tx.symbol_count(rest),
        "uppercase_count": lambda: upper,
        "uppercase_ratio": lambda: tx.ratio(upper, n_chars),
        "char_entropy": lambda: runs.char_entropy("_squeezed"),
        "sentence_count": lambda: n_sentences.cast("bigint"),
        "avg_sentence_length": lambda: F.col("_mean_len"),
        "std_sentence_length": std,
        "unique_words": lambda: F.col("_unique"),
        "lexical_diversity": lambda: tx.ratio(F.col("_unique"), n_words),
        "hapax_legomena_ratio": lambda: tx.ratio(F.col("_once"), n_words),
        "yules_k": lambda: F.when(
            n_words > 0, F.lit(10000.0) * (squares - n_words).cast("double") / (n_words * n_words).cast("double")
        ).otherwise(F.lit(0.0)),
        "stopword_ratio": lambda: tx.ratio(tx.count_among("_listed", stop_words), n_words),
        "flesch_reading_ease": lambda: F.when(
            n_words > 0,
            F.lit(206.835) - 1.015 * tx.ratio(n_words, n_sentences) - 84.6 * tx.ratio(F.col("_syllables"), n_words),
        ).otherwise(F.lit(0.0)),
        "gunning_fog": lambda: 0.4
        * (tx.ratio(n_words, n_sentences) + 100.0 * tx.ratio(tx.complex_word_count(F.col("_groups")), n_words)),
        "avg_syllables_per_word": lambda: tx.ratio(F.col("_syllables"), n_words),
    }
    for word in function_words:
        out[f"fw_{word}"] = lambda word=word: (F.size("_listed") - F.size(F.array_remove("_listed", word))).cast("bigint")
    return out


def _tagged(words: list[str]) -> Column:
    return tx.count_among("_tokens", words) if words else F.lit(0).cast("bigint")


def _pos_expressions(lexicon: dict[str, str] | None) -> dict[str, Callable[[], Column]]:
    """Tag counts from a word-to-tag lexicon; 0 without one."""
    out = {}
    for column, prefix in zip(POS, ("NN", "VB", "JJ", "RB")):
        tagged = sorted(w.lower() for w, tag in (lexicon or {}).items() if tag.startswith(prefix))
        out[column] = lambda tagged=tagged: _tagged(tagged)
    return out


def with_style(
    df: DataFrame,
    columns: Sequence[str],
    text: str = "text",
    stop_words: Sequence[str] = STOP_WORDS,
    function_words: Sequence[str] = FUNCTION_WORDS,
    lexicon: dict[str, str] | None = None,
) -> DataFrame:
    """``df`` with the named style columns appended. Only what the columns need is computed: Catalyst
    drops the inner projections nobody reads."""
    keep = named(df.columns)
    repeated = _shared(df, text).withColumn("_repeats", runs.repeats("_lwords"))
    distinct = F.size("_lwords") - runs.total(F.col("_repeats"))
    shared = repeated.withColumns(
        {
            # The words of either list, few of all words, are picked out once.
            "_listed": tx.among("_lwords", sorted({*stop_words, *function_words})),
            "_unique": distinct,
            "_syllables": tx.syllable_count(F.col("_groups"), F.col("_n_words")),
        }
    ).withColumn("_once", F.col("_unique") - F.size("_repeats"))
    available = {**_expressions(stop_words, function_words), **_pos_expressions(lexicon)}
    return shared.select(*keep, *[available[c]().alias(c) for c in columns])


def style_features(
    df: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    text: str = "text",
    stop_words: Sequence[str] = STOP_WORDS,
    function_words: Sequence[str] = FUNCTION_WORDS,
    lexicon: dict[str, str] | None = None,
    encoder: Callable | None = None,
    encoder_size: int = 0,
) -> DataFrame:
    """The whole fixed feature block: ``keys`` plus the style columns, text and helpers left out.

    With a text ``encoder`` (a ``predict_batch_udf`` factory) whose vectors have ``encoder_size`` entries, the block ends
    with the columns ``sent_emb_0 .. sent_emb_<size-1>``, made in the same map stage.
    """
    wide = with_style(df, style_columns(function_words), text, stop_words, function_words, lexicon)
    columns = [*named(keys), *style_columns(function_words)]
    if encoder is None:
        return wide.select(*columns)
    embedded = embed_documents(wide, encoder, text, "_sentence_vector").select(*columns, "_sentence_vector")
    return vector_columns(embedded, "_sentence_vector", "sent_emb_", encoder_size)

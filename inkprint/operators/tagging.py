"""Part-of-speech counts from a (word, tag) table of any size.

The table is an ordinary DataFrame, a parquet file for instance. Each document's tokens are counted in the row, so a document hands over each
of its distinct words once. Up to a checked size the table is broadcast; beyond it the words are joined to it by a shuffle in
which frequent words, which nearly every document has, are kept apart.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.functions.names import quoted
from inkprint.functions.runs import with_item_counts
from inkprint.storage import BROADCAST_ROWS, match_skewed, materialize

#: Output column to the beginning of the tags that it counts.
TAG_CLASSES = {"noun_count": "NN", "verb_count": "VB", "adj_count": "JJ", "adv_count": "RB"}


def word_classes(lexicon: DataFrame, classes: Mapping[str, str] = TAG_CLASSES) -> DataFrame:
    """``word`` (lower case) and a 0/1 column per class: one row per word that has a tag of one of the classes.

    ``lexicon`` has a row per word and tag. A word with several tags belongs to each of their classes, and to a class once.
    """
    word, tag = F.lower("word").alias("word"), F.col("tag")
    flags = [F.max(tag.startswith(prefix).cast("int")).alias(name) for name, prefix in classes.items()]
    some = F.greatest(*classes) if len(classes) > 1 else F.col(next(iter(classes)))
    return lexicon.where("word is not null and tag is not null").groupBy(word).agg(*flags).where(some > 0)


def tag_counts(
    df: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text", classes: Mapping[str, str] = TAG_CLASSES,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(key, one count per class) of every row of ``df``: its tokens that the lexicon has in the class.

    Tokens are lower-cased runs of letters, digits and underscores. Rows without a known word, and null texts, have zeros;
    rows that share a key stay apart. With at most ``max_rows`` words (checked) no word leaves its task: what is shuffled is one row of
    sums per document.
    """
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(quoted(text)), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(quoted(key)).alias("_key"), tokens.alias("_tokens"))
    counted = with_item_counts(rows, "_tokens", "_w")
    pairs = counted.select("_row", "_key", F.explode_outer(F.arrays_zip("_w_items", "_w_counts")).alias("p"))
    words = pairs.select("_row", "_key", F.col("p._w_items").alias("word"), F.col("p._w_counts").alias("n"))
    known = word_classes(lexicon, classes)
    if len(known.select(F.lit(1)).take(max_rows + 1)) <= max_rows:
        matched = words.join(F.broadcast(known), "word", "left")
    else:
        # The row numbers must not change between the two readings, so the words are written.
        written = materialize(words, "words")
        matched = match_skewed(written.where("word is not null"), known, "word", "left").unionByName(
            written.where("word is null"), allowMissingColumns=True,
        )
    sums = [F.coalesce(F.sum(F.col("n") * F.col(name)), F.lit(0)).cast("bigint").alias(name) for name in classes]
    return matched.groupBy("_row", "_key").agg(*sums).select(F.col("_key").alias(key), *classes)

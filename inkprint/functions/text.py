"""Text column expressions.

White space, digits, letters and upper case follow Python's ``str`` methods (``split``, ``isdigit``,
``isalnum``, ``isupper``), spelled as Java regular expressions so they run inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.isspace() accepts, as the body of a character class.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
# The characters that are digits but not decimals (superscripts, circled digits, ...).
OTHER_DIGITS = (
    r"\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}"
    r"\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}"
    r"\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)
VOWELS = "aeiouy"

# Classes begin with a range that settles most characters, so that Unicode properties are looked up for few.
_BLANK = rf"[[^!-~]&&[{SPACE}]]"
_WORD = rf"[!-~[^{SPACE}]]+"
_DIGIT = rf"[0-9[[^ -~]&&[\p{{Nd}}{OTHER_DIGITS}]]]"
_SYMBOL = rf"[[^a-z ]&&[^\p{{L}}\p{{N}}{SPACE}]]"
_UPPER = r"[A-Z[[^ -~]&&\p{IsUppercase}]]"
_SENTENCE_END = rf"[.!?]{_BLANK}+"
_TOKEN = r"[\p{L}\p{N}_]{2,}"


def count_of(text: Column, pattern: str) -> Column:
    """Number of non-overlapping matches of ``pattern``."""
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def count_char(text: Column, char: str) -> Column:
    """Number of times the single ASCII character ``char`` occurs: by as many bytes the text gets shorter without it."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))).cast("bigint")


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as double, 0 where the denominator is 0."""
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double")).otherwise(F.lit(0.0))


def strip(text: Column) -> Column:
    """Both ends trimmed of every kind of white space."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{SPACE}]")


def words(text: Column) -> Column:
    """White-space separated words, in order."""
    return F.array_remove(F.split(text, f"{_BLANK}+"), "")


def spaced(text: Column) -> Column:
    """Every run of white space written as a single space."""
    return F.regexp_replace(F.regexp_replace(text, rf"[[^ -~]&&[{SPACE}]]", " "), " {2,}", " ")


def spaced_off(spaced_text: Column) -> Column:
    """The words of ``spaced`` output, in order: one fixed character to split at, which needs no pattern."""
    return F.array_remove(F.split(spaced_text, " "), "")


def word_count(text: Column) -> Column:
    return count_of(text, _WORD)


def among(array: str, words) -> Column:
    """The entries of an array column that are in a word list: a hash lookup per entry."""
    listed = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return F.expr(f"filter(`{array}`, w -> w in ({listed}))" if listed else f"slice(`{array}`, 1, 0)")


def count_among(array: str, words) -> Column:
    """How many entries of an array column are in a word list."""
    return F.size(among(array, words)).cast("bigint")


def vocabulary_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """Parts between sentence ends (``.``, ``!`` or ``?`` before white space); blank parts are dropped."""
    return F.filter(F.split(text, _SENTENCE_END), lambda part: ~is_blank(part))


def sentence_lengths(spaced_text: Column) -> Column:
    """Words per sentence of ``spaced`` output. A blank part has no words, so removing zeros drops exactly the blank parts."""

    def length(part: Column) -> Column:
        inner = F.trim(part)
        return (inner != "").cast("int") + F.octet_length(inner) - F.octet_length(F.replace(inner, F.lit(" "), F.lit("")))

    return F.array_remove(F.transform(F.split(spaced_text, "[.!?] "), length), 0)


def beyond_letters(text: Column) -> Column:
    """The text without a-z and spaces: little is left, and all digits, symbols, capitals and marks are in it."""
    return F.regexp_replace(text, "[a-z ]+", "")


def digit_count(text: Column) -> Column:
    return count_of(text, _DIGIT)


def symbol_count(text: Column) -> Column:
    """Characters that are neither letters, numbers nor white space."""
    return count_of(text, _SYMBOL)


def uppercase_count(text: Column) -> Column:
    return count_of(text, _UPPER)


def vowel_groups(lowered: Column) -> Column:
    """Lower-cased ``spaced`` text, closed by a space, with every group of vowels and the consonants after it written as one ``a``.

    So a word is its first consonants and an ``a`` for every group, and nothing stands between these or behind them.
    """
    return F.regexp_replace(F.concat(lowered, F.lit(" ")), f"[{VOWELS}]+[^{VOWELS} ]*+", "a")


def _ends_in(groups: Column, end: str) -> Column:
    return ((F.octet_length(groups) - F.octet_length(F.replace(groups, F.lit(end), F.lit("")))) / len(end)).cast("bigint")


def syllable_count(groups: Column, n_words: Column) -> Column:
    """Vowel groups, plus one for each word that has none; takes ``vowel_groups`` output."""
    return count_char(groups, "a") + n_words - _ends_in(groups, "a ")


def complex_word_count(groups: Column) -> Column:
    """Words of three or more syllables; takes ``vowel_groups`` output."""
    return _ends_in(groups, "aaa ")


def snippet(text: Column, length: int = 120) -> Column:
    """The first ``length`` characters on one line, for reports."""
    return F.replace(F.substring(text, 1, length), F.lit("\n"), F.lit(" "))


def technicality(text: Column, terms: list[str], n_words: Column | None = None) -> Column:
    """Distinct terms found anywhere in the lower-cased text, per word."""
    lowered = F.lower(text)
    found = F.lit(0)
    for term in terms:
        found = found + F.contains(lowered, F.lit(term.lower())).cast("int")
    return found.cast("double") / F.greatest(F.lit(1).cast("bigint"), word_count(text) if n_words is None else n_words)


def squeezed(text: Column) -> Column:
    """Lower case with spaces (only the space character) taken out: the base of all character statistics."""
    return F.replace(F.lower(text), F.lit(" "), F.lit(""))


def char_ngrams(squeezed_text: Column, n: int) -> Column:
    """All overlapping character n-grams. Each match consumes one code point and captures ``n`` by
    look-ahead, so a text is scanned once; cutting substrings by position would walk it once per gram."""
    return F.regexp_extract_all(squeezed_text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def joined_words(text: Column) -> Column:
    """Lower-cased words, one space between and around them."""
    return F.concat(F.lit(" "), F.array_join(words(F.lower(text)), " "), F.lit(" "))


def word_ngrams(joined: Column, n: int) -> Column:
    """All overlapping word n-grams of ``joined_words`` output."""
    return F.regexp_extract_all(joined, F.lit(rf" (?=([^ ]+(?: [^ ]+){{{n - 1}}}) )"), F.lit(1))


def spaced_words(text: Column) -> Column:
    """Lower-cased words, each with a space of its own on both sides, so neighbours share none."""
    return F.concat(F.lit(" "), F.array_join(words(F.lower(text)), "  "), F.lit(" "))


def _quoted(literal: str) -> str:
    return "".join("\\" + c if c.isascii() and not c.isalnum() else c for c in literal)


def _overlaps_itself(parts) -> bool:
    """Whether some end of the sequence is also its beginning, as in "aba"."""
    return any(parts[:i] == parts[-i:] for i in range(1, len(parts)))


def _occurrences(base: Column, literal: str, overlapping: bool) -> Column:
    """Occurrences of ``literal``, overlaps included. Only a literal that can overlap itself needs the
    look-ahead pattern; any other is counted by how much shorter the text gets without it."""
    if overlapping:
        return count_of(base, f"(?s)(?={_quoted(literal)}).")
    removed = F.length(base) - F.length(F.replace(base, F.lit(literal), F.lit("")))
    return F.floor(removed / len(literal)).cast("bigint")


def count_char_ngram(squeezed_text: Column, gram: str) -> Column:
    """Occurrences of one character n-gram."""
    return _occurrences(squeezed_text, gram, _overlaps_itself(gram))


def count_word_ngram(spaced: Column, gram: str) -> Column:
    """Occurrences of one word n-gram in ``spaced_words`` output."""
    parts = gram.split(" ")
    return _occurrences(spaced, " " + "  ".join(parts) + " ", _overlaps_itself(parts))

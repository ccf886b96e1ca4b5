"""SQL fragments shared by the counterparts. They define every feature anew, word by word or by
grouping, independently of the way the Spark expressions compute it."""

from __future__ import annotations

from inkprint.functions.lexicons import FUNCTION_WORDS, STOP_WORDS, TECHNICAL_TERMS
from inkprint.operators.stylometry import style_columns

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def words_of(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{SPACE}+'), lambda w: w <> '')"


def count_char(expr: str, char: str) -> str:
    return f"CAST(length({expr}) - length(replace({expr}, '{char}', '')) AS BIGINT)"


def count_re(expr: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, '{pattern}')) AS BIGINT)"


def safe(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


# A small word-to-tag lexicon for the tag-count query.
LEXICON = {
    "this": "NN", "that": "NN", "der": "NN", "die": "NN", "la": "NN", "is": "VBZ", "are": "VBP", "was": "VBD",
    "be": "VB", "ist": "VB", "est": "VB", "and": "JJ", "und": "JJ", "the": "JJ", "not": "RB", "nicht": "RB",
    "pas": "RB", "no": "RB",
}


def _tagged(prefix: str) -> str:
    return quoted(w for w, tag in LEXICON.items() if tag.startswith(prefix))


def style_cte(source: str = "documents", lexicon: bool = False, name: str = "style") -> str:
    """CTEs ending in ``style``: doc_id, lang and every style column plus the helper counts."""
    pos = {
        column: f"CAST(len(list_filter(toks, lambda w: w IN ({_tagged(tag)}))) AS BIGINT)" if lexicon else "0::BIGINT"
        for column, tag in (("noun_count", "NN"), ("verb_count", "VB"), ("adj_count", "JJ"), ("adv_count", "RB"))
    }
    fw = ",\n".join(
        f"CAST(len(list_filter(lw, lambda w: w = '{w}')) AS BIGINT) AS fw_{w}" for w in FUNCTION_WORDS
    )
    syllables = "list_sum(list_transform(lw, lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+')))))"
    long_words = "len(list_filter(lw, lambda w: len(regexp_extract_all(w, '[aeiouy]+')) >= 3))"
    punct = " + ".join(count_char("text", c) for c in ".!?")
    return f"""
{name}_base AS (
  SELECT doc_id, lang, text, lower(text) AS low, {words_of('text')} AS ws, {words_of('lower(text)')} AS lw,
    regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS toks,
    list_filter(list_transform(regexp_split_to_array(text, '[.!?]{SPACE}+'), lambda s: len({words_of('s')})),
                lambda n: n > 0) AS lens
  FROM {source}),
{name}_w AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(lw) AS w FROM {name}_base) GROUP BY doc_id, w),
{name}_f AS (SELECT doc_id, count(*) AS u, count_if(n = 1) AS once, sum(n * n) AS sq FROM {name}_w GROUP BY doc_id),
{name}_c AS (SELECT doc_id, c, count(*) AS n
  FROM (SELECT doc_id, unnest(string_split(replace(low, ' ', ''), '')) AS c FROM {name}_base) WHERE c <> ''
  GROUP BY doc_id, c),
{name}_t AS (SELECT doc_id, sum(n) AS total FROM {name}_c GROUP BY doc_id),
{name}_e AS (SELECT c.doc_id, -sum((n / CAST(total AS DOUBLE)) * log2(n / CAST(total AS DOUBLE))) AS h
  FROM {name}_c c JOIN {name}_t t ON c.doc_id = t.doc_id GROUP BY c.doc_id),
{name} AS (
  SELECT b.doc_id, lang, text,
    CAST(len(ws) AS BIGINT) AS sentence_length, CAST(len(ws) AS BIGINT) AS word_count,
    CAST(length(text) AS BIGINT) AS char_count,
    coalesce(list_avg(list_transform(ws, lambda w: length(w))), 0.0::DOUBLE) AS avg_word_length,
    {count_char('text', '.')} AS period_count, {count_char('text', '!')} AS exclamation_count,
    {count_char('text', '?')} AS question_count, CAST({punct} AS BIGINT) AS punctuation_count,
    {count_char('text', ',')} AS comma_count, {count_char('text', ';')} AS semicolon_count,
    {count_char('text', ':')} AS colon_count, {count_char('text', '"')} AS double_quote_count,
    {count_char('text', "''")} AS single_quote_count,
    {count_char('text', '"')} + {count_char('text', "''")} AS quote_count,
    {count_re('text', chr(92) + 'p{Nd}')} AS digit_count,
    {count_re('text', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + SPACE[1:-1] + ']')} AS symbol_count,
    CAST(coalesce(list_max(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS longest_word,
    {safe(f'len(list_filter(lw, lambda w: w IN ({quoted(STOP_WORDS)})))', 'len(ws)')} AS stopword_ratio,
    {fw},
    CAST(len(lens) AS BIGINT) AS sentence_count,
    coalesce(list_avg(lens), 0.0::DOUBLE) AS avg_sentence_length,
    CASE WHEN len(lens) > 1 THEN list_aggregate(lens, 'stddev_samp') ELSE 0.0::DOUBLE END AS std_sentence_length,
    CAST(coalesce(u, 0) AS BIGINT) AS unique_words, {safe('coalesce(u, 0)', 'len(ws)')} AS lexical_diversity,
    {count_re('text', chr(92) + 'p{Lu}')} AS uppercase_count,
    {safe(count_re('text', chr(92) + 'p{Lu}'), 'length(text)')} AS uppercase_ratio,
    {', '.join(f'{v} AS {k}' for k, v in pos.items())},
    CASE WHEN len(ws) > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * ({safe('len(ws)', 'len(lens)')})
      - 84.6::DOUBLE * ({safe(syllables, 'len(ws)')}) ELSE 0.0::DOUBLE END AS flesch_reading_ease,
    0.4::DOUBLE * (({safe('len(ws)', 'len(lens)')}) + 100.0::DOUBLE * ({safe(long_words, 'len(ws)')})) AS gunning_fog,
    {safe(punct, 'length(text)')} AS punctuation_ratio,
    {safe(syllables, 'len(ws)')} AS avg_syllables_per_word,
    {safe('coalesce(once, 0)', 'len(ws)')} AS hapax_legomena_ratio,
    CASE WHEN len(ws) > 0 THEN 10000.0::DOUBLE * CAST(sq - len(ws) AS DOUBLE) / CAST(len(ws) * len(ws) AS DOUBLE)
      ELSE 0.0::DOUBLE END AS yules_k,
    coalesce(h, 0.0::DOUBLE) AS char_entropy
  FROM {name}_base b LEFT JOIN {name}_f f ON b.doc_id = f.doc_id LEFT JOIN {name}_e e ON b.doc_id = e.doc_id)"""


# Style columns that are doubles; the others are counts.
DOUBLE_COLUMNS = [
    "avg_word_length", "stopword_ratio", "avg_sentence_length", "std_sentence_length", "lexical_diversity",
    "uppercase_ratio", "flesch_reading_ease", "gunning_fog", "punctuation_ratio", "avg_syllables_per_word",
    "hapax_legomena_ratio", "yules_k", "char_entropy",
]


def column(name: str, digits: int = 6) -> str:
    return f"round({name}, {digits}) AS {name}" if name in DOUBLE_COLUMNS else name


def style_select(columns, lexicon: bool = False) -> str:
    return f"WITH {style_cte(lexicon=lexicon)} SELECT doc_id, {', '.join(column(c) for c in columns)} FROM style"


ALL_STYLE = style_columns()


def technicality(text: str) -> str:
    hits = " + ".join(f"CAST(contains(lower({text}), '{t.lower()}') AS INTEGER)" for t in TECHNICAL_TERMS)
    return f"CAST({hits} AS DOUBLE) / greatest(1, len({words_of(text)}))"


# Rule-based language guesses: the model-free predictions the metric queries are run on.
RULE_WORDS = {
    "de": ["der", "die", "und", "den", "von", "zu", "das"],
    "en": ["the", "of", "and", "to", "is", "that", "for"],
    "es": ["el", "los", "y", "las", "por", "del", "se"],
    "fr": ["le", "les", "et", "des", "du", "une", "est"],
}
RULE_LETTERS = {"de": "äöüß", "en": "wk", "es": "ñíó", "fr": "éèêç"}
LANGS = sorted(RULE_WORDS)


def argmax(prefix: str) -> str:
    arms = " ".join(
        f"WHEN {' AND '.join(f'{prefix}_{a} >= {prefix}_{b}' for b in LANGS if b != a)} THEN '{a}'" for a in LANGS
    )
    return f"CASE {arms} END"


def rule_cte() -> str:
    by_word = ", ".join(f"len(list_filter(lw, lambda w: w IN ({quoted(v)}))) AS w_{k}" for k, v in RULE_WORDS.items())
    by_letter = ", ".join(f"len(regexp_extract_all(low, '[{v}]')) AS c_{k}" for k, v in RULE_LETTERS.items())
    return f"""
scores AS (SELECT doc_id, lang, text, {by_word}, {by_letter}
  FROM (SELECT doc_id, lang, text, lower(text) AS low, {words_of('lower(text)')} AS lw FROM documents)),
rules AS (SELECT doc_id, lang, text, {argmax('w')} AS by_word, {argmax('c')} AS by_letter FROM scores),
preds AS (SELECT doc_id, lang AS true_label, by_word AS predicted_label FROM rules)"""


def seeded(key: str = "doc_id", seed: int = 42) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '-{seed}')"


def split_cte(fraction: float, label: str = "lang", source: str = "documents", name: str = "split") -> str:
    """Exact stratified split by largest remainder, by ranking each class in seeded order."""
    return f"""
{name}_c AS (SELECT {label} AS label, count(*) AS c FROM {source} GROUP BY 1),
{name}_n AS (SELECT sum(c) AS n, sum(c) - ceil(sum(c) * {fraction}::DOUBLE)::BIGINT AS n_train FROM {name}_c),
{name}_s AS (SELECT label, c, n_train * c // n AS share, n_train, row_number() OVER (ORDER BY n_train * c % n DESC, label) AS r
  FROM {name}_c, {name}_n),
{name}_q AS (SELECT label, c - share - CASE WHEN r <= n_train - sum(share) OVER () THEN 1 ELSE 0 END AS n_test FROM {name}_s),
{name} AS (SELECT doc_id, lang, text,
    CASE WHEN row_number() OVER (PARTITION BY {label} ORDER BY {seeded()}, doc_id) <= n_test THEN 'test' ELSE 'train' END AS split
  FROM {source} d JOIN {name}_q q ON d.{label} = q.label)"""


def folds_cte(k: int, ordered: bool, label: str = "lang", source: str = "documents", name: str = "folds") -> str:
    """Folds as blocks of each class, sized by dealing the classes end to end round-robin."""
    order = "doc_id" if ordered else f"{seeded()}, doc_id"
    return f"""
{name}_c AS (SELECT {label} AS label, count(*) AS c, min(doc_id) AS first FROM {source} GROUP BY 1),
{name}_p AS (SELECT label, coalesce(sum(c) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, c
  FROM {name}_c),
{name}_d AS (SELECT label, p % {k} AS fold FROM (SELECT label, unnest(generate_series(start::BIGINT, (start + c - 1)::BIGINT)) AS p
  FROM {name}_p)),
{name}_o AS (SELECT label, fold, row_number() OVER (PARTITION BY label ORDER BY fold) AS rn FROM {name}_d),
{name} AS (SELECT d.doc_id, d.lang, d.text, CAST(o.fold AS BIGINT) AS fold
  FROM (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {order}) AS rn FROM {source}) d
  JOIN {name}_o o ON o.label = d.{label} AND o.rn = d.rn)"""

"""The registered queries of this package: thin readings of each operator, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.llm import alignment, language, lm, mixing, pieces, quality, sharding, simhash, templates, token_counts, topk, toxicity, tries
from inkprint.llm.base import table
from inkprint.storage import materialize


#: Where the public tokenizer files are; a path that every executor can read.
PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract_pages(table(spark, sf_dir, "pages"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path(PIECES)
    coded = pieces.encode_documents(table(spark, sf_dir, "documents"), path, decoded=True)
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).alias("bytes_spanned"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(quality.ledger(table(spark, sf_dir, "documents")), "ledger")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(quality.BASE)).alias("base_failed"), quality.passes(quality.FULL).alias("kept"), "fail_bits",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of either policy costs, from the stored ledger; no text is read for it."""
    rows = materialize(quality.ledger(table(spark, sf_dir, "documents")), "ledger")
    return quality.ablation(rows, quality.BASE).union(quality.ablation(rows, quality.FULL))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict_languages(docs, language.fit_language_model(docs))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(BYTES))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_corpus(table(spark, sf_dir, "documents"), tokenizer_path(BYTES), tokenizer_path(PIECES))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.trie_nodes(tries.with_shared_heads(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality_rules": op4_quality_rules,
    "quality_ablation": quality_ablation,
    "op5_language_id": op5_language_id,
    "op6_token_counts": op6_token_counts,
    "op7_sharding": op7_sharding,
    "op8_simhash": op8_simhash,
    "op9_mixing": op9_mixing,
    "op10_top_k": op10_top_k,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_toxicity": op12_toxicity,
    "op13_prefix_trie": op13_prefix_trie,
}
_WORD = r"[^\x20\x09-\x0D]+"
_OP4_SQL = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
windows AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(ws) - 2),
  lambda i: {{'i': i, 'k': ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]}})) AS x FROM w),
twice AS (SELECT doc_id, x.i AS i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x.k) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
  len(list_filter(ws, lambda x: regexp_matches(x, '[a-zA-Z]|[^\x00-\x7F]'))) AS n_letter_words
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id),
ledger AS (SELECT *, CAST({' + '.join(f"CASE WHEN {rule.fails} THEN {1 << rule.bit} ELSE 0 END" for rule in quality.RULES)} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  fail_bits = 0 AS kept, fail_bits FROM ledger"""



def _ablation_sql(policy: quality.Policy) -> str:
    chosen = [rule for rule in quality.RULES if policy.mask >> rule.bit & 1]
    return " UNION ALL ".join(
        f"""SELECT '{policy.version}' AS version, '{rule.name}' AS rule, count(*) FILTER (b & {1 << rule.bit} <> 0) AS failed,
  count(*) FILTER (b = {1 << rule.bit}) AS failed_alone, count(*) FILTER (b = 0) AS kept, count(*) FILTER (b = 0 OR b = {1 << rule.bit}) AS kept_without
FROM (SELECT fail_bits & {policy.mask} AS b FROM ledger)""" for rule in chosen
    )


_ABLATION_SQL = f"{_OP4_SQL[:_OP4_SQL.rindex('SELECT doc_id, n_words')]}{_ablation_sql(quality.BASE)} UNION ALL {_ablation_sql(quality.FULL)}"

_OP10_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 5"""

#: CRC-32 by its bits, for decimal ids: the register starts full, every byte goes through eight shifts, the end is inverted.
_CRC32 = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, z: xor(x // 2, CASE WHEN x % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))), 4294967295)"""
_OP13_SQL = f"""WITH own AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, conv_id - conv_id % 100 AS base, {_CRC32.format("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM own),
r AS (SELECT h.conv_id, list_concat(coalesce(list_slice(b.turns, 1, h), []), list_slice(h.turns, h + 1, len(h.turns))) AS turns
  FROM h LEFT JOIN own b ON b.conv_id = h.base),
steps AS (SELECT conv_id, turns, unnest(generate_series(0, len(turns))) AS depth FROM r),
nodes AS (SELECT depth, list_slice(turns, 1, depth) AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
  coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = depth), '') AS ends FROM steps GROUP BY ALL),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = list_slice(n.path, 1, n.depth - 1)),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT l.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[depth].text) END AS saved
  FROM linked l LEFT JOIN children c USING (conv_id, depth)),
up AS (SELECT list_slice(path, 1, d) AS path, d AS depth, saved, n_children FROM (SELECT *, unnest(generate_series(0, depth)) AS d FROM full_nodes)),
sums AS (SELECT depth, path, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY ALL)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_nodes f JOIN sums s ON f.depth = s.depth AND f.path = s.path"""

ORACLES: dict[str, str] = {"op4_quality_rules": _OP4_SQL, "quality_ablation": _ABLATION_SQL, "op10_top_k": _OP10_SQL, "op13_prefix_trie": _OP13_SQL}

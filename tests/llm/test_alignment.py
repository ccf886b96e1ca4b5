"""Alignment of two tokenizers against intervals laid side by side in plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from inkprint.llm import alignment
from inkprint.llm.queries import BYTES, PIECES, op11_cross_tokenizer_alignment, tokenizer_path

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain_groups(text, a_tool, b_tool, to_byte):
    """The groups of a text as lists of ids of both sides, or none where a side does not spell it."""
    if not text:
        return []
    whole = (" " + text).encode()
    a = [(i, bytes(to_byte[c] for c in t)) for i, t in zip(*(lambda e: (e.ids, e.tokens))(a_tool.encode(" " + text, add_special_tokens=False)))]
    b = [(i, bytes([int(b_tool.id_to_piece(i)[3:5], 16)]) if b_tool.is_byte(i) else b_tool.id_to_piece(i).replace("▁", " ").encode()) for i in b_tool.encode(text)]
    if any(b"".join(x for _, x in side) != whole for side in (a, b)):
        return []
    groups, left, right, at_a, at_b, i, j = [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b:
            left.append(a[i][0])
            at_a += len(a[i][1])
            i += 1
        else:
            right.append(b[j][0])
            at_b += len(b[j][1])
            j += 1
        if at_a == at_b and right:
            groups.append((left, right))
            left, right = [], []
    return groups


def plain_rows(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_tool = Tokenizer.from_file(tokenizer_path(BYTES))
    a_tool.encode_special_tokens = True
    b_tool = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    to_byte = alignment.byte_alphabet()
    groups = [plain_groups(t, a_tool, b_tool, to_byte) for _, t in rows]
    counts = Counter((g[0][-1], g[1][-1]) for one in groups for g in one)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (doc_id, _), one in zip(rows, groups):
        links = [(g[0][-1], g[1][-1]) for g in one]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in one)
        out.append((
            doc_id, sum(len(x) for x, _ in one), sum(len(y) for _, y in one), len(one), len(links),
            sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if one else "",
        ))
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent", [0, 3, 1 << 18])
def test_rows_match_plain_alignment(spark, odd_docs, documents, frequent):
    docs = documents.limit(60).select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    docs = docs.union(docs.limit(9)).selectExpr("doc_id", "text", "1 as row", "'x' as links", "2 as `my col`")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = alignment.align_corpus(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as row", "'x' as links"), tokenizer_path(BYTES), tokenizer_path(PIECES), frequent)
    assert found.columns == COLUMNS and {t for _, t in found.dtypes} == {"bigint", "string"}
    assert sorted(map(tuple, found.collect()), key=str) == plain_rows(rows)


def test_terminals_match_components():
    rng = random.Random(1)
    for _ in range(300):
        size = rng.randint(1, 40)
        ends = [np.array(sorted({size, *rng.sample(range(1, size + 1), rng.randint(0, size))})) for _ in range(2)]
        both = sorted(set(ends[0]) & set(ends[1]))
        wanted = [[int(np.searchsorted(ends[1], next(c for c in both if c >= e))) for e in side] for side in ends]
        assert [x.tolist() for x in alignment.terminals(*ends)] == wanted


def test_one_long_component_converges():
    n = 50_000
    a, b = np.arange(1, n) * 2, np.arange(1, n) * 2 + 1
    a, b = np.append(a, 2 * n), np.append(b, 2 * n)
    assert all((x == n - 1).all() for x in alignment.terminals(a, b))


def test_query_over_the_table(spark, sf_dir, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert sorted(map(tuple, op11_cross_tokenizer_alignment(spark, sf_dir).collect()), key=str) == plain_rows(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.align_corpus(empty, tokenizer_path(BYTES), tokenizer_path(PIECES)).count() == 0


def test_ids_by_ranks_are_the_library_s(odd_docs, documents):
    tokens = alignment.ByteTokens(tokenizer_path(BYTES))
    assert tokens.ranked is not None
    texts = [r["text"] for r in odd_docs.collect() if r["text"]] + [r["text"] for r in documents.collect() if r["text"]]
    texts += ["a ", "  a  b ", "a\n b\n", "\n", " ", "don't  won't I'LL", "tab\t two", "<|endoftext|> b", "\u00a0x \u00a0", "1 2  3½", "x" * 5000, "é" * 999]
    rng = random.Random(3)
    texts += ["".join(rng.choice("abcXYZ 's\n\t09.,!é\u00a0ßÿ") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    found = tokens.encode(texts)
    tokens.ranked = None
    assert found == tokens.encode(texts)

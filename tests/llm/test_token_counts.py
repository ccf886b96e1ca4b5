"""Token counts against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inkprint.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "a", "the", "é", "漢", "🎉", "<|endoftext|>", "<|", "\u0000", "'s", "'ll", "12", "!", " ", "word",
         "\x1c", "\x85", "　", "\r\n", " \n", "ʼ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def length(library, text):
    return len(library.encode(text, add_special_tokens=False))


def test_parts_add_up_to_the_library_count(library):
    rng, counter = random.Random(9), token_counts.TokenCounter(PATH, {"the": 1, " the": 1, " word": 1})
    assert counter.by_parts
    for _ in range(4000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 14)))
        assert counter.count(text) == length(library, text)


def test_a_full_cache_starts_afresh():
    cache = token_counts.Remembered(len, 2)
    assert [cache["a" * n] for n in (1, 2, 3, 1)] == [1, 2, 3, 1] and len(cache) == 2


def test_other_files_are_counted_by_their_own_library(library):
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        counter = token_counts.TokenCounter(public_tokenizers.path(name))
        assert not counter.by_parts and counter.count("The words, the WORDS.") > 4 and counter.count("") == 0


@pytest.mark.parametrize("size", [0, 50])
def test_rows_of_all_kinds(odd_docs, library, size):
    counted = token_counts.count_tokens(odd_docs, PATH, limit=10, size=size).collect()
    wanted = sorted((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()), length(library, r["text"] or "")) for r in odd_docs.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in counted) == wanted
    assert all(r["over_limit"] == (r["n_tokens"] > 10) for r in counted)
    assert token_counts.count_tokens(odd_docs.where("false"), PATH).count() == 0


def test_summaries_find_the_frequent(odd_docs):
    assert token_counts.frequent_pre_tokens(odd_docs, size=1) == [" word"]


def test_long_keys_are_not_remembered():
    from inkprint.llm.pieces import LONGEST, Recent

    for cache in (token_counts.Remembered(len, 3), Recent(len, 3)):
        assert cache["x" * (LONGEST + 1)] == LONGEST + 1 and not cache
        assert [cache["a" * n] for n in (1, 2, 1, 3, 4, 1)] == [1, 2, 1, 3, 4, 1] and len(cache) <= 3

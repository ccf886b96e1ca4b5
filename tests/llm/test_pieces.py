"""Encoding, spans and decoding against the sentencepiece library."""

import random

import public_tokenizers
import pytest
import sentencepiece

from inkprint.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "▁", "a", "the", "é", "漢", "🎉", "\t", "<s>", "<0x41>", "\u0000", "ab", "!", "1", " ", "word"]
WIDE = [*PARTS, "ﬁ", "Ａ", "①", "㍿", "が", "が", "é", "Ü", "ｶﾞ", "​", "﻿", "…"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_texts_equal_the_library(library):
    rng, model = random.Random(5), pieces.load_model(PATH)
    for _ in range(3000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 14)))
        ids = model.encode(text.encode()).tolist()
        assert ids == library.encode(text)
        assert model.decode(ids) == library.decode(ids) == text.replace("▁", " ")
        some = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 259, 29871, 0, 1, 2]) for _ in range(rng.randint(0, 6))]
        assert model.decode(some) == library.decode(some)


def test_long_units_take_the_queue(library):
    rng, model = random.Random(6), pieces.load_model(PATH)
    for size in (47, 48, 49, 500, 20_000):
        text = "".join(rng.choices("thearndst", k=size))
        assert model.encode(text.encode()).tolist() == library.encode(text)


def test_spans_tile_the_original_bytes():
    rng, model = random.Random(7), pieces.load_model(PATH)
    for _ in range(500):
        text = "".join(rng.choices(PARTS, k=rng.randint(1, 14))).encode()
        ids, begin, end = model.encode_spans(text)
        assert len(ids) == len(begin) == len(end)
        assert begin[0] == 0 and end[-1] == len(text)
        for i in range(1, len(ids)):
            assert begin[i] in (end[i - 1], begin[i - 1])
        for i, a, b in zip(ids, begin, end):
            if i not in model.byte_of and b > a:
                assert text[a:b].decode().replace(" ", "▁") in (model.pieces[i], model.pieces[i][1:])


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_character_maps_normalise_as_the_library(rule, squeeze):
    normaliser = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    spec = next(dict(pieces.proto_fields(v)) for f, v in pieces.proto_fields(normaliser.serialized_model_proto()) if f == 3)
    model = pieces.PieceModel.__new__(pieces.PieceModel)
    model.charmap, model.plain, model.prefix, model.squeeze = pieces.CharacterMap(spec[2]), False, True, squeeze
    rng = random.Random(8)
    for _ in range(1500):
        text = "".join(rng.choices(WIDE, k=rng.randint(0, 12)))
        made, begin, end = model.normalise(text.encode())
        assert made == normaliser.normalize(text)
        assert len(begin) == len(end) == len(made.encode())
        assert all(a <= b for a, b in zip(begin, end)) and sorted(begin) == list(begin)


def test_rows_of_all_kinds(spark, odd_docs, library):
    coded = pieces.decode_ids(pieces.encode_documents(odd_docs, PATH), PATH).collect()
    texts = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in odd_docs.collect()))
    assert len(coded) == len(texts)
    for r, (_, _, text) in zip(sorted(coded, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["decoded"])), texts):
        assert r["ids"] == library.encode(text)
        assert r["decoded"] == text.replace("▁", " ")
        assert (r["ends"][-1] if text else 0) == len(text.encode())
    assert pieces.encode_documents(odd_docs.where("false"), PATH).count() == 0

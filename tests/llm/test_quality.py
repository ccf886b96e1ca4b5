"""Measurements, policies and ablations against plain counting."""

import random
import re

from inkprint.llm import quality

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def plain(text):
    words = [w for w in SPACE.split(text or "") if w]
    lines = [line for line in (text or "").split("\n") if SPACE.sub("", line)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
        sum(line in lines[:i] for i, line in enumerate(lines)), len(covered),
    )


def test_measurements_match_plain_counting():
    rng = random.Random(10)
    for _ in range(400):
        text = "".join(rng.choice(["a ", "b ", "c ", "é ", "#x ", "\n", "a b\n", "\t", "||", " "]) for _ in range(rng.randint(0, 40)))
        assert quality.measure(text.encode())[:5] == plain(text)


def test_rows_policies_and_ablation(odd_docs):
    rows = quality.ledger(odd_docs).cache()
    found = rows.collect()
    assert len(found) == odd_docs.count()
    by_name = {r.name: r for r in quality.RULES}
    for r in found:
        assert bool(r["fail_bits"] & 1) == (r["n_words"] < 50)
        assert bool(r["fail_bits"] >> 1 & 1) == (100 * r["n_repeat_words"] > 50 * r["n_words"])
    masks = [r["fail_bits"] & quality.FULL.mask for r in found]
    for r in quality.ablation(rows).collect():
        bit = 1 << by_name[r["rule"]].bit
        assert r["failed"] == sum(bool(m & bit) for m in masks)
        assert r["failed_alone"] == sum(m == bit for m in masks)
        assert r["kept"] == masks.count(0) and r["kept_without"] == masks.count(0) + r["failed_alone"]
    empty = quality.ablation(rows.where("false")).collect()
    assert len(empty) == len(quality.RULES) and all(r["kept"] == r["failed"] == 0 for r in empty)


def test_the_filter_keeps_rows_whole(odd_docs, documents):
    assert quality.filter_quality(odd_docs).columns == odd_docs.columns
    assert quality.filter_quality(documents.where("false")).count() == 0
    kept = {r["doc_id"] for r in quality.filter_quality(documents).collect()}
    verdict = quality.ledger(documents)
    assert kept == {r["doc_id"] for r in verdict.where(quality.passes(quality.FULL)).collect()}

"""Token counts by a two-tier lookup of pre-token lengths.

A byte-level tokenizer cuts a text into pre-tokens before it merges anything, so a text has as many tokens as its pre-tokens have
together, and pre-tokens repeat. The most frequent ones are found by merging bounded summaries that every task makes of
its own rows; their lengths, some hundred thousand bytes, are broadcast. Any other pre-token is encoded once
per worker and remembered there. No pre-token is ever shuffled.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.base import map_rows, text_bytes
from inkprint.storage import materialize

#: Fixed value: the public pattern by which byte-level tokenizers of this kind cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the broadcast table; entries of one task's summary; entries a worker's cache holds before it starts afresh, and the
#: length of text beyond which it holds none.
FREQUENT, SUMMARY, REMEMBERED, LONGEST = 32_768, 8_192, 400_000, 128
#: Summaries that are merged together at a time.
FAN_IN = 32
#: White space of any kind. A single blank after anything else always begins a new pre-token.
_SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_AFTER_SPACE = re.compile(f"[{_SPACE}] ")
_CUT = re.compile(f"(?<![{_SPACE}]) ")
_PRE_TOKEN = regex.compile(PATTERN)
#: A character beyond those that are cut alike by every version of the Unicode tables.
UNSETTLED = re.compile(r"[^\t-\r\x20-\x7e\xa1-\u024f]")


def cut(text: str) -> list[str]:
    """The text between blanks at which a new pre-token always begins; all but the first part had a blank before it."""
    return _CUT.split(text) if _AFTER_SPACE.search(text) else text.split(" ")


class Remembered(dict):
    """A bounded cache: what is missing is computed and kept, unless it is long; when full, it starts afresh."""

    def __init__(self, compute: Callable[[str], int], limit: int = REMEMBERED):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key: str) -> int:
        value = self.compute(key)
        if len(key) > LONGEST:
            return value
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


class TokenCounter:
    """Counts as the library gives them for the tokenizer file at ``path``: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        self.frequent, self.specials = frequent or {}, []
        self.by_parts = False
        if path.endswith(".model"):
            from inkprint.llm.pieces import load_model

            self.encode_length = lambda text: len(load_model(path).encode(text.encode()))
            return
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.encode_length = lambda text: len(tokenizer.encode(text, add_special_tokens=False))
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.specials = [t["content"] for t in added]
        self.by_parts = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in added)
        )
        self.rest = Remembered(self.encode_length)
        self.first_part = Remembered(self.part_length)
        self.later_part = Remembered(lambda part: self.part_length(" " + part))

    def part_length(self, part: str) -> int:
        """Tokens of one part. Its pre-tokens are looked up in the broadcast table first, then in the worker's own cache."""
        if UNSETTLED.search(part) or any(s in part for s in self.specials):
            return self.encode_length(part)
        total = 0
        for token in _PRE_TOKEN.findall(part):
            length = self.frequent.get(token)
            total += self.rest[token] if length is None else length
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_parts:
            return self.encode_length(text)
        parts = cut(text)
        return self.first_part[parts[0]] + sum(map(self.later_part.__getitem__, parts[1:]))


def frequent_pre_tokens(docs: DataFrame, size: int = FREQUENT, summary: int = SUMMARY) -> list[str]:
    """The pre-tokens that summaries of all rows find most frequent, at most ``size``.

    Every task counts its rows and hands on its ``summary`` most frequent ones; summaries are merged FAN_IN at a time
    until few enough are left for the driver, each merge as bounded as its parts. The list steers speed, never a count.
    """
    summaries = materialize(docs.select("text").mapInArrow(_summaries(summary), "tokens array<string>, counts array<bigint>"), "summaries")
    while (n := summaries.count()) > FAN_IN:
        merged = summaries.repartition(-(-n // FAN_IN)).mapInArrow(_merges(summary), summaries.schema)
        summaries = materialize(merged, "summaries")
    total: Counter = Counter()
    for row in summaries.toLocalIterator():
        total.update(dict(zip(row["tokens"], row["counts"])))
    return [t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]]


def _summaries(size: int):
    def run(batches):
        first, later, total = Counter(), Counter(), Counter()

        def settle():
            for counts, lead in ((first, ""), (later, " ")):
                for part, n in counts.items():
                    for token in _PRE_TOKEN.findall(lead + part):
                        total[token] += n
                counts.clear()
            if len(total) > REMEMBERED:
                kept = total.most_common(REMEMBERED // 4)
                total.clear()
                total.update(dict(kept))

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    parts = cut(text)
                    first[parts[0]] += 1
                    later.update(parts[1:])
            if len(first) + len(later) > REMEMBERED:
                settle()
        settle()
        yield _summary(total, size)

    return run


def _merges(size: int):
    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for tokens, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total.update(dict(zip(tokens, counts)))
        yield _summary(total, size)

    return run


def _summary(total: Counter, size: int) -> pa.RecordBatch:
    kept = total.most_common(size)
    return pa.RecordBatch.from_arrays(
        [pa.array([[k for k, _ in kept]], pa.list_(pa.string())), pa.array([[n for _, n in kept]], pa.list_(pa.int64()))],
        names=["tokens", "counts"],
    )


_counters: dict[str, TokenCounter] = {}


def _counter(path: str, table: str, shared) -> TokenCounter:
    """The counter of this worker for one broadcast table."""
    if table not in _counters:
        tokens, lengths = shared.value
        _counters.clear()
        _counters[table] = TokenCounter(path, dict(zip(tokens.split("\0"), lengths)) if lengths else {})
    return _counters[table]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, size: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; whole texts, null and empty texts have 0 of both.

    No begin, end or added special tokens, truncation or padding; a special string inside a text counts as the library's
    default has it. ``path`` must be readable where tasks run. Repeated rows give repeated results.
    """
    plain = TokenCounter(path)
    tokens = frequent_pre_tokens(docs, size) if plain.by_parts else []
    lengths = {t: plain.encode_length(t) for t in tokens if "\0" not in t}
    lengths = {t: n for t, n in lengths.items() if n < 256}
    shared = docs.sparkSession.sparkContext.broadcast(("\0".join(lengths), bytes(lengths.values())))
    table = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        counter = _counter(path, table, shared)
        texts = [t or b"" for t in text_bytes(batch, "text")]
        return {
            "doc_id": batch.column(0), "n_bytes": [len(t) for t in texts], "n_tokens": [counter.count(t.decode()) for t in texts],
        }

    counted = map_rows(docs.select("doc_id", "text"), run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

"""Alignment of two tokenizers over the same bytes.

Tokens of both are intervals of the bytes of blank + text. Every token points to the farthest-right token that it overlaps; doubling
these successors, whole batches at a time, leads each token to the last token of its connected component, which names the group.
Groups end where tokens of both end. Links, the pairs of tokens that end together, are counted over the corpus: the most frequent
pairs are looked up in a bounded broadcast table, the others by a join.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.base import map_rows
from inkprint.llm.token_counts import PATTERN, UNSETTLED, TokenCounter
from inkprint.storage import materialize

#: Entries of the broadcast table of frequent pairs.
FREQUENT = 1 << 18
#: Bytes of text that are encoded and aligned together; a longer text is taken alone.
BATCH_BYTES = 1 << 20


# -- the two tokenizers ---------------------------------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """Side A: a byte-level tokenizer file of the ``tokenizers`` library, special strings taken as plain text.

    If the file's merges stand in order of its ids, ``tiktoken`` gives the same ids from its vocabulary as ranks, four times as
    fast; it takes the texts of characters about which all Unicode tables agree, and the file's own library all others.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        to_byte, vocabulary = byte_alphabet(), model["vocab"]
        self.surfaces = [b""] * (max([*vocabulary.values(), self.tokenizer.get_vocab_size() - 1]) + 1)
        for token, i in vocabulary.items():
            if all(c in to_byte for c in token):
                self.surfaces[i] = bytes(to_byte[c] for c in token)
        self.ranked = self._ranked(model) if TokenCounter(path).by_parts else None

    def _ranked(self, model: dict):
        """The encoder by ranks, or None where ids do not tell the order of merges."""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"].get("".join(m), -1) for m in merges]
        if made != sorted(set(made)) or any(i <= 255 for i in made):
            return None
        import tiktoken

        ranks = {self.surfaces[i]: i for i in model["vocab"].values() if self.surfaces[i] and i <= made[-1]}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        found = [None if self.ranked is None or UNSETTLED.search(t) else self.ranked.encode_ordinary(" " + t) for t in texts]
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([" " + texts[i] for i in rest], add_special_tokens=False)):
            found[i] = e.ids
        return found


class PieceTokens:
    """Side B: a model file of the ``sentencepiece`` library, which puts the blank before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.surfaces = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.surfaces.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


# -- alignment of intervals -----------------------------------------------------------------------------------------


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token of A and of B the number of the last token of B in its connected component of overlapping tokens.

    Both cover the same bytes without gaps; ``*_ends`` are the ascending ends. Nodes are the tokens of A, then those of B. A token
    points to the token of the other side that covers its last byte, which is the farthest-right one it overlaps; where both end
    together A points to B and B to itself. Successors are doubled until nothing moves.
    """
    n = len(a_ends)
    in_b, in_a = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)
    here = np.arange(n, n + len(b_ends))
    together = a_ends[np.minimum(in_a, n - 1)] == b_ends if n else np.zeros(len(b_ends), bool)
    follow = np.concatenate([n + in_b, np.where(together, here, in_a)])
    while True:
        farther = follow[follow]
        if np.array_equal(farther, follow):
            return follow[:n] - n, follow[n:] - n
        follow = farther


class Digits:
    """Decimal numbers with a separator behind each, joined without a Python object per number."""

    def __init__(self, numbers: int):
        texts = [str(i).encode() for i in range(numbers)]
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.wide = int(self.lengths.max(initial=1)) + 1
        self.table = np.frombuffer(b"".join(t.ljust(self.wide) for t in texts), np.uint8).reshape(-1, self.wide)

    def join(self, ids: np.ndarray, separators: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The numbers with their separators as one string, and where each number's part ends."""
        rows, sizes = self.table[ids], self.lengths[ids]
        rows[np.arange(len(ids)), sizes] = separators
        shown = np.arange(self.wide) <= sizes[:, None]
        return rows[shown].tobytes(), np.cumsum(sizes + 1)


@dataclass
class Aligned:
    """What one text gives: numbers of tokens and groups, the hash of its groups, and its links, coded as a * width + b."""

    n_a: int
    n_b: int
    n_groups: int
    digest: str
    links: np.ndarray


NOTHING = Aligned(0, 0, 0, "", np.zeros(0, np.int64))


class Aligner:
    """Aligns texts between two tokenizers."""

    def __init__(self, a, b):
        self.a, self.b, self.width = a, b, len(b.surfaces)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side.surfaces], np.int64) for side in (a, b))
        self.digits = Digits(max(len(a.surfaces), len(b.surfaces)))

    def align(self, texts: list[str | None]) -> list[Aligned]:
        """Null and empty texts, and those that the tokens of a side do not spell, have no tokens."""
        at = [i for i, t in enumerate(texts) if t]
        some = [texts[i] for i in at]
        a, b = self.a.encode(some), self.b.encode(some)
        spelled = [k for k, t in enumerate(some) if self._spells(t, a[k], b[k])]
        found = [NOTHING] * len(texts)
        for k, aligned in zip(spelled, self._together([a[k] for k in spelled], [b[k] for k in spelled])):
            found[at[k]] = aligned
        return found

    def _spells(self, text: str, a: list[int], b: list[int]) -> bool:
        whole = b" " + text.encode()
        return all(b"".join(map(side.surfaces.__getitem__, ids)) == whole for side, ids in ((self.a, a), (self.b, b)))

    def _together(self, a: list[list[int]], b: list[list[int]]) -> list[Aligned]:
        """All texts side by side: no token reaches over the end of its text, so no group does."""
        if not a:
            return []
        a_counts, b_counts = (np.array([len(x) for x in ids]) for ids in (a, b))
        a_ids, b_ids = (np.concatenate([np.asarray(x, np.int64) for x in ids]) for ids in (a, b))
        a_last, b_last = terminals(np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids]))
        # Terminal tokens end together with a token of A: the one before the next group's first.
        last_b, group_of_b = np.unique(b_last, return_inverse=True)
        group_of_a = np.searchsorted(last_b, a_last)
        groups = len(last_b)
        last_a = np.cumsum(np.bincount(group_of_a, minlength=groups)) - 1
        links = a_ids[last_a] * self.width + b_ids[last_b]
        # Groups in order, in each the tokens of A, then those of B: a token moves by the other side's tokens before it.
        before_b = np.concatenate([[0], last_b + 1])
        place_a = np.arange(len(a_ids)) + before_b[group_of_a]
        place_b = np.arange(len(b_ids)) + last_a[group_of_b] + 1
        ids, marks = np.empty(len(a_ids) + len(b_ids), np.int64), np.full(len(a_ids) + len(b_ids), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a_ids, b_ids
        marks[place_a[last_a]], marks[place_b[last_b]] = ord("|"), ord(";")
        text, ends = self.digits.join(ids, marks)
        tokens = np.cumsum(a_counts + b_counts)
        stops = ends[tokens - 1].tolist()
        group_stops = np.searchsorted(last_b, np.cumsum(b_counts) - 1) + 1
        found = []
        for i, (start, stop, first, behind) in enumerate(zip([0, *stops], stops, [0, *group_stops.tolist()], group_stops.tolist())):
            digest = hashlib.sha256(text[start:stop - 1]).hexdigest()
            found.append(Aligned(int(a_counts[i]), int(b_counts[i]), behind - first, digest, links[first:behind]))
        return found


@lru_cache(maxsize=1)
def load_aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of two files, read once in each worker; the paths must be readable where tasks run."""
    return Aligner(ByteTokens(a_path), PieceTokens(b_path))


def _pieces(texts: list[str | None], limit: int):
    """Neighbouring texts of about ``limit`` characters together."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text or "") > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield held


# -- over the corpus --------------------------------------------------------------------------------------------------


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, groups_sha256, links of every row; whole texts.

    ``row`` numbers the rows once the result is written. ``links`` holds one code per pair of tokens that end together: the id
    of A times the size of B's vocabulary, plus the id of B.
    """

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        aligner, texts = load_aligner(a_path, b_path), batch.column(1).to_pylist()
        found = [x for some in _pieces(texts, BATCH_BYTES) for x in aligner.align(some)]
        return {
            "row": batch.column(2), "doc_id": batch.column(0), "n_a": [f.n_a for f in found], "n_b": [f.n_b for f in found],
            "n_groups": [f.n_groups for f in found], "groups_sha256": [f.digest for f in found], "links": _long_lists([f.links for f in found]),
        }

    schema = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<bigint>"
    return map_rows(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), run, schema)


def _long_lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """pair, n, best: how many links of the whole corpus hold each pair, and whether no pair of its B id has more."""
    pairs = aligned.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    pairs = materialize(pairs.withColumn("b", F.col("pair") % width), "pairs")
    # One row per id of B: no more than the vocabulary holds.
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return pairs.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``aligned`` without its links but with n_links, n_best and count_sum.

    The ``frequent`` most frequent pairs are broadcast as sorted arrays; links of other pairs are joined to ``counts`` by pair.
    """
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).toPandas().sort_values("pair")
    shared = aligned.sparkSession.sparkContext.broadcast(
        (top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(np.int64)),
    )
    kept = [f for f in aligned.schema.fields if f.name != "links"]

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        pairs, n, best = shared.value
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        lists = columns.pop("links")
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        links = lists.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(pairs, links), max(0, len(pairs) - 1))
        known = pairs[at] == links if len(pairs) else np.zeros(len(links), bool)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        sums = [np.bincount(owner[known], x[at[known]], len(lengths)).astype(np.int64) if len(pairs) else np.zeros(len(lengths), np.int64) for x in (best, n)]
        rare = np.split(links[~known], np.cumsum(np.bincount(owner[~known], minlength=len(lengths)))[:-1]) if len(lengths) else []
        return {**columns, "n_links": lengths, "n_best": sums[0], "count_sum": sums[1], "rare": _long_lists(rare)}

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", n_links bigint, n_best bigint, count_sum bigint, rare array<bigint>"
    scored = materialize(map_rows(aligned.select(*[f.name for f in kept], "links"), run, schema), "scored")
    met = scored.select("row", F.explode("rare").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times")).join(counts, "pair")
    rare = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"),
    )
    with_rare = scored.where("size(rare) > 0").join(rare, "row").select(
        *[f.name for f in kept], "n_links", (F.col("n_best") + F.col("more_best")).alias("n_best"), (F.col("count_sum") + F.col("more_sum")).alias("count_sum"),
    )
    return scored.where("size(rare) = 0").drop("rare").union(with_rare)


def align_corpus(docs: DataFrame, a_path: str, b_path: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    Texts that are null or empty, or that the joined tokens of a side do not spell with a blank before, have zeros and an
    empty hash; whole texts, however long; repeated rows each count and give a row each; an empty table gives an empty one.
    """
    aligned = materialize(align_documents(docs, a_path, b_path), "aligned")
    width = len(load_aligner(a_path, b_path).b.surfaces)
    scored = score_links(aligned, materialize(pair_counts(aligned, width), "pair_counts"), frequent)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

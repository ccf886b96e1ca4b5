"""SentencePiece encoding and decoding with byte offsets into the original text.

The text is normalised first: at every position the longest prefix known to the model's compiled character map is replaced,
otherwise one character is copied, and each normalised byte remembers the span of source bytes that it came from.
Pieces are then merged best score first, as the byte-pair model says, and every piece is projected through that record to a span
of the original text. Since no piece continues over a blank, a blank starts a unit that can be encoded by itself; units
repeat, so each worker keeps what it has encoded.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkprint.llm.base import map_rows, text_bytes

BLANK = "▁"
#: Piece types and field numbers of the public model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Units of up to so many characters are merged without a queue; the cost of a merge that no piece allows.
SHORT, NEVER = 48, float("inf")
#: Units that a worker remembers before it starts afresh, and the length beyond which it remembers none.
REMEMBERED, LONGEST = 300_000, 128


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = varint(at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """A compiled character map: a double-array trie over source strings, followed by their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size:] if blob else b""

    def longest(self, text: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of ``text[start:]`` and what it becomes."""
        if not self.units:
            return None
        found, at = None, self._offset(self.units[0])
        for i in range(start, len(text)):
            at ^= text[i]
            unit = self.units[at]
            if unit & 0x800000FF != text[i]:
                break
            at ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - start, self.units[at] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.replacements[found[1]:self.replacements.index(b"\0", found[1])]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)


class Recent(dict):
    """A bounded cache of two generations: when the younger is full it becomes the older, whose entries return when used.

    Long keys, which hardly come again, are computed each time, so the bound on entries bounds the bytes.
    """

    def __init__(self, compute, limit: int = REMEMBERED):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > LONGEST:
                return value
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceModel:
    """A byte-pair model read from a ``.model`` file."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.types = [], [], []
        self.prefix, self.squeeze, self.escape, charmap, kind, self.byte_fallback = True, True, True, b"", 1, False
        for field, value in proto_fields(data):
            if field == 1:
                piece = dict(proto_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.types.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(proto_fields(value))
                kind, self.byte_fallback = trainer.get(3, 1), bool(trainer.get(35, 0))
            elif field == 3:
                spec = dict(proto_fields(value))
                charmap = spec.get(2, b"")
                self.prefix, self.squeeze, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        if kind != 2 or {USER, UNUSED} & set(self.types) or not self.escape:
            raise ValueError("only byte-pair models without user-defined or unused pieces, with escaped blanks, are read")
        self.charmap = CharacterMap(charmap)
        self.plain = not charmap and not self.squeeze
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = self.types.index(UNKNOWN) if UNKNOWN in self.types else 0
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece continues over a blank: texts cannot be cut into units")
        # A line feed that no longer piece holds never merges, so it is a unit of its own.
        alone = "\n" if not any("\n" in p and len(p) > 1 for p in self.ids) else ""
        self.unit = re.compile(f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+|\n")
        self.packed = {p: np.int32(i).tobytes() for p, i in self.ids.items()}
        self.cost = {p: -self.scores[i] for p, i in self.ids.items()}
        self.neighbours = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.sizes = np.array([1 if t == BYTE else len(p.encode()) for p, t in zip(self.pieces, self.types)], np.int64)
        self.surfaces = [
            b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else bytes([self.byte_of[i]]) if t == BYTE
            else p.replace(BLANK, " ").encode()
            for i, (p, t) in enumerate(zip(self.pieces, self.types))
        ]
        self.control = {i for i, t in enumerate(self.types) if t == CONTROL}
        self.known = Recent(self._encode_unit)

    # -- normalisation ------------------------------------------------------------------------------------------

    def normalise(self, text: bytes) -> tuple[str, np.ndarray, np.ndarray]:
        """Normalised text, and for each of its UTF-8 bytes the first and the last + 1 source byte that it came from."""
        if not text:
            return "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.plain:
            return self._normalise_plain(text)
        chunks, at = [], 0
        while at < len(text):
            known = self.charmap.longest(text, at)
            if known:
                size, made = known
            else:
                size = _char_size(text[at])
                made = text[at:at + size]
            chunks.append((made, at, at + size))
            at += size
        return self._join(chunks)

    def _join(self, chunks: list[tuple[bytes, int, int]]) -> tuple[str, np.ndarray, np.ndarray]:
        """Chunks in one string; with ``squeeze``, blanks at the ends go and runs of them become one."""
        blank, out, begin, end = BLANK.encode(), [], [], []

        def put(data: bytes, a: int, b: int) -> None:
            out.append(data)
            begin.extend([a] * len(data))
            end.extend([b] * len(data))

        if self.squeeze:
            while chunks and chunks[0][0] == b" ":
                chunks.pop(0)
        if not chunks:
            return "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.prefix:
            put(blank, chunks[0][1], chunks[0][1])
        after_blank = self.squeeze
        for made, a, b in chunks:
            if after_blank:
                made = made.lstrip(b" ")
            if not made:
                continue
            for char in made.decode():
                put(blank if char == " " else char.encode(), a, b)
            after_blank = self.squeeze and made.endswith(b" ")
        if self.squeeze:
            while out and out[-1] == blank:
                size = len(out.pop())
                del begin[-size:], end[-size:]
        return b"".join(out).decode(), np.array(begin, np.int64), np.array(end, np.int64)

    def _normalise_plain(self, text: bytes) -> tuple[str, np.ndarray, np.ndarray]:
        """Without a map each character is its own chunk: the same record, made by array operations."""
        string = self.normalised_plain(text)
        data = np.frombuffer(text, np.uint8)
        if text.isascii():
            starts, sizes = np.arange(len(data), dtype=np.int32), 1
        else:
            starts = np.flatnonzero(data & 0xC0 != 0x80).astype(np.int32)
            sizes = np.diff(starts, append=np.int32(len(data)))
        made = np.where(data[starts] == 32, 3, sizes)
        begin, end = np.repeat(starts, made), np.repeat(starts + sizes, made)
        if self.prefix:
            begin, end = (np.concatenate([np.zeros(3, np.int32), x]) for x in (begin, end))
        return string, begin, end

    def normalised_plain(self, text: bytes) -> str:
        return (BLANK if self.prefix and text else "") + text.decode().replace(" ", BLANK)

    # -- encoding -----------------------------------------------------------------------------------------------

    def unit_pieces(self, unit: str) -> list[str]:
        """The pieces of one unit: neighbours are merged in order of score, the leftmost first among equals."""
        return self._merge_short(unit) if len(unit) <= SHORT else self._merge_long(unit)

    def _merge_short(self, unit: str) -> list[str]:
        parts, cost = list(unit), self.cost.get
        costs = [cost(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while costs:
            least = min(costs)
            if least == NEVER:
                break
            i = costs.index(least)
            parts[i] += parts.pop(i + 1)
            del costs[i]
            if i:
                costs[i - 1] = cost(parts[i - 1] + parts[i], NEVER)
            if i < len(costs):
                costs[i] = cost(parts[i] + parts[i + 1], NEVER)
        return parts

    def _merge_long(self, unit: str) -> list[str]:
        """As for a short unit, with a queue of the possible merges, so that time does not grow with the square of the length."""
        parts, ids, scores = list(unit), self.ids, self.scores
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            found = ids.get(parts[i] + parts[j])
            if found is not None:
                heapq.heappush(queue, (-scores[found], i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, piece = heapq.heappop(queue)
            if not parts[i] or not parts[j] or right[i] != j or parts[i] + parts[j] != piece:
                continue
            parts[i], parts[j] = piece, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
                offer(i, right[j])
            if left[i] >= 0:
                offer(left[i], i)
        return [p for p in parts if p]

    def _encode_unit(self, unit: str) -> bytes:
        """The ids of one unit, packed. Two neighbouring characters that no piece holds side by side are never joined, so a
        unit that is met for the first time is cut there, and its parts are often known already."""
        neighbours = self.neighbours
        cuts = [i for i, pair in enumerate(map("".join, zip(unit, unit[1:])), 1) if pair not in neighbours]
        if cuts:
            return b"".join([self.known[unit[a:b]] for a, b in zip([0, *cuts], [*cuts, len(unit)])])
        pieces, ids = self.unit_pieces(unit), self.packed
        return b"".join([ids[p] if p in ids else np.array(self.piece_ids(p), np.int32).tobytes() for p in pieces])

    def piece_ids(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is None and self.byte_fallback:
            return [self.byte_ids[b] for b in piece.encode()]
        return [self.unknown if found is None else found]

    def piece_sizes(self, string: str, ids: np.ndarray) -> np.ndarray:
        """Normalised bytes of each piece: one for a byte piece, otherwise those of its name or, if unknown, of its part."""
        if self.byte_fallback or self.unknown not in ids:
            return self.sizes[ids]
        pieces = [p for u in self.unit.findall(string) for p in self.unit_pieces(u)]
        return np.array([len(p.encode()) for p in pieces], np.int64)

    def _ids(self, string: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.unit.findall(string))), np.int32)

    def encode(self, text: bytes | None) -> np.ndarray:
        return self._ids(self.normalised_plain(text or b"") if self.plain else self.normalise(text or b"")[0])

    def encode_spans(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first and last + 1 byte of the original text that each piece stands for."""
        string, begin, end = self.normalise(text or b"")
        ids = self._ids(string)
        if not len(ids):
            return ids, begin, end
        sizes = self.piece_sizes(string, ids)
        stops = np.cumsum(sizes)
        return ids, begin[stops - sizes], end[stops - 1]

    # -- decoding -----------------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids. Bytes that are no UTF-8 become U+FFFD each; the blank put before a text is removed."""
        if not self.control.isdisjoint(ids):
            return self._decode_around(ids)
        data = b"".join(map(self.surfaces.__getitem__, ids))
        if ids and data[:1] == b" " and self.types[ids[0]] == NORMAL:
            data = self._without_prefix(data)
        return _utf8(data)

    def _decode_around(self, ids: list[int]) -> str:
        """As ``decode``, where control pieces stand for nothing but end a run of bytes."""
        runs: list[list[int]] = [[]]
        for i in ids:
            if i in self.control:
                runs.append([])
            else:
                runs[-1].append(i)
        data = [b"".join(map(self.surfaces.__getitem__, run)) for run in runs]
        first = next((n for n, run in enumerate(runs) if run), 0)
        if runs[first] and data[first][:1] == b" " and self.types[runs[first][0]] == NORMAL:
            data[first] = self._without_prefix(data[first])
        return "".join(map(_utf8, data))

    def _without_prefix(self, data: bytes) -> bytes:
        return data.lstrip(b" ") if self.squeeze else data[1:] if self.prefix else data


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return _decode_each(data)


def _decode_each(data: bytes) -> str:
    """UTF-8 with one U+FFFD for every byte that belongs to no character."""
    out, at = [], 0
    while at < len(data):
        size = _char_size(data[at])
        try:
            out.append(data[at:at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


def _char_size(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


@lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    """The model of a file, read once in each worker. ``path`` must be readable where tasks run."""
    with open(path, "rb") as file:
        return PieceModel(file.read())


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate([np.zeros(0, np.int32), *rows])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32, copy=False)))


def _rows_of(lists: pa.ListArray) -> list[list[int]]:
    """A list column as Python lists, by way of one flat array; a null row is an empty list."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(_lengths(lists), dtype=np.int64)
    return [flat[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist())]


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def encode_documents(docs: DataFrame, path: str, spans: bool = True, decoded: bool = False) -> DataFrame:
    """doc_id, ids and, with ``spans``, begins and ends: byte offsets of each piece in the UTF-8 text of its row.

    Whole texts, no begin or end ids. Null and empty texts give empty lists; every row of ``docs`` gives one row. With
    ``decoded`` the ids are decoded again in the same pass, as by ``decode_ids``.
    """

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        model, texts = load_model(path), text_bytes(batch, "text")
        found = [model.encode_spans(t) if spans else (model.encode(t),) for t in texts]
        columns = {"doc_id": batch.column(0)} | {n: _lists(list(c)) for n, c in zip(("ids", "begins", "ends"), zip(*found))}
        return columns | ({"decoded": [model.decode(f[0].tolist()) for f in found]} if decoded else {})

    schema = "doc_id bigint, ids array<int>" + (", begins array<int>, ends array<int>" if spans else "") + (", decoded string" if decoded else "")
    return map_rows(docs.select("doc_id", "text"), run, schema, rows=128)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids, ...) with ``decoded``, the text of the ids; a null list gives an empty text."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        model = load_model(path)
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        return columns | {"decoded": [model.decode(x) for x in _rows_of(columns["ids"])]}

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != "decoded"]
    return map_rows(encoded.drop("decoded"), run, ", ".join([*fields, "decoded string"]))

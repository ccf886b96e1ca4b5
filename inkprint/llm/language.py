"""Language identification in two levels: the family first, then one-versus-one between the languages of the family.

Both levels are linear support vector machines over hashed byte n-grams of the letters of the text (1 to 4 bytes, words
padded with blanks). The machines are fitted in numpy on a sample of labelled rows that is bounded per language; the
prediction is a map over all rows and reads whole texts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from inkprint.llm.base import BATCH_BYTES, map_rows, text_bytes
from inkprint.storage import materialize

#: Families of languages by ISO 639-1 code. A label that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "be"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "gu", "pa", "ne"),
}
UNDETERMINED = "und"
BITS = 14
#: Different labelled texts per language that the machines are fitted on.
SAMPLE_ROWS = 400
#: Bytes of text whose n-grams are counted at a time; labels whose counts a task holds.
BLOCK, HELD_LANGS = 1 << 20, 256

# Letters keep their lower-case byte, bytes of longer characters stay, everything else separates words.
_FOLD = np.full(256, 32, np.uint32)
_FOLD[128:] = np.arange(128, 256)
for _c in range(97, 123):
    _FOLD[_c] = _FOLD[_c - 32] = _c


def family_of(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes), f"only:{lang}")


def grams(data: np.ndarray) -> np.ndarray:
    """Hashes of the byte n-grams (n = 1 to 4) of a text block, those of blanks alone left out."""
    code = _FOLD[data]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    code = np.concatenate([[np.uint32(32)], code[keep], [np.uint32(32)]]).astype(np.uint32)
    found, gram = [code[code != 32]], code
    for n in (2, 3, 4):
        gram = (gram[:-1] << np.uint32(8)) | code[n - 1:]
        found.append(gram)
    return np.concatenate([
        (g * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - BITS) for n, g in enumerate(found)
    ])


def features(text: bytes) -> np.ndarray:
    """Square roots of the n-gram counts of a whole text, scaled to length 1."""
    counts = np.zeros(1 << BITS)
    data = np.frombuffer(text, np.uint8)
    for start in range(0, len(data), BLOCK):
        counts += np.bincount(grams(data[start:start + BLOCK]), minlength=1 << BITS)
    vector = np.sqrt(counts)
    norm = np.sqrt(counts.sum())
    return (vector / norm if norm else vector).astype(np.float32)


#: The non-zero features of a text: where they are, and their values.
Sparse = tuple[np.ndarray, np.ndarray]


def sparse(vector: np.ndarray) -> Sparse:
    at = np.flatnonzero(vector).astype(np.uint16)
    return at, vector[at]


def fit_svm(rows: list[Sparse], y: np.ndarray, epochs: int = 30, cost: float = 10.0, seed: int = 0) -> np.ndarray:
    """A linear machine with bias for labels +1 and -1, by dual coordinate descent on the hinge loss over the non-zero features."""
    weight, alpha = np.zeros((1 << BITS) + 1, np.float32), np.zeros(len(rows))
    square = [float(v @ v) + 1 for _, v in rows]
    share = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (-1, 1)}
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            margin = float(value @ weight[at]) + float(weight[-1])
            step = np.clip(alpha[i] - (y[i] * margin - 1) / square[i], 0, cost * share[int(y[i])]) - alpha[i]
            if step:
                alpha[i] += step
                weight[at] += np.float32(step * y[i]) * value
                weight[-1] += np.float32(step * y[i])
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weight


@dataclass
class LanguageModel:
    """Names and machines: rows of ``weights`` are [first against second] for families, then for languages in a family."""

    langs: list[str]
    family_pairs: list[tuple[str, str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[str]) -> LanguageModel:
        return cls.fit_features([sparse(features(t)) for t in texts], labels)

    @classmethod
    def fit_features(cls, x: list[Sparse], labels: list[str]) -> LanguageModel:
        """Machines from one sparse row per text; no row is copied, whatever the number of pairs."""
        langs = sorted(set(labels))
        lang = np.array(labels, object)
        family = np.array([family_of(v) for v in labels], object)
        family_pairs = list(itertools.combinations(sorted(set(family)), 2))
        pairs = [p for p in itertools.combinations(langs, 2) if family_of(p[0]) == family_of(p[1])]
        weights = [_machine(x, family, p) for p in family_pairs] + [_machine(x, lang, p) for p in pairs]
        return cls(langs, family_pairs, pairs, np.array(weights, np.float32).reshape(-1, (1 << BITS) + 1))

    def predict(self, text: bytes | None) -> tuple[str, float]:
        """Language and score. The score is the product of both levels' shares of votes, each vote a squashed margin."""
        if not self.langs or text is None or not has_letter(text):
            return UNDETERMINED, 0.0
        margins = self.weights[:, :-1] @ features(text) + self.weights[:, -1]
        n = len(self.family_pairs)
        family, p = _vote(sorted({family_of(v) for v in self.langs}), self.family_pairs, margins[:n])
        inside = [v for v in self.langs if family_of(v) == family]
        of = [i for i, pair in enumerate(self.pairs) if family_of(pair[0]) == family]
        best, q = _vote(inside, [self.pairs[i] for i in of], margins[n:][of])
        return best, float(p * q)


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text[:64].decode(errors="ignore"))) or any(map(str.isalpha, text.decode()))


def _machine(x: list[Sparse], labels: np.ndarray, pair: tuple[str, str]) -> np.ndarray:
    rows = np.flatnonzero(np.isin(labels, pair))
    return fit_svm([x[i] for i in rows], np.where(labels[rows] == pair[0], 1.0, -1.0))


def _vote(names: list[str], pairs: list[tuple[str, str]], margins: np.ndarray) -> tuple[str, float]:
    """The name with the most votes; a vote is split by the squashed margin, ties go to the first name."""
    if len(names) == 1:
        return names[0], 1.0
    votes = dict.fromkeys(names, 0.0)
    for (a, b), margin in zip(pairs, margins):
        share = 1 / (1 + np.exp(-3 * float(margin)))
        votes[a] += share
        votes[b] += 1 - share
    best = max(names, key=lambda n: votes[n])
    return best, votes[best] / (len(names) - 1)


def held_out(fold: int = 2, folds: int = 4) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def fit_language_model(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 0) -> LanguageModel:
    """Fit on ``rows`` different training texts per language, or all if there are fewer: those with the smallest seeded hashes.

    Texts are read whole. Rows that are held out or lack text, label or letters are not used. Equal texts count once, also when
    the hash under which four times ``rows`` are expected is set; it is raised until every language has its texts. Features are
    made in the tasks, and the driver holds the non-zero ones of each sampled text.
    """
    train = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = train.select("lang", F.xxhash64(F.lit(seed), "text").alias("_h"), "text")
    distinct = materialize(hashed.select("lang", "_h").distinct(), "hashes")
    counts = {r["lang"]: r["n"] for r in distinct.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel.fit([], [])
    last, missing, share = {}, dict(counts), 4.0
    while missing:
        picked = distinct.where(_below({k: _cut(share * rows / n) for k, n in missing.items()})).collect()
        for name, n in list(missing.items()):
            found = sorted(r["_h"] for r in picked if r["lang"] == name)
            if len(found) >= min(rows, n):
                last[name] = found[min(rows, n) - 1]
                del missing[name]
        share *= 4
    sample = hashed.where(_below(last)).groupBy("lang", "_h").agg(F.first("text").alias("text"))

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        rows = [sparse(features(t)) for t in text_bytes(batch, "text")]
        packed = {"at": [at.tobytes() for at, _ in rows], "value": [value.tobytes() for _, value in rows]}
        return {"lang": batch.column(0), "_h": batch.column(1), **packed}

    found = map_rows(sample, run, "lang string, _h bigint, at binary, value binary").collect()
    found.sort(key=lambda r: (r["lang"], r["_h"]))
    x = [(np.frombuffer(r["at"], np.uint16), np.frombuffer(r["value"], np.float32)) for r in found]
    return LanguageModel.fit_features(x, [r["lang"] for r in found])


def fit_language_counts(docs: DataFrame) -> LanguageModel:
    """The same two levels from the n-grams of every whole text of ``docs`` that has text, label and letters, in one pass.

    A machine's weights are the logarithms of the ratios of smoothed n-gram shares, scaled so that the margins of its two sides' mean
    vectors are 1 and -1. Tasks add up whole counts, so the model does not depend on how the rows are split; one row per label
    and n-gram hash comes to the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    known.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "at", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch, "text")):
                counts = held.setdefault(lang, np.zeros(1 << BITS, np.int64))
                data = np.frombuffer(text, np.uint8)
                for start in range(0, len(data), BLOCK):
                    counts += np.bincount(grams(data[start:start + BLOCK]), minlength=1 << BITS)
                if len(held) > HELD_LANGS:
                    yield from out()
        yield from out()

    found = known.mapInArrow(run, "lang string, at int, n bigint").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(found.column("lang").to_pylist(), object)
    at, n = (found.column(c).to_numpy() for c in ("at", "n"))
    langs = sorted(set(names))
    counts = {}
    for name in langs:
        counts[name] = np.zeros(1 << BITS)
        counts[name][at[names == name]] = n[names == name]
    families: dict[str, np.ndarray] = {}
    for name in langs:
        families[family_of(name)] = families.get(family_of(name), 0) + counts[name]
    family_pairs = list(itertools.combinations(sorted(families), 2))
    pairs = [p for p in itertools.combinations(langs, 2) if family_of(p[0]) == family_of(p[1])]
    weights = [_ratio_machine(families[a], families[b]) for a, b in family_pairs] + [_ratio_machine(counts[a], counts[b]) for a, b in pairs]
    return LanguageModel(langs, family_pairs, pairs, np.array(weights, np.float32).reshape(-1, (1 << BITS) + 1))


def _ratio_machine(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    weight = np.log((first + 1) / (first.sum() + len(first))) - np.log((second + 1) / (second.sum() + len(second)))
    high, low = (float(weight @ np.sqrt(c / c.sum())) for c in (first, second))
    scale = 2 / (high - low) if high > low else 0.0
    return np.append(weight * scale, -(high + low) / 2 * scale)


def _cut(share: float) -> int:
    """The signed hash that so large a share of all hashes does not exceed."""
    return min(int(-(1 << 63) + ((1 << 64) - 1) * min(1.0, share)), (1 << 63) - 1)


def _below(last: dict[str, int]) -> Column:
    wanted = F.lit(False)
    for name, cut in last.items():
        wanted = wanted | ((F.col("lang") == name) & (F.col("_h") <= F.lit(cut)))
    return wanted


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, from the text alone. Null or letterless text: ``und``, score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        found = [shared.value.predict(t) for t in text_bytes(batch, "text")]
        return {
            "doc_id": batch.column(0), "held_out": batch.column(2),
            "lang_pred": [f[0] for f in found], "score": [f[1] for f in found],
        }

    schema = "doc_id bigint, held_out boolean, lang_pred string, score double"
    return map_rows(docs.select("doc_id", "text", held_out().alias("held_out")), run, schema)


def filter_language(docs: DataFrame, least: float = 0.0, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """Rows whose language is known: not ``und``, score of ``least`` or more, and among ``allowed`` if given.

    All columns stay as they are. Only ``allowed`` and the learned labels decide, never a row's own label. Where no label
    was learned and all languages are allowed, every text with a letter stays.
    """
    model = fit_language_model(docs)
    if not model.langs and allowed is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    schema = StructType([packed.schema["_row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        found = [shared.value.predict(t) for t in text_bytes(batch, "text")]
        return {"_row": batch.column(0), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    known = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)
    if allowed is not None:
        known = known & F.col("lang_pred").isin(*allowed)
    return map_rows(packed, run, schema).where(known).select("_row.*")

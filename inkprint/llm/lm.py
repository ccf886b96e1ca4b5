"""Language-model scores by a log-bilinear neural model, trained with noise-contrastive estimation.

The model predicts a symbol from the two before it: the context vectors go through one matrix each and are added up, and
a symbol's score is the product of that prediction with its own vector, plus a bias. Symbols are the most frequent words, the
end of a text, and classes of all other words by their last bytes. Inside its class a word has its smoothed count's share times a factor
from a vector of its own, the same prediction decides which way; words that are too rare for a vector, and unknown ones, have the
share alone. Both levels are normalised, so that the words known and unknown have a total of one. How many words have
vectors follows the counts of the corpus, and the classes are as many as keep a class about as long as their list.

Everything the model knows of the corpus comes from all training rows: the counts of every word, and the weights, which
each task trains on its own rows from a common start and which are then averaged. The start is made the same way, in a few
rounds over shares of the rows that are drawn by hash. Which rows a task has depends on how the table is split, so weights, and with them scores,
differ slightly between tables that are split differently; the same files give the same scores.
Scoring needs the normaliser of each context once per worker; batched matrix products give it.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm.base import map_rows, text_bytes
from inkprint.storage import materialize

#: Words that are symbols of their own, classes of the others (at least), size of the vectors.
WORDS, CLASSES, WIDTH = 960, 63, 16
#: Occurrences from which on a word of a class has a vector; noise words drawn for each word of a class.
LEAST_COUNT, INNER_NOISE = 1000, 4
#: Words whose counts are broadcast (some MB); the counts of the others are joined.
LOOKED_UP = 262_144
#: The common start is averaged so many times, each time over another share of all rows, one in so many.
START_ROUNDS, START_SHARE = 3, 24
#: Contexts trained on at a time, noise symbols drawn for them, step of the adaptive gradient.
BATCH, NOISE, STEP = 4096, 48, 0.1
#: Words held by a task before their counts are handed on; models merged at a time.
HELD, FAN_IN = 400_000, 32


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def class_of(word: bytes, classes: int = CLASSES) -> int:
    """The class of a word that is no symbol of its own, by its last three bytes without punctuation."""
    return zlib.crc32(word.strip(b".,;:!?\"'()")[-3:]) % classes


@dataclass
class Model:
    """Vectors and biases of symbols (words, end, classes, and a start that is context only), a matrix per context place, and
    the vectors of words inside their classes."""

    vectors: np.ndarray
    bias: np.ndarray
    first: np.ndarray
    second: np.ndarray
    inner: np.ndarray
    squares: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def start(cls, counts: np.ndarray, inner: int, seed: int = 0) -> Model:
        """Small random vectors; biases are log shares of the counts, the last symbol is the start."""
        rng, size = np.random.default_rng(seed), len(counts)
        share = (counts[:-1] + 1) / (counts[:-1] + 1).sum()
        bias = np.append(np.log(share), -np.inf)
        eye = np.eye(WIDTH, dtype=np.float32)
        vectors = rng.normal(0, 0.1, (size, WIDTH)).astype(np.float32)
        return cls(vectors, bias.astype(np.float32), 0.5 * eye, eye.copy(), np.zeros((inner, WIDTH), np.float32))

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.bias, self.first, self.second]

    def pack(self) -> bytes:
        return b"".join(p.astype(np.float32).tobytes() for p in [*self.parts, self.inner])

    @classmethod
    def unpack(cls, data: bytes, size: int) -> Model:
        flat = np.frombuffer(data, np.float32).copy()
        ends = np.cumsum([size * WIDTH, size, WIDTH * WIDTH, WIDTH * WIDTH])
        v, b, f, s, inner = np.split(flat, ends)
        return cls(v.reshape(size, WIDTH), b, f.reshape(WIDTH, WIDTH), s.reshape(WIDTH, WIDTH), inner.reshape(-1, WIDTH))

    def train(
        self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray, places: np.ndarray, lookup: Lookup, noise: np.ndarray, rng: np.random.Generator,
    ) -> None:
        """One pass over contexts (w1, w2), their symbols w and the places of their words. ``noise`` holds the shares the noise is
        drawn with.

        Each batch is set against symbols drawn from the noise: the model learns to tell which came from the corpus. Words of
        classes are set against words drawn from the same class in the same way.
        """
        size = len(self.bias)
        if not self.squares:
            self.squares = [np.full(p.shape, 1e-3, np.float32) for p in self.parts] + [np.ones(self.inner.shape, np.float32)]
        cumulative, log_noise = np.cumsum(noise), np.log(np.append(noise, 1.0) * NOISE).astype(np.float32)
        for at in range(0, len(w), BATCH):
            a, b, target = w1[at:at + BATCH], w2[at:at + BATCH], w[at:at + BATCH]
            drawn = np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]), size - 2)
            va, vb, vt, vd = self.vectors[a], self.vectors[b], self.vectors[target], self.vectors[drawn]
            guess = va @ self.first + vb @ self.second
            true = np.einsum("ij,ij->i", guess, vt) + self.bias[target] - log_noise[target]
            false = guess @ vd.T + (self.bias[drawn] - log_noise[drawn])
            if len(self.inner):
                self._train_inner(guess, target, places[at:at + BATCH], lookup, rng)
            up = _sigmoid(-true)
            down = -_sigmoid(false)
            by_guess = up[:, None] * vt + down @ vd
            scale = np.float32(1 / len(target))
            vectors = _scatter(target, up[:, None] * guess, size) + _scatter(drawn, down.T @ guess, size)
            vectors += _scatter(a, by_guess @ self.first.T, size) + _scatter(b, by_guess @ self.second.T, size)
            bias = np.bincount(target, up, size) + np.bincount(drawn, down.sum(0), size)
            steps = [vectors, bias, va.T @ by_guess, vb.T @ by_guess]
            for part, square, step in zip(self.parts, self.squares, steps):
                step = step.astype(np.float32) * scale
                square += step * step
                part += np.float32(STEP) * step / np.sqrt(square)

    def _train_inner(self, guess: np.ndarray, target: np.ndarray, places: np.ndarray, lookup: Lookup, rng: np.random.Generator) -> None:
        """The classes' part of a batch: each word against INNER_NOISE words drawn from its class by smoothed counts."""
        in_class = target > WORDS
        g, classes, own = guess[in_class], target[in_class] - WORDS - 1, places[in_class] - WORDS
        drawn = rng.random((len(g), INNER_NOISE)) * lookup.class_mass[classes][:, None]
        inside = drawn < lookup.inner_mass[classes][:, None]
        at = np.searchsorted(lookup.inner_steps, (lookup.inner_low[classes][:, None] + drawn)[inside], side="right")
        has = (own >= 0) & (own < len(self.inner))
        rows = np.concatenate([own[has], lookup.inner_order[np.minimum(at, len(lookup.inner_order) - 1)]])
        toward = np.concatenate([g[has], g[np.nonzero(inside)[0]]])
        real = np.arange(len(rows)) < has.sum()
        push = real - _sigmoid(np.einsum("ij,ij->i", self.inner[rows], toward) - np.float32(np.log(INNER_NOISE)))
        order = np.argsort(rows, kind="stable")
        edges = np.flatnonzero(np.diff(rows[order], prepend=-1))
        moved = rows[order[edges]]
        step = np.add.reduceat((push.astype(np.float32)[:, None] * toward)[order], edges) if len(edges) else toward
        self.squares[-1][moved] += step * step
        self.inner[moved] += np.float32(STEP) * step / np.sqrt(self.squares[-1][moved])

    def inner_logs(self, w1: np.ndarray, w2: np.ndarray, classes: np.ndarray, places: np.ndarray, lookup: Lookup) -> np.ndarray:
        """What a word's vector adds to the logarithm of its share of its class, for contexts and words of classes.

        The class is normalised over all its words; those without a vector keep their share, so only the others are gone through,
        class by class in matrix products.
        """
        out = np.zeros(len(classes), np.float64)
        if not len(self.inner):
            return out
        guess = self.vectors[w1] @ self.first + self.vectors[w2] @ self.second
        own = places - WORDS
        has = (own >= 0) & (own < len(self.inner))
        out[has] = np.einsum("ij,ij->i", guess[has], self.inner[own[has]])
        order = np.argsort(classes, kind="stable")
        edges = np.flatnonzero(np.diff(classes[order], prepend=-1))
        for start, stop in zip(edges, [*edges[1:], len(order)]):
            c = classes[order[start]]
            members = lookup.inner_order[lookup.inner_first[c]:lookup.inner_first[c + 1]]
            if len(members):
                share = (lookup.inner_counts[members] / lookup.class_mass[c]).astype(np.float32)
                others = 1 - share.sum(dtype=np.float64)
                for at in range(start, stop, BATCH):
                    some = order[at:min(at + BATCH, stop)]
                    out[some] -= np.log(others + np.exp(guess[some] @ self.inner[members].T) @ share)
        return out

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each symbol after each symbol in either context place."""
        return self.vectors @ self.first @ self.vectors.T, self.vectors @ self.second @ self.vectors.T

    def log_normalisers(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        """The logarithm of the sum over all symbols, for each context, by batched matrix products."""
        out = np.empty(len(w1), np.float64)
        for at in range(0, len(w1), BATCH):
            a, b = w1[at:at + BATCH], w2[at:at + BATCH]
            guess = self.vectors[a] @ self.first + self.vectors[b] @ self.second
            scores = guess @ self.vectors[:-1].T + self.bias[:-1]
            top = scores.max(1)
            out[at:at + BATCH] = top + np.log(np.exp(scores - top[:, None]).sum(1, dtype=np.float64))
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -30, 30)))


def _scatter(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the value rows that go to each symbol."""
    places = (rows[:, None] * WIDTH + np.arange(WIDTH)).ravel()
    return np.bincount(places, values.ravel(), size * WIDTH).reshape(size, WIDTH)


@dataclass
class Vocabulary:
    """Broadcast form: the words looked up, joined by blanks and in order of count; their counts; what the classes hold."""

    joined: bytes
    counts: np.ndarray
    class_tokens: np.ndarray
    class_types: np.ndarray
    texts: int
    total: int
    distinct: int
    key: str

    @property
    def classes(self) -> int:
        return len(self.class_tokens)

    @property
    def inner(self) -> int:
        """Words of classes that have vectors; they follow the words that are symbols."""
        return int((self.counts[WORDS:] >= LEAST_COUNT).sum())

    @property
    def end(self) -> int:
        return WORDS

    @property
    def size(self) -> int:
        return WORDS + 1 + self.classes + 1

    @property
    def symbol_counts(self) -> np.ndarray:
        words = np.zeros(WORDS)
        words[:min(WORDS, len(self.counts))] = self.counts[:WORDS]
        return np.concatenate([words, [self.texts], self.class_tokens, [0]]).astype(np.float64)

    def lookup(self) -> Lookup:
        if self.key not in _lookups:
            _lookups.clear()
            _lookups[self.key] = Lookup(self)
        return _lookups[self.key]


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class Lookup:
    """The vocabulary as a worker uses it."""

    def __init__(self, vocabulary: Vocabulary):
        words = vocabulary.joined.split()
        self.place = _Places(zip(words, range(len(words))))
        self.classes = vocabulary.classes
        self.symbol = np.array([i if i < WORDS else WORDS + 1 + class_of(w, self.classes) for i, w in enumerate(words)], np.int32)
        self._inside(vocabulary)
        self.log_count = np.log10(vocabulary.counts + 1.0)
        self.end, self.begin = WORDS, vocabulary.size - 1
        self.normaliser = np.full((vocabulary.size, vocabulary.size), np.nan, np.float32)
        self.scores = None

    def _inside(self, vocabulary: Vocabulary) -> None:
        """The words with vectors inside classes, ordered by class, and their smoothed counts as steps to draw from."""
        n = vocabulary.inner
        of = self.symbol[WORDS:WORDS + n] - WORDS - 1
        self.inner_counts = vocabulary.counts[WORDS:WORDS + n] + 1.0
        self.inner_order = np.argsort(of, kind="stable")
        self.inner_steps = np.cumsum(self.inner_counts[self.inner_order])
        self.inner_first = np.searchsorted(of[self.inner_order], np.arange(self.classes + 1))
        edges = np.concatenate([[0.0], self.inner_steps])[self.inner_first]
        self.inner_low, self.inner_mass = edges[:-1], np.diff(edges)
        self.class_mass = vocabulary.class_tokens + vocabulary.class_types + 1.0

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words in the lookup (-1 if not there), and their symbols."""
        places = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        symbols = self.symbol[places] if len(self.symbol) else np.zeros(len(words), np.int32)
        for i in np.flatnonzero(places < 0).tolist():
            symbols[i] = WORDS + 1 + class_of(words[i], self.classes)
        return places, symbols

    def contexts(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols of texts with their ends, and the two symbols before each."""
        ends, starts = np.array([self.end], np.int32), np.array([self.begin, self.begin], np.int32)
        padded = np.concatenate([p for t in texts for p in (starts, t, ends)])
        inside = np.concatenate([np.r_[False, False, np.ones(len(t) + 1, bool)] for t in texts])
        at = np.flatnonzero(inside)
        return padded[at - 2], padded[at - 1], padded[at]

    @staticmethod
    def targets(places: list[np.ndarray]) -> np.ndarray:
        """The places of the words of texts, -1 for their ends, in the order of ``contexts``."""
        end = np.array([-1])
        return np.concatenate([p for text in places for p in (text, end)])


_lookups: dict[str, Lookup] = {}


def held_out(fold: int = 2, folds: int = 7) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all rows. Tasks count first, so a frequent word is one row of each task."""

    def run(batches):
        held: Counter = Counter()

        def out():
            words, counts = list(held), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in text_bytes(batch, "text"):
                held.update(tokens_of(text))
                if len(held) > HELD:
                    yield out()
        yield out()

    partial = docs.select("text").mapInArrow(run, "word binary, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def fit_vocabulary(counts: DataFrame, texts: int, looked_up: int = LOOKED_UP) -> Vocabulary:
    """Totals over all counted words, and the frequent ones: those above the least power of two that leaves at most ``looked_up``.

    One pass counts the words above every power, so no more than ``looked_up`` rows ever come to the driver.
    """
    cuts = [0, *(1 << j for j in range(50))]
    above = [F.count_if(F.col("n") > cut) for cut in cuts]
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.array(*above)).first()
    cut = next(c for c, n in zip(cuts, total[2]) if n <= looked_up)
    frequent = counts.where(F.col("n") > cut).toArrow()
    top = sorted(zip(frequent.column("n").to_pylist(), map(bytes, frequent.column("word").to_pylist())), key=lambda x: (-x[0], x[1]))
    words = [w for _, w in top]
    symbols = set(words[:WORDS])
    classes = max(CLASSES, math.isqrt(sum(n >= LEAST_COUNT for n, _ in top[WORDS:])))

    def by_class(batches):
        for batch in batches:
            tokens, types = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word not in symbols:
                    tokens[class_of(word, classes)] += n
                    types[class_of(word, classes)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(range(classes), pa.int32()), pa.array(tokens), pa.array(types)], names=["class", "tokens", "types"])

    sums = counts.mapInArrow(by_class, "class int, tokens bigint, types bigint").groupBy("class").agg(
        F.sum("tokens").alias("tokens"), F.sum("types").alias("types"))
    tokens, types = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for row in sums.collect():
        tokens[row["class"]], types[row["class"]] = row["tokens"], row["types"]
    return Vocabulary(
        b" ".join(words), np.array([n for n, _ in top], np.int64), tokens, types, texts,
        int(total[0]) + texts, int(total[1]) + (1 if texts else 0), uuid.uuid4().hex,
    )


def fit_model(train: DataFrame, vocabulary: Vocabulary, shared, seed: int = 0) -> Model:
    """Train on every row: each task from the common start over its rows, then the mean of the models by symbols seen.

    The start is the mean of such models over whole texts of START_ROUNDS shares of the rows, one after the other, so that all
    tasks have a basis in common. What it learns from grows with the table.
    """
    model = Model.start(vocabulary.symbol_counts, 0, seed)
    share = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(START_SHARE))
    for i in range(START_ROUNDS):
        model = _averaged(train.where(share == i), model, vocabulary, shared, seed + i)
    # Only the pass over all rows trains the vectors inside classes, so their size is written once a task.
    model.inner = np.zeros((vocabulary.inner, WIDTH), np.float32)
    return _averaged(train, model, vocabulary, shared, seed)


def _averaged(train: DataFrame, start: Model, vocabulary: Vocabulary, shared, seed: int) -> Model:
    """The mean of the models that the tasks train from ``start`` on their rows, each once; ``start`` without rows."""
    packed, size = start.pack(), vocabulary.size
    noise = _noise(vocabulary)

    def run(batches):
        model, lookup, seen = Model.unpack(packed, size), shared.value.lookup(), 0
        rng = np.random.default_rng(seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                places, texts = zip(*[lookup.symbols(tokens_of(t)) for t in text_bytes(batch.slice(at, 256), "text")])
                w1, w2, w = lookup.contexts(texts)
                order = rng.permutation(len(w))
                model.train(w1[order], w2[order], w[order], lookup.targets(places)[order], lookup, noise, rng)
                seen += len(w)
        if seen:
            yield _model_row(model.pack(), seen)

    models = materialize(train.select("text").mapInArrow(run, "model binary, seen bigint"), "models")
    while (n := models.count()) > 1:
        models = materialize(models.repartition(-(-n // FAN_IN)).mapInArrow(_average, "model binary, seen bigint"), "models")
    mean = models.first()
    return Model.unpack(mean["model"], size) if mean else start


def _noise(vocabulary: Vocabulary) -> np.ndarray:
    share = (vocabulary.symbol_counts[:-1] + 1) ** 0.75
    return share / share.sum()


def _model_row(model: bytes, seen: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bytes(model)], pa.binary()), pa.array([seen], pa.int64())], names=["model", "seen"])


def _average(batches):
    """The mean of a task's models by symbols seen, one model in memory besides the sum."""
    total, sums = 0, None
    with np.errstate(invalid="ignore"):
        for batch in batches:
            for model, n in zip(batch.column(0), batch.column(1).to_pylist()):
                part = np.frombuffer(model.as_buffer(), np.float32) * np.float64(n)
                sums = part if sums is None else np.add(sums, part, out=sums)
                total += n
        if total:
            yield _model_row((sums / total).astype(np.float32).tobytes(), total)


def _score_slice(batch: pa.RecordBatch, vocabulary: Vocabulary, model: Model) -> dict[str, list]:
    """Scores of whole texts as far as the lookup goes, and for the words beyond it their counts within each text."""
    lookup = vocabulary.lookup()
    if lookup.scores is None:
        lookup.scores = model.tables()
    words = [tokens_of(t) for t in text_bytes(batch, "text")]
    found = [lookup.symbols(w) for w in words]
    w1, w2, w = lookup.contexts([s for _, s in found])
    new = np.unique((w1.astype(np.int64) * vocabulary.size + w2)[np.isnan(lookup.normaliser[w1, w2])])
    if len(new):
        a, b = np.divmod(new, vocabulary.size)
        lookup.normaliser[a, b] = model.log_normalisers(a, b)
    first, second = lookup.scores
    logs = (first[w1, w] + second[w2, w] + model.bias[w] - lookup.normaliser[w1, w2]).astype(np.float64) / np.log(10)
    # What a word of a class has of the class's probability: its smoothed count over those of the class and one unseen word.
    in_class = w > WORDS
    classes = w[in_class] - WORDS - 1
    places = lookup.targets([p for p, _ in found])[in_class] if found else np.zeros(0, np.int64)
    logs[in_class] += model.inner_logs(w1[in_class], w2[in_class], classes, places, lookup) / np.log(10) - np.log10(lookup.class_mass[classes])
    stops = np.cumsum([len(x) + 1 for x in words])
    sums = np.add.reduceat(logs, np.r_[0, stops[:-1]]) if len(words) else logs
    base, known, rest = [], [], []
    for (places, symbols), text, model_sum in zip(found, words, sums.tolist()):
        seen = places >= 0
        counted = lookup.log_count[places[seen]] if len(lookup.log_count) else np.zeros(0)
        base.append(float(counted.sum()))
        known.append(int(seen.sum()))
        rest.append((model_sum + float(counted[places[seen] >= WORDS].sum()), Counter(text[i] for i in np.flatnonzero(~seen).tolist())))
    return {
        "doc_id": batch.column(0), "held_out": batch.column(2), "n_tokens": [len(x) + 1 for x in words], "n_known": known,
        "counted": base, "score": [r[0] for r in rest],
        "rare": [[{"word": k, "n": n} for k, n in r[1].items()] for r in rest],
    }


SCORED = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, counted double, score double, "
    "rare array<struct<word: binary, n: bigint>>"
)


def score_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; whole texts, null and empty count alike.

    Learns from the rows that are not held out. Words that are beyond the broadcast lookup are joined with the counts of
    all words, one row per text and word. Repeated rows are scored each; other columns are ignored.
    """
    marked = docs.select("doc_id", "text", held_out().alias("held_out"))
    train = marked.where("not held_out")
    counts = materialize(word_counts(train), "words")
    vocabulary = fit_vocabulary(counts, train.count())
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(vocabulary)
    model = fit_model(train, vocabulary, shared, seed)
    shared_model = context.broadcast(model)
    scored = map_rows(marked, lambda batch: _score_slice(batch, shared.value, shared_model.value), SCORED, rows=256)
    scored = materialize(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")

    rare = scored.select("_row", F.inline("rare")).withColumnRenamed("n", "times")
    log_count = F.log10(F.coalesce("n", F.lit(0)).cast("double") + 1)
    sums = rare.join(counts, "word", "left").groupBy("_row").agg(
        F.sum(F.col("times") * log_count).alias("_logs"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("_known"),
    )
    total, distinct, texts = vocabulary.total, vocabulary.distinct, vocabulary.texts
    logs = F.coalesce("_logs", F.lit(0.0))
    width = F.log10(F.lit(float(total + distinct + 1)))
    end = F.log10(F.lit(float(texts + 1)))
    return scored.drop("rare").join(sums, "_row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0)) + F.lit(1 if texts else 0)).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("counted") + logs + end - F.col("n_tokens") * width).alias("base_score"), (F.col("score") + logs).alias("score"),
    )

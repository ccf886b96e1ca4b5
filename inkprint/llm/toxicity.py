"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling.

A word's embedding is the sum of the rows that its hash and the hashes of its first four, five and six bytes pick, so the forms of a
stem are alike, and two words are the same only if all collide. Filters read one, two or three neighbouring words, each
keeps its highest value over the whole text, and a logistic layer weighs these. The net is trained in numpy on seven tenths of all
different labelled texts, from a common start in shards whose nets are averaged; the other texts set a threshold for every language,
where the language is guessed from the text, and scores are shifted so that the threshold of a text's language lies at 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm import language
from inkprint.llm.base import BATCH_BYTES, map_rows, text_bytes
from inkprint.storage import materialize

#: Rows of the embedding table; one more stands for no word and stays zero. Leading bytes that pick a row besides the whole word.
BITS, STEMS = 18, (4, 5, 6)
NONE, PICKS = 1 << BITS, 1 + len(STEMS)
DIMENSIONS, WIDTHS, FILTERS = 8, (1, 2, 3), 12
#: Share of the different labelled texts that sets thresholds; all others are trained on.
CALIBRATION = 0.3
#: Texts per label, about, that the common start is trained on, and all texts that a shard is trained on, about. Slices of the hash range.
START_TEXTS, SHARD_TEXTS, SLICES = 2000, 8192, 1 << 20
#: Passes of a shard over its texts, its share of the start's steps, words that it holds at a time, nets that are averaged at a time.
SHARD_EPOCHS, SHARD_RATE, HELD_WORDS, FAN_IN = 2, 0.3, 1 << 22, 16
#: The rarer label's texts count more in training, by this power of the ratio of the labels; in thresholds all texts count alike.
LIFT = 2 / 3
#: Thresholds lie between logits that are counted in so many steps of 1.
LOGIT_STEPS = 256
#: Texts held together that must pick a row before it moves; rarer ones would be learned by heart.
LEAST_TEXTS = 8
#: Calibration texts of either label that a threshold needs.
LEAST_ROWS = 20
#: Passes over the training texts: as many as make so many steps, within limits.
STEPS, EPOCHS = 1500, (12, 60)
#: Share of the words that a step does not see, another each time, so that a text is not told by any one word of it.
BLANKED = 0.5
#: Step of the embeddings; words that go through the filters at a time; bytes of text that are hashed at a time.
EMBEDDING_RATE, BLOCK, HASHED = 1.0, 1 << 15, 1 << 18

#: A-Z to lower case; controls and ASCII punctuation to blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


#: Bytes of a word that are hashed in blocks of eight; longer words, which are rare, are hashed one by one.
_BLOCKWISE = 64
#: Masks that keep the first bytes of a block.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def fold(text: bytes | None) -> bytes:
    """A whole text with A-Z in lower case; its words are the runs of letters, digits and bytes from 128 on, all else is blank."""
    return (text or b"").translate(_FOLD)


def picked_rows(folded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and the rows that each picks: by the hash of all its bytes, and by those of its first few."""
    data = np.frombuffer(b" " + folded + b" " * 8, np.uint8)
    inside = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    lead = eight[starts]
    whole = _mixed(lead & _FIRST[np.minimum(lengths, 8)])
    for at in range(8, _BLOCKWISE, 8):
        more = np.flatnonzero(lengths > at)
        if not len(more):
            break
        whole[more] = _mixed(whole[more] * np.uint64(3) + (eight[starts[more] + at] & _FIRST[np.minimum(lengths[more] - at, 8)]))
    for i in np.flatnonzero(lengths > _BLOCKWISE).tolist():
        whole[i] = xxhash.xxh64_intdigest(data[starts[i]:starts[i] + lengths[i]])
    stems = [_mixed((lead & _FIRST[np.minimum(lengths, n)]) + np.uint64(n << 56)) for n in STEMS]
    return starts - 1, (np.stack([whole, *stems], 1) >> np.uint64(64 - BITS)).astype(np.uint32)


def _pieces(folded: bytes) -> Iterator[bytes]:
    """Parts of a folded text of about HASHED bytes, each of whole words."""
    start = 0
    while len(folded) - start > HASHED:
        cut = folded.find(b" ", start + HASHED)
        if cut < 0:
            break
        yield folded[start:cut]
        start = cut
    yield folded[start:]


def text_rows(text: bytes | None) -> np.ndarray:
    return np.concatenate([picked_rows(piece)[1] for piece in _pieces(fold(text))])


def _parts(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    """Consecutive folded texts of about HASHED bytes together; a longer text is alone."""
    held, size = [], 0
    for text in map(fold, texts):
        if held and size + len(text) > HASHED:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield held


@dataclass
class ConvNet:
    """Weights: ``rows`` is the embedding table, ``kernels[w]`` is (width, dimensions, filters)."""

    rows: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def start(cls, seed: int = 0) -> ConvNet:
        rng = np.random.default_rng(seed)
        rows = rng.normal(0, 0.05, (NONE + 1, DIMENSIONS)).astype(np.float32)
        rows[NONE] = 0
        kernels = [rng.normal(0, 1 / np.sqrt(w * DIMENSIONS), (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(rows, kernels, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)

    # -- forward -------------------------------------------------------------------------------------------------

    def vectors(self, picks: np.ndarray) -> np.ndarray:
        """One vector per word: the sum of the rows that it picks."""
        x = self.rows[picks[:, 0]]
        for i in range(1, PICKS):
            x += self.rows[picks[:, i]]
        return x

    def embed(self, text: bytes | None) -> np.ndarray:
        return np.concatenate([self.vectors(picked_rows(piece)[1]) for piece in _pieces(fold(text))])

    def responses(self, x: np.ndarray) -> np.ndarray:
        """The values of all filters (filters, places) at every place but the last ones, where the widest window is not whole."""
        n, widest = len(x) - max(WIDTHS) + 1, max(WIDTHS) * DIMENSIONS
        windows = np.concatenate([x[j:n + j] for j in range(max(WIDTHS))], 1)
        kernel = np.zeros((len(WIDTHS) * FILTERS, widest), np.float32)
        for k, w in enumerate(WIDTHS):
            kernel[k * FILTERS:(k + 1) * FILTERS, :w * DIMENSIONS] = self.kernels[k].reshape(w * DIMENSIONS, FILTERS).T
        return kernel @ windows.T + np.concatenate(self.biases)[:, None]

    def pooled(self, vectors: np.ndarray) -> np.ndarray:
        """The highest value of every filter over a whole text, 0 at least. Words go through in overlapping blocks."""
        best, pad, n = np.zeros(len(WIDTHS) * FILTERS, np.float32), max(WIDTHS) - 1, max(1, len(vectors))
        padded = np.concatenate([vectors, np.zeros((n - len(vectors) + pad, DIMENSIONS), np.float32)])
        for start in range(0, n, BLOCK):
            best = np.maximum(best, self.responses(padded[start:start + BLOCK + pad]).max(1))
        return best

    def logit(self, vectors: np.ndarray) -> float:
        return float(self.weighed(self.pooled(vectors)[:, None])[0])

    def weighed(self, pooled: np.ndarray) -> np.ndarray:
        """Logits of columns of filter values, added up in one order, so that a text's does not depend on its neighbours."""
        total = np.full(pooled.shape[1], self.bias, np.float64)
        for weight, values in zip(self.out, pooled):
            total += np.float64(weight) * values
        return total

    def logits(self, texts: list[bytes | None]) -> np.ndarray:
        """The logits of whole texts; short ones go through the filters together, with blank places between."""
        found, pad = [], max(WIDTHS) - 1
        for part in _parts(texts):
            if len(part) == 1:
                found.append([self.logit(np.concatenate([self.vectors(picked_rows(piece)[1]) for piece in _pieces(part[0])]))])
                continue
            starts, picks = picked_rows(b" ".join(part))
            first = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in part]]))
            n = np.diff(first)
            at = np.cumsum([0, *(np.maximum(n, 1) + pad)])
            x = np.zeros((at[-1] + pad, DIMENSIONS), np.float32)
            x[np.arange(len(picks)) + np.repeat(at[:-1] - first[:-1], n)] = self.vectors(picks)
            spans = np.stack([at[:-1], at[1:] - pad], 1).ravel()
            best = np.maximum.reduceat(self.responses(x), spans, axis=1)[:, ::2]
            found.append(self.weighed(np.maximum(best, 0)))
        return np.concatenate(found) if found else np.zeros(0)

    def shifted(self, logit: float, lang: str) -> float:
        """A score between 0 and 1; 0.5 at the threshold of ``lang``, or at the common one for a language without its own."""
        return _sigmoid(logit - self.thresholds.get(lang, self.thresholds.get("", 0.0)))

    # -- training ------------------------------------------------------------------------------------------------

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, batch: int = 32, seed: int = 0,
            epochs: int | None = None, pace: float = 1.0) -> ConvNet:
        """Gradient steps on the weighted log loss. Filters and output move by Adam; embeddings by their plain gradients, so
        that a word moves as far as many texts agree on it, and a word of a few texts hardly moves. Without ``epochs`` the net is
        new: the output starts at the share of label 1, and there are STEPS steps, within EPOCHS. ``pace`` scales all steps."""
        rng, adam, weights = np.random.default_rng(seed), _Adam(), weights / weights.mean()
        moves = (row_texts(texts) >= LEAST_TEXTS).astype(np.float32)
        moves[NONE] = 0
        if epochs is None:
            rate = float(np.clip((labels * weights).sum() / weights.sum(), 1e-3, 1 - 1e-3))
            self.bias = float(np.log(rate / (1 - rate)))
            epochs = int(np.clip(STEPS * batch / max(1, len(texts)), *EPOCHS))
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                some = order[at:at + batch]
                kept = [np.where(rng.random((len(texts[i]), 1)) < BLANKED, NONE, texts[i]) for i in some]
                self._step(kept, moves, labels[some], weights[some], adam, pace * (1 - epoch / epochs))
        return self

    def copy(self) -> ConvNet:
        return ConvNet(self.rows.copy(), [k.copy() for k in self.kernels], [b.copy() for b in self.biases], self.out.copy(), self.bias)

    def upper(self) -> np.ndarray:
        """All weights but the rows, as one vector."""
        return np.concatenate([*[k.ravel() for k in self.kernels], *self.biases, self.out, [self.bias]]).astype(np.float64)

    @classmethod
    def joined(cls, rows: np.ndarray, upper: np.ndarray) -> ConvNet:
        sizes = [*[w * DIMENSIONS * FILTERS for w in WIDTHS], *[FILTERS] * len(WIDTHS), len(WIDTHS) * FILTERS]
        *parts, bias = np.split(upper.astype(np.float32), np.cumsum(sizes))
        n = len(WIDTHS)
        kernels = [p.reshape(w, DIMENSIONS, FILTERS) for w, p in zip(WIDTHS, parts)]
        return cls(rows, kernels, parts[n:2 * n], parts[2 * n], float(bias[0]))

    def _step(self, texts: list[np.ndarray], moves: np.ndarray, labels: np.ndarray, weights: np.ndarray, adam: _Adam, decay: float) -> None:
        pad = max(WIDTHS) - 1
        starts = np.cumsum([0, *[max(1, len(t)) + pad for t in texts]])
        rows = np.full((starts[-1] + pad, PICKS), NONE, np.int64)
        for s, t in zip(starts, texts):
            rows[s:s + len(t)] = t
        x = self.vectors(rows)
        z = self.responses(x)
        found = np.array([s + z[:, s:e - pad].argmax(1) for s, e in zip(starts, starts[1:])])
        features = np.maximum(z[np.arange(len(z)), found], 0)
        places = np.split(found, len(WIDTHS), 1)
        p = 1 / (1 + np.exp(-np.clip(features @ self.out + self.bias, -30, 30)))
        wrong = ((p - labels) * weights / len(labels)).astype(np.float32)
        back = wrong[:, None] * self.out * (features > 0)
        adam.tick(0.01 * decay)
        self.out -= adam.move("out", features.T @ wrong + 1e-4 * self.out)
        self.bias -= float(adam.move("bias", np.array([wrong.sum()]))[0])
        for k, w in enumerate(WIDTHS):
            toward, kernel = back[:, k * FILTERS:(k + 1) * FILTERS], self.kernels[k].copy()
            gradient = np.stack([np.einsum("bf,bfd->df", toward, x[places[k] + j]) for j in range(w)])
            self.kernels[k] -= adam.move(f"kernel{k}", gradient + 1e-4 * kernel)
            self.biases[k] -= adam.move(f"bias{k}", toward.sum(0))
            for j in range(w):
                pull, at = EMBEDDING_RATE * decay * toward[:, :, None] * kernel[j].T, rows[places[k] + j]
                np.subtract.at(self.rows, at, moves[at][..., None] * pull[:, :, None, :])


def row_texts(texts: list[np.ndarray]) -> np.ndarray:
    """How many of the texts pick each row."""
    often = np.zeros(NONE + 1, np.int64)
    for t in texts:
        picks = np.sort(t, axis=None)
        often[picks[:1]] += 1
        often[picks[1:][picks[1:] != picks[:-1]]] += 1
    return often


class _Adam:
    def __init__(self):
        self.state, self.steps, self.rate = {}, 0, 0.0

    def tick(self, rate: float) -> None:
        self.steps, self.rate = self.steps + 1, rate

    def move(self, name: str, gradient: np.ndarray) -> np.ndarray:
        m, v = self.state.get(name, (np.zeros_like(gradient), np.zeros_like(gradient)))
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        self.state[name] = m, v
        return self.rate * (m / (1 - 0.9 ** self.steps)) / (np.sqrt(v / (1 - 0.999 ** self.steps)) + 1e-8)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -700, 700))))


def best_threshold(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The middle of the widest gap between neighbouring logits among the cuts with nearly the highest F1 of label 1."""
    order = np.argsort(-logits, kind="stable")
    logits, hits, mass = logits[order], (labels * weights)[order], weights[order]
    f1 = 2 * np.cumsum(hits) / (np.cumsum(mass) + hits.sum())
    gaps = -np.diff(logits, append=logits[-1] - 1)
    f1 = np.where(gaps > 0, f1, -1)
    near = np.flatnonzero(f1 >= f1.max() - 0.002)
    i = near[np.argmax(gaps[near])]
    return float(logits[i] - gaps[i] / 2)


# -- over the corpus --------------------------------------------------------------------------------------------------


@dataclass
class ToxicityModel:
    net: ConvNet
    languages: language.LanguageModel

    def predict(self, text: bytes | None) -> float:
        """The score of a whole text."""
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[bytes | None]) -> list[float]:
        return [self.net.shifted(z, self.languages.predict(t)[0]) for z, t in zip(self.net.logits(texts).tolist(), texts)]


def held_out(fold: int = 0, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """(toxic, hash, text): all different labelled texts that are not held out; a text counts once per label, however often it occurs.

    Hashes are joined to labels. Each task passes on one copy of a text, so copies do not meet in one task.
    """
    text = F.coalesce("text", F.lit(""))
    hashed = docs.where(~held_out()).select("doc_id", F.xxhash64(F.lit(seed), text).alias("hash"), text.alias("text"))
    known = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    found = materialize(hashed.select("doc_id", "hash").join(known, "doc_id").select("toxic", "hash").distinct(), "labelled")
    return hashed.groupBy("hash").agg(F.first("text").alias("text")).join(found, "hash").select("toxic", "hash", "text")


def _slice(seed: int, purpose: int) -> Column:
    """Another hash of the hash, from 0 to SLICES - 1."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), "hash"), F.lit(SLICES))


def train(docs: DataFrame, labels: DataFrame, seed: int = 0) -> ToxicityModel:
    """Learn ``labels`` (doc_id, toxic) from all whole texts of ``docs`` that are not held out; languages too are learned from those.

    A hash share of the labelled texts sets the thresholds, the net is trained on all others. Where only one label occurs, or
    none, every text has the same score, on that label's side (no label: 0).
    """
    languages = language.fit_language_counts(docs.where(~held_out()))
    texts = materialize(labelled_texts(docs, labels, seed).withColumn("late", _slice(seed, 1) < int(CALIBRATION * SLICES)), "texts")
    counts = {(r["late"], r["toxic"]): r["n"] for r in texts.groupBy("late", "toxic").agg(F.count("*").alias("n")).collect()}
    found = {label for _, label in counts}
    if len(found) < 2:
        net = ConvNet.start(seed)
        net.out[:], net.bias = 0, 6.0 if 1 in found else -6.0
        return ToxicityModel(net, languages)
    first, second = texts.where("not late"), texts.where("late")
    known = {label: counts.get((False, label), 0) for label in (0, 1)}
    if len(counts) < 4:
        first, second, known = texts, texts, {label: sum(n for (_, of), n in counts.items() if of == label) for label in (0, 1)}
    net = fit_net(first, known, seed)
    shards = -(-sum(n for (late, _), n in counts.items() if late or second is first) // SHARD_TEXTS)
    net.thresholds = fit_thresholds(_dealt(second, shards, seed), net, languages)
    return ToxicityModel(net, languages)


def fit_net(texts: DataFrame, counts: dict[int, int], seed: int) -> ConvNet:
    """Train on every text: a common start on a hash share of each label, then every shard from there on its texts, then the mean.

    The start is the whole job where its shares are all texts. Shards go by hash and read their texts in order of hashes, so
    the result does not depend on how the tables are split.
    """
    shares = {label: min(1.0, START_TEXTS / n) for label, n in counts.items()}
    lifts = {label: (max(counts.values()) / n) ** LIFT for label, n in counts.items()}
    toxic = F.col("toxic") == 1
    texts = texts.withColumn("weight", F.when(toxic, lifts[1]).otherwise(lifts[0]))
    share = F.when(toxic, shares[1]).otherwise(shares[0])
    begun = texts.where(_slice(seed, 2) < share * SLICES).withColumn("weight", F.col("weight") / share)
    net = _trained(begun, ConvNet.start(seed), 1, seed, None, 1.0)
    if min(shares.values()) < 1:
        shards = -(-sum(counts.values()) // SHARD_TEXTS)
        net = _trained(texts, net, shards, seed, SHARD_EPOCHS, SHARD_RATE)
    return net


def _dealt(texts: DataFrame, shards: int, seed: int) -> DataFrame:
    """``texts`` with a column shard, by hash; shards stand together, in order of hashes."""
    shard = F.pmod(F.xxhash64(F.lit(seed), F.lit(3), "hash"), F.lit(shards)).cast("int")
    return texts.withColumn("shard", shard).repartition(shards, "shard").sortWithinPartitions("shard", "hash", "toxic")


_NETS = "shard int, seen bigint, often binary, rows binary, upper binary"


def _trained(texts: DataFrame, start: ConvNet, shards: int, seed: int, epochs: int | None, pace: float) -> ConvNet:
    """The mean of the nets that shards train from ``start``. A row's weight in the mean is the number of texts that picked it."""
    spark = texts.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    shared = spark.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, net, often, seen, held, words = None, None, None, 0, [], 0

        def learn() -> None:
            nonlocal seen, held, words, often
            if held:
                rows, toxic, weights = zip(*held)
                net.fit(list(rows), np.array(toxic, np.float64), np.array(weights), seed=seed, epochs=epochs, pace=pace)
                often += row_texts(list(rows))
                seen, held, words = seen + len(rows), [], 0

        for batch in batches:
            for shard, toxic, weight, text in zip(*(batch.column(i).to_pylist() for i in range(3)), text_bytes(batch, "text")):
                if shard != now:
                    if now is not None:
                        learn()
                        yield _net_row(now, seen, often, net.rows, net.upper())
                    now, net, often, seen = shard, shared.value.copy(), np.zeros(NONE + 1, np.int64), 0
                rows = text_rows(text)
                held.append((rows, toxic, weight))
                words += len(rows)
                if words > HELD_WORDS:
                    learn()
        if now is not None:
            learn()
            yield _net_row(now, seen, often, net.rows, net.upper())

    nets = materialize(_dealt(texts, shards, seed).select("shard", "toxic", "weight", "text").mapInArrow(run, _NETS), "nets")
    while shards > 1:
        shards = -(-shards // FAN_IN)
        grouped = nets.select(F.expr(f"shard div {FAN_IN}").cast("int").alias("to"), *nets.columns).repartition(shards, "to")
        nets = materialize(grouped.sortWithinPartitions("to", "shard").mapInArrow(_means, _NETS), "nets")
    mean = nets.first()
    if mean is None:
        return start
    often = np.frombuffer(mean["often"], np.int64)
    rows = np.frombuffer(mean["rows"], np.float32).reshape(-1, DIMENSIONS)
    return ConvNet.joined(np.where(often[:, None] > 0, rows, start.rows), np.frombuffer(mean["upper"], np.float64))


def _net_row(shard: int, seen: int, often: np.ndarray, rows: np.ndarray, upper: np.ndarray) -> pa.RecordBatch:
    values = [[shard], [seen], [often.tobytes()], [rows.astype(np.float32).tobytes()], [upper.tobytes()]]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["shard", "seen", "often", "rows", "upper"])


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One net for all with the same ``to``, which stand together: one net in memory besides the sums."""
    now, seen, often, rows, upper = None, 0, None, None, None

    def mean() -> pa.RecordBatch:
        return _net_row(now, seen, often, rows / np.maximum(often, 1)[:, None], upper / max(1, seen))

    for batch in batches:
        for i, (to, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
            if to != now:
                if now is not None:
                    yield mean()
                now, seen, often, rows, upper = to, 0, np.zeros(NONE + 1, np.int64), np.zeros((NONE + 1, DIMENSIONS)), 0.0
            picked = np.frombuffer(batch.column(3)[i].as_buffer(), np.int64)
            rows += np.frombuffer(batch.column(4)[i].as_buffer(), np.float32).reshape(-1, DIMENSIONS) * picked[:, None]
            upper = upper + np.frombuffer(batch.column(5)[i].as_buffer(), np.float64) * n
            often, seen = often + picked, seen + n
    if now is not None:
        yield mean()


def fit_thresholds(texts: DataFrame, net: ConvNet, languages: language.LanguageModel) -> dict[str, float]:
    """Thresholds from the logits of all ``texts`` (toxic, text), which are counted in steps by guessed language and label."""
    shared = texts.sparkSession.sparkContext.broadcast(ToxicityModel(net, languages))

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        found = text_bytes(batch, "text")
        steps = np.rint(np.clip(shared.value.net.logits(found), -64, 64) * LOGIT_STEPS).astype(np.int32)
        return {"toxic": batch.column(0), "lang": [shared.value.languages.predict(t)[0] for t in found], "step": pa.array(steps)}

    counted = map_rows(texts.select("toxic", "text"), run, "toxic int, lang string, step int")
    rows = counted.groupBy("lang", "toxic", "step").agg(F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: (r["lang"], r["step"], r["toxic"]))
    logits, toxic, n = (np.array([r[c] for r in rows], np.float64) for c in ("step", "toxic", "n"))
    return calibrate(logits / LOGIT_STEPS, toxic, n, [r["lang"] for r in rows])


def calibrate(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray, langs: list[str]) -> dict[str, float]:
    """A threshold for every language with LEAST_ROWS texts of either label, and under "" one for all others: that of all texts
    together if they are enough, else even odds. ``weights`` are numbers of texts."""
    thresholds, code = {"": 0.0}, np.array(langs, object)
    for lang, of in [("", code == code), *[(v, code == v) for v in sorted(set(langs))]]:
        if min(weights[of & (labels == 1)].sum(), weights[of & (labels == 0)].sum()) >= LEAST_ROWS:
            thresholds[lang] = best_threshold(logits[of], labels[of], weights[of])
    return thresholds


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, from the text alone; whole texts, null and empty ones are texts without words.

    Repeated rows give repeated results, rows without doc_id are not held out, an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        scores = shared.value.predict_all(text_bytes(batch, "text"))
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    schema = "doc_id bigint, held_out boolean, score double, predicted int"
    return map_rows(docs.select("doc_id", "text", held_out().alias("held_out")), run, schema)

"""Quality classifier: random-indexing word vectors, pooled per document, under a small network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from wearstream.llm.common import labelled_sample, small_batches, word_hashes

#: Rows of the table of vectors for words, and as many for words' endings; numbers in a vector; those of an index vector
#: that aren't 0; how far a word's context reaches; the parts in which the table is summed up.
UNITS, DIMS, NONZERO, REACH, PARTS = 1 << 15, 32, 4, 2, 16


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """Sparse ternary vectors: a hash's bits say which NONZERO numbers are 1 or -1 (or their sum where two fall together)."""
    out = np.zeros((len(hashes), DIMS), np.float32)
    for j in range(NONZERO):
        place = (hashes >> np.uint64(5 * j)) & np.uint64(DIMS - 1)
        sign = ((hashes >> np.uint64(40 + j)) & np.uint64(1)).astype(np.float32) * 2 - 1
        np.add.at(out, (np.arange(len(hashes)), place.astype(np.int64)), sign)
    return out


def index_table() -> np.ndarray:
    """The index vectors of all units, the same on every machine."""
    return index_vectors(word_hashes([b"unit %d" % i for i in range(2 * UNITS)]))


@dataclass
class Reading:
    """A text's words, and the units of each: the word itself, and its last three bytes; both by their hashes."""

    words: np.ndarray
    units: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, text: str | None) -> Reading:
        found = (text or "").encode("utf-8", "replace").split()
        words = word_hashes(found)
        ends = np.fromiter((xxhash.xxh3_64_intdigest(w[-3:]) for w in found), np.uint64, len(found))
        last = np.uint64(UNITS - 1)
        return cls(words, (words & last).astype(np.int64), (ends & last).astype(np.int64) + UNITS)

    def contexts(self, index: np.ndarray) -> np.ndarray:
        """For each word the sum of the index vectors of the words within REACH of it."""
        own = index[self.units]
        out = np.zeros_like(own)
        for gap in range(1, REACH + 1):
            out[gap:] += own[:-gap]
            out[:-gap] += own[gap:]
        return out

    def numbers(self, text: str) -> list[float]:
        """Length, and the shares of distinct lines, words and pairs of words."""
        lines = [x for x in text.split("\n") if x.strip()]
        pairs = self.words[:-1] * np.uint64(31) + self.words[1:]
        share = lambda x: len(np.unique(x)) / (len(x) or 1)
        return [np.log1p(len(self.words)) / 5, len(set(lines)) / len(lines) if lines else 0.0, share(self.words), share(pairs)]


def word_vectors(sums: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Each unit's summed context, scaled to length one, and its own index vector."""
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9) + index).astype(np.float32)


def pooled(vectors: np.ndarray, text: str | None) -> np.ndarray:
    """Means and deviations of the vectors of a text's words and endings, and its numbers."""
    r = Reading.of(text)
    if not len(r.words):
        return np.r_[np.zeros(4 * DIMS), r.numbers(text or "")]
    w, e = vectors[r.units], vectors[r.ends]
    return np.r_[w.mean(0), w.std(0), e.mean(0), e.std(0), r.numbers(text)].astype(np.float64)


@dataclass
class Network:
    """tanh layer and logistic output on standardised inputs, and the temperature that calibrates it."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def train_network(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, *, hidden: int = 24, epochs: int = 120, ridge: float = 1e-4) -> Network:
    """Adam on four fifths of the rows; the temperature with the least loss on the rest."""
    rng = np.random.default_rng(7)
    order = rng.permutation(len(x))
    x, y = x[order], y[order]
    cut = max(1, len(x) * 4 // 5)
    net = Network(vectors, x[:cut].mean(0), x[:cut].std(0) + 1e-3, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    z = (x[:cut] - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(cut), max(1, cut // 128)):
            h = np.tanh(z[at] @ params[0] + params[1])
            d = (1 / (1 + np.exp(-(h @ params[2] + params[3]))) - y[at]) / len(at)
            back = np.outer(d, params[2]) * (1 - h * h)
            t += 1
            for k, g in enumerate([z[at].T @ back + ridge * params[0], back.sum(0), h.T @ d + ridge * params[2], np.array([d.sum()])]):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if cut < len(x):
        raw = net.logits(x[cut:])

        def loss(s: float) -> float:
            return float(np.mean(np.logaddexp(0, raw / s) - y[cut:] * raw / s))

        net.temperature = min(np.linspace(0.5, 6, 56), key=loss)
    return net


def fit(docs: DataFrame, labels: DataFrame, train: str, *, max_rows: int = 8000) -> Network | None:
    """Vectors and network from at most max_rows labelled rows that satisfy train; None if they are all alike.

    A unit is a word or a word's ending, by its hash: unequal ones share a vector with a chance of 1 in UNITS, and none
    are left out. Its vector is the sum of the index vectors of the words around it in the sample, scaled to length one,
    and its own index vector. Tasks sum up their texts, and each part of the table is then added up in one place.
    """
    sample = labelled_sample(docs, labels, "quality", train, max_rows)
    index, size = index_table(), 2 * UNITS // PARTS

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * UNITS, DIMS), np.float32)
        for batch in small_batches(batches, 64):
            for text in batch.column(0).to_pylist():
                r = Reading.of(text)
                around = r.contexts(index)
                np.add.at(total, r.units, around)
                np.add.at(total, r.ends, around)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS)), pa.array([total[i * size : (i + 1) * size].tobytes() for i in range(PARTS)], pa.binary())], names=["part", "sums"])

    def added(part: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x, np.float32) for x in part.column("sums").to_pylist())
        return pa.table([part.column("part").slice(0, 1), pa.array([sums.tobytes()], pa.binary())], names=["part", "sums"])

    sums = sample.mapInArrow(contexts, "part long, sums binary").groupBy("part").applyInArrow(added, "part long, sums binary").collect()
    total = np.concatenate([np.frombuffer(bytes(r["sums"]), np.float32) for r in sorted(sums)] or [np.zeros(2 * UNITS * DIMS, np.float32)])
    vectors = word_vectors(total.reshape(-1, DIMS), index)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            yield pa.RecordBatch.from_arrays([pa.array([pooled(vectors, t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = sample.mapInArrow(pool, "x array<double>, y int").collect()
    y = np.array([r[1] for r in rows], float)
    return train_network(vectors, np.array([r[0] for r in rows]), y) if len(set(y)) == 2 else None


def score_quality(docs: DataFrame, labels: DataFrame, *, train: str = "true", threshold: float = 0.3, max_rows: int = 8000) -> DataFrame:
    """Every document's quality: doc_id, score (0 to 1, higher is better), predicted (1 if score >= threshold).

    train is a condition on the labels' rows. A null text is scored as an empty one; texts are read whole; a null
    doc_id is kept, repeated rows give a row each, an empty table gives no rows and other columns aren't read. Where
    the labelled rows are all alike, or none, every score is 0.5. Nothing is shuffled but the bounded sample.
    """
    net = fit(docs, labels, train, max_rows=max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column(1).to_pylist()
            scores = np.full(len(texts), 0.5)
            if net is not None and texts:
                scores = net.probability(np.array([pooled(net.vectors, t) for t in texts]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, *, train: str = "true", threshold: float = 0.3, max_rows: int = 8000) -> DataFrame:
    """The documents, with their own columns, that the classifier doesn't reject; one pass, no join."""
    net = fit(docs, labels, train, max_rows=max_rows)
    if net is None:
        return docs
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            x = np.array([pooled(net.vectors, t) for t in batch.column(place).to_pylist()]).reshape(batch.num_rows, -1)
            if batch.num_rows:
                yield batch.filter(pa.array(net.probability(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)

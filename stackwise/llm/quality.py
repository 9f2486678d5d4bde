"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated scores.

Each word bucket has a sparse random index vector. A word's vector is the sum of the index vectors of its neighbours over the
whole corpus; a document is the mean of its words' vectors, so no label and no column but the text enters. A network of two
layers learns from labelled documents outside the held-out fold, and one temperature, fitted on labelled documents that the
network hasn't seen, turns its outputs into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _GOLD, materialise, mix, slices, spread, text_column

#: Words are hashed into so many buckets: the model's size, whatever the corpus.
BUCKETS = 1 << 14
DIMENSIONS = 32
#: Non-zero entries of an index vector, and neighbours on each side that count.
NONZERO, REACH = 2, 2
#: Labelled documents that the network learns from, at most: those with the least hashes of their ids and rows.
TRAINING_ROWS = 30_000
#: The share of those that the temperature is fitted on.
CALIBRATION = 5
HIDDEN = 24
EPOCHS, BATCH, RATE = 60, 128, 0.01
THRESHOLD = 0.3
FOLDS = 5
#: Characters of text worked on together; a text counts for ROW of them at least.
TOGETHER, ROW = 1_000_000, 256

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 white space and controls, 1 a letter or digit (bytes above 127 too), 2 other characters
_CLASS[33:127] = 2
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_INDEX = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + _GOLD).reshape(BUCKETS, NONZERO)
PLACES = (_INDEX % np.uint64(DIMENSIONS)).astype(np.int64)
SIGNS = np.where(_INDEX >> np.uint64(63), 1, -1).astype(np.int64)
#: Buckets kept for marks that a word bears besides its letters.
_SHOUTED, _REPEATED = 0, 1


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of all texts, and the number of the text that each belongs to.

    A word is a run of letters and digits or a run of other characters, as bytes, A-Z as a-z. After a word of two capitals
    or more and no small letter follows the mark "shouted", after one equal to the word two before or the last the mark
    "repeated".
    """
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(data), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kind = _CLASS[raw]
    edge = np.ones(len(raw), dtype=bool)
    edge[1:] = kind[1:] != kind[:-1]
    starts = np.flatnonzero(edge)
    inside = kind[starts] > 0
    low = _LOWER[raw]
    # a sum of mixed bytes by place modulo 16: cheap, and enough to tell words apart in so few buckets
    place = (np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))) % 16
    sums = np.add.reduceat(_BYTE[low] * (2 * place + 1).astype(np.uint64), starts)
    capitals = np.add.reduceat(_UPPER[raw].astype(np.int64), starts)
    lengths = np.diff(np.append(starts, len(raw)))
    begins = np.cumsum([0] + [len(d) + 1 for d in data])
    owner = np.searchsorted(begins, starts, side="right") - 1
    sums, owner, shouted = mix(sums[inside]), owner[inside], ((capitals == lengths) & (lengths > 1))[inside]
    same = np.zeros(len(sums), dtype=bool)
    for back in (1, 2):
        same[back:] |= (sums[back:] == sums[:-back]) & (owner[back:] == owner[:-back])
    bucket = (sums % np.uint64(BUCKETS - 2)).astype(np.int64) + 2
    counts = 1 + shouted + same
    at = np.cumsum(counts) - counts
    out, who = np.empty(counts.sum(), dtype=np.int64), np.repeat(owner, counts)
    out[at] = bucket
    out[at[shouted] + 1] = _SHOUTED
    out[(at + counts - 1)[same]] = _REPEATED
    return out, who


def word_vectors(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's vector (unit length) and weight, from the counts of its neighbours over all texts.

    A task adds up whole numbers in one BUCKETS x DIMENSIONS table; the tasks' tables are summed by bucket, and the result,
    a table of that size, goes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(BUCKETS * DIMENSIONS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for _, texts in slices(batches, 0, TOGETHER, ROW):
            w, d = words(texts)
            seen += np.bincount(w, minlength=BUCKETS)
            for gap in range(1, REACH + 1):
                near = d[gap:] == d[:-gap]
                left, right = w[:-gap][near], w[gap:][near]
                for one, other in ((left, right), (right, left)):
                    for j in range(NONZERO):
                        total += np.bincount(one * DIMENSIONS + PLACES[other, j], weights=SIGNS[other, j], minlength=len(total)).astype(np.int64)
        used = np.flatnonzero(seen)
        table = total.reshape(BUCKETS, DIMENSIONS)[used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(seen[used]), *(pa.array(c) for c in table.T)], names=["bucket", "n", *(f"v{i}" for i in range(DIMENSIONS))])

    columns = [f"v{i}" for i in range(DIMENSIONS)]
    parts = spread(docs.select(text_column(docs, text).alias("text"))).mapInArrow(run, "bucket int, n long, " + ", ".join(f"{c} long" for c in columns))
    got = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns)).toPandas()
    vectors, counts = np.zeros((BUCKETS, DIMENSIONS)), np.zeros(BUCKETS)
    at = got["bucket"].to_numpy(dtype=np.int64)
    vectors[at], counts[at] = got[columns].to_numpy(dtype=np.float64), got["n"].to_numpy(dtype=np.float64)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    share = counts / max(1.0, counts.sum())
    return vectors.astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Features of texts: the mean of the word vectors, plain and with frequent words weighing less, and the log of the length."""
    w, d = words(texts)
    n = np.bincount(d, minlength=len(texts))
    found = np.zeros((len(texts), 2 * DIMENSIONS + 1), dtype=np.float32)
    has, begin = np.flatnonzero(n), np.cumsum(n) - n
    if len(has):
        plain, by = vectors[w], weights[w]
        found[has, :DIMENSIONS] = np.add.reduceat(plain, begin[has], axis=0) / n[has, None]
        found[has, DIMENSIONS:-1] = np.add.reduceat(plain * by[:, None], begin[has], axis=0) / np.add.reduceat(by, begin[has])[:, None]
    found[:, -1] = np.log1p(n)
    return found


def features(docs: DataFrame, vectors: np.ndarray, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id and ``f``, the pooled features, of every document."""
    sent = docs.sparkSession.sparkContext.broadcast((vectors, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, 1, TOGETHER, ROW):
            x = pooled(texts, *sent.value)
            f = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), f], names=["id", "f"])

    return spread(docs.select(docs[key].cast("long").alias("id"), text_column(docs, text).alias("text"))).mapInArrow(run, "id long, f array<float>")


class Network:
    """Two layers: tanh, then a logistic output at a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        """Learns from features x and labels y (0/1) by Adam; every CALIBRATION-th row only serves the temperature."""
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        aside = np.arange(len(z)) % CALIBRATION == 0
        if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
            aside[:] = False
        fit, target = z[~aside], y[~aside].astype(np.float64)
        self.p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(fit))
            for at in range(0, len(fit), BATCH):
                rows = order[at : at + BATCH]
                hidden = np.tanh(fit[rows] @ self.p[0] + self.p[1])
                error = (_logistic(hidden @ self.p[2] + self.p[3]) - target[rows]) / len(rows)
                back = error[:, None] * self.p[2] * (1 - hidden**2)
                grads = [fit[rows].T @ back + 1e-4 * self.p[0], back.sum(axis=0), hidden.T @ error + 1e-4 * self.p[2], np.array([error.sum()])]
                t += 1
                for p, g, a, b in zip(self.p, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= RATE * (1 - epoch / EPOCHS) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        if aside.any():
            raw, truth = self.raw(x[aside]), y[aside]
            self.temperature = min(np.exp(np.linspace(-2, 3, 101)), key=lambda s: _loss(raw / s, truth))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.raw(x) / self.temperature)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _loss(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -x, x)).mean())


def held_out(key: Column) -> Column:
    """Whether a document is in the held-out fold, by the CRC-32 of its id as text; a null id isn't."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Model:
    """Word vectors and a network; without labels of both values, a constant."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, network: Network | None, constant: float):
        self.vectors, self.weights, self.network, self.constant = vectors, weights, network, constant

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.network.probability(x.astype(np.float64)) if self.network else np.full(len(x), self.constant)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[Model, DataFrame]:
    """The model and the features (id, f) of all documents."""
    vectors, weights = word_vectors(docs, text)
    found = materialise(features(docs, vectors, weights, key, text), "features")
    known = labels.select(labels[key].cast("long").alias("k"), labels[label].cast("double").alias("y")).where("k is not null and y is not null").groupBy("k").agg(F.avg("y").alias("y"))
    known = known.where(~held_out(F.col("k")))
    # hashes of ids and rows' numbers, so that a repeated id is many; those under a bound are about as many as are wanted
    labelled = found.withColumn("h", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(1 << 40))).join(known, F.col("id") == F.col("k"))
    bound = int((1 << 40) * min(1.0, 1.1 * TRAINING_ROWS / max(1, labelled.count())))
    sample = labelled.where(F.col("h") < bound).orderBy("h", "id").select("f", (F.col("y") >= 0.5).cast("int").alias("y")).limit(TRAINING_ROWS).collect()
    y = np.array([r["y"] for r in sample])
    if len(set(y)) < 2:
        return Model(vectors, weights, None, float(y.mean()) if len(y) else 1.0), found
    return Model(vectors, weights, Network(np.array([r["f"] for r in sample], dtype=np.float64), y), 1.0), found


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: key, held_out, score (probability of label 1), predicted (1 from THRESHOLD on).

    Null texts count as empty and are scored, too; repeated rows each by itself. Repeated labels count by their mean, null
    ones not at all. Without labels of both values every score is their share (1 without any). Texts are read twice and
    never shuffled; labels meet ids and features only.
    """
    model, found = fit(docs, labels, key, text, label)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(x))], names=["id", "score"])

    scored = found.mapInArrow(run, "id long, score double")
    return scored.select(F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", least: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores ``least`` or more, unchanged. Each row is judged by its own text, without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text, label)[0])

    def score(texts: pa.Array) -> pa.Array:
        batch, model = pa.RecordBatch.from_arrays([texts], names=["text"]), sent.value
        found = [model.scores(pooled(part, model.vectors, model.weights)) for _, part in slices(iter([batch]), 0, TOGETHER, ROW)]
        return pa.array(np.concatenate([np.zeros(0), *found]))

    return docs.where(F.arrow_udf(score, T.DoubleType())(text_column(docs, text)) >= least)

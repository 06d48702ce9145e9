"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Words (runs of letters and digits, or of symbols) are hashed to buckets.  Each
bucket has a fixed sparse ternary index vector; a word's vector is the sum of
the index vectors of its neighbours over the training texts.  A document is the
mean and spread of its words' vectors and the mean product of neighbouring
ones.  The network (numpy, one hidden layer, Adam) gives a logit, and a
temperature fitted on labelled rows set apart calibrates it.

The model is fitted on the driver from about `max_labelled` labelled documents
(a hash sample of those allowed); every row's whole text is scored.  A null or
empty text is pooled to zeros and scored as such.  Without labels the score is
0.5; with one class only it is near that class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import text as T

MAX_LABELLED = 3_000
BITS, DIM, NONZERO, WINDOW = 15, 32, 4, 2


def _index_slots() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the non-zero entries of each bucket's index vector."""
    h = T.mix(np.arange(1 << BITS, dtype=np.uint64)[:, None] * np.uint64(NONZERO) + np.arange(NONZERO, dtype=np.uint64) + np.uint64(1))
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each word (ASCII lower case)."""
    data = T.LOWER[data]
    starts, ends, rows = T.tokens(data, bounds, symbols_apart=True)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (T.span_hash(T.prefix_hash(data), starts, ends) >> np.uint64(64 - BITS)).astype(np.int64), rows


def word_vectors(texts: list[np.ndarray]) -> np.ndarray:
    """Unit vectors of all buckets from the words of the training texts; unseen buckets use their index vector."""
    at, sign = _index_slots()
    total = np.zeros((1 << BITS) * DIM)
    stream = [w for w in texts if len(w)]
    for w in stream:
        for d in range(1, WINDOW + 1):
            for mid, near in ((w[d:], w[:-d]), (w[:-d], w[d:])):
                np.add.at(total, (mid[:, None] * DIM + at[near]).ravel(), sign[near].ravel())
    out = total.reshape(-1, DIM)
    own = np.zeros_like(out)
    np.add.at(own, (np.arange(len(own))[:, None], at), sign)
    blank = ~out.any(1)
    out[blank] = own[blank]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(size, 1e-9)).astype(np.float32)


def pooled(w: np.ndarray, rows: np.ndarray, n: int, vectors: np.ndarray) -> np.ndarray:
    """(n, 2 DIM + 2): mean, spread, mean product of neighbours, share of repeated neighbours."""
    out = np.zeros((n, 2 * DIM + 2))
    if not len(w):
        return out
    count = np.bincount(rows, minlength=n)
    some = count > 0
    first = np.concatenate(([0], np.cumsum(count)))[:-1][some]
    v = vectors[w]
    mean = np.add.reduceat(v, first, axis=0, dtype=np.float64) / count[some, None]
    square = np.add.reduceat(v * v, first, axis=0, dtype=np.float64) / count[some, None]
    out[some, :DIM] = mean
    out[some, DIM : 2 * DIM] = np.sqrt(np.maximum(square - mean**2, 0))
    if len(w) > 1:
        same = rows[1:] == rows[:-1]
        near = np.einsum("ij,ij->i", v[1:], v[:-1])
        pairs = np.maximum(np.bincount(rows[1:][same], minlength=n), 1)
        out[:, 2 * DIM] = np.bincount(rows[1:][same], near[same], n) / pairs
        out[:, 2 * DIM + 1] = np.bincount(rows[1:][same], (w[1:] == w[:-1])[same], n) / pairs
    return out


@dataclass
class Model:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.centre) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fit(texts: list[np.ndarray], y: np.ndarray, hidden: int = 24, epochs: int = 60) -> Model:
    """texts: word buckets of each training document; y: 0 or 1."""
    vectors = word_vectors(texts)
    x = np.zeros((len(texts), 2 * DIM + 2))
    for i, w in enumerate(texts):
        x[i] = pooled(w, np.zeros(len(w), np.int64), 1, vectors)[0]
    centre = x.mean(0) if len(x) else np.zeros(2 * DIM + 2)
    scale = np.maximum(x.std(0), 1e-3) if len(x) else np.ones(2 * DIM + 2)
    rng = np.random.default_rng(11)
    model = Model(vectors, centre, scale, rng.normal(0, 1 / np.sqrt(2 * DIM), (2 * DIM + 2, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0, 1.0)
    if not len(y) or y.min() == y.max():
        model.b2 = 0.0 if not len(y) else 6.0 if y[0] else -6.0
        return model
    apart = np.arange(len(y)) % 5 == 0
    z, t = (x[~apart] - centre) / scale, y[~apart].astype(float)
    if t.min() == t.max():
        z, t, apart = (x - centre) / scale, y.astype(float), np.ones(len(y), bool)
    params = [model.w1, model.b1, model.w2, np.zeros(1)]
    params[3][0] = np.log(t.mean() / (1 - t.mean()))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(t)), max(1, len(t) // 64)):
            step += 1
            h = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -30, 30)))
            d = (p - t[rows]) / len(rows)
            dh = d[:, None] * params[2] * (1 - h**2)
            for k, g in enumerate((z[rows].T @ dh + 1e-3 * params[0], dh.sum(0), h.T @ d + 1e-3 * params[2], d.sum(keepdims=True))):
                m = moments[k]
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                params[k] -= 0.01 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = params[0], params[1], params[2], float(params[3][0])
    logits, target = model.logit(x[apart]), y[apart].astype(float)
    grid = np.exp(np.linspace(np.log(0.25), np.log(8.0), 60))
    loss = [np.mean(np.logaddexp(0, -np.where(target > 0, 1, -1) * logits / g)) for g in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def train(documents: DataFrame, labels: DataFrame, allowed: Column, max_labelled: int = MAX_LABELLED) -> Model:
    """Fits on a hash sample of about max_labelled allowed rows of labels (doc_id, quality) and their texts."""
    draw = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30))
    rows = labels.where(allowed & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    limit = F.lit(0)
    for k, n in counts.items():
        limit = F.when(F.col("quality") == k, F.lit(int(min(1.0, max_labelled * max(0.35, n / sum(counts.values())) / n) * (1 << 30)))).otherwise(limit)
    some = rows.where(draw < limit).groupBy("doc_id").agg(F.max("quality").alias("quality")).limit(3 * max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = T.utf8(b.column("text"))
            found = [words(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))[0].astype("<u2").tobytes() for i in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(found, pa.binary())], ["doc_id", "quality", "w"])

    kind = dict(documents.dtypes)["doc_id"]
    found = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "quality", "text").mapInArrow(run, f"doc_id {kind}, quality int, w binary").limit(3 * max_labelled).collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["w"])))
    return fit([np.frombuffer(r["w"], "<u2").astype(np.int64) for r in found], np.array([int(r["quality"] > 0) for r in found]))


def score(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """score (0 to 1) of every row of documents (text), behind the columns in keep."""
    keep = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = T.utf8(b.column("__text"))
            p = np.zeros(len(offsets) - 1)
            for i, j in T.slices(offsets):
                w, rows = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                p[i:j] = model.probability(pooled(w, rows, j - i, model.vectors))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(p, pa.float64())], [*keep, "score"])

    schema = ", ".join(f"`{k}` {t}" for k, t in documents.select(*keep).dtypes) + ", score double"
    return documents.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)

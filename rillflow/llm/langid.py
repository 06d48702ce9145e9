"""Language identification: family first, then pairwise linear SVMs within it.

Features are hashed byte 1- to 4-grams of the lower-cased text without digits
and ASCII punctuation, as shares of a text's grams.  A linear model's score of a text is then
the mean weight of its grams, so whole texts are scored in one vectorised pass
without building feature vectors.  Families are told apart by one-versus-rest
SVMs; within a family each pair of languages has its own SVM, and the language
with most pair votes wins (then the larger sum of margins, then the name).

The model is fitted on the driver from about `per_language` documents of each
language (a hash sample of those allowed).  A null text, or one without a
letter, is `und` with score 0; without learned languages every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

from . import text as T

PER_LANGUAGE = 500
BITS = 13
SCALE = np.float32(30.0)
# Language families by code; a language not named is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tt".split(),
    "indic": "hi bn ur mr gu pa ne si".split(),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)
_MIXER = np.uint32(0x9E3779B1)


def grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each gram (4 for each byte) and its row; grams never cross rows."""
    x = _FOLD[data]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found, rows = [], []
    code = np.zeros(len(x), np.uint32)
    for k in range(4):
        code = code[: len(x) - k] * np.uint32(257) + x[k:] + np.uint32(k + 1) if k else x + np.uint32(1)
        if not len(code):
            break
        h = code * _MIXER
        h ^= h >> np.uint32(15)
        ok = row[: len(code)] == row[k:] if k else slice(None)
        found.append(((h * _MIXER) >> np.uint32(32 - BITS))[ok])
        rows.append(row[: len(code)][ok])
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(rows)


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of gram shares for each text."""
    out = np.zeros((len(offsets) - 1, 1 << BITS), np.float32)
    for i in range(len(out)):
        b, _ = grams(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
        if len(b):
            out[i] = np.bincount(b, minlength=1 << BITS) / len(b)
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, epochs: int = 60, c: float = 10.0) -> tuple[np.ndarray, float, float]:
    """Squared-hinge SVM (y is +1 or -1) on rows of x (else all) by dual coordinate descent; weights, bias, and scale of its margins.

    The rows are read where they are: x is most of the driver's Python memory.
    """
    rng = np.random.default_rng(7)
    rows = np.arange(len(y)) if rows is None else rows
    w, bias, a = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(len(y))
    own = np.einsum("ij,ij->i", x, x)[rows] + 1 + 1 / (2 * c)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (float(x[rows[i]] @ w) + bias) - 1 + a[i] / (2 * c)
            new = max(a[i] - g / own[i], 0.0)
            if new != a[i]:
                most = max(most, abs(new - a[i]))
                w += np.float32((new - a[i]) * y[i]) * x[rows[i]]
                bias += (new - a[i]) * y[i]
                a[i] = new
        if most < 1e-3 * max(1.0, a.max()):
            break
    margin = np.abs((x @ w)[rows] + bias)
    return w, bias, float(4.0 / max(np.median(margin), 1e-9))


@dataclass
class Model:
    weights: np.ndarray  # (buckets, classifiers)
    bias: np.ndarray
    scale: np.ndarray
    families: list[str]
    family_at: list[int]  # classifier of each family; -1: the only one
    langs: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int, int]]]  # (first, second, classifier), indexes into langs

    def score(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and its probability for each row of margins (rows, classifiers)."""
        n = len(margins)
        z = margins * self.scale
        if len(self.families) > 1:
            f = z[:, self.family_at]
            e = np.exp(f - f.max(1, keepdims=True))
            family, p = f.argmax(1), (e / e.sum(1, keepdims=True)).max(1)
        else:
            family, p = np.zeros(n, int), np.ones(n)
        out = np.empty(n, object)
        prob = p.copy()
        for k, name in enumerate(self.families):
            own = np.flatnonzero(family == k)
            langs = self.langs[name]
            votes, sums = np.zeros((len(own), len(langs))), np.zeros((len(own), len(langs)))
            q = np.ones((len(own), len(langs)))
            for i, j, c in self.pairs[name]:
                m = z[own, c]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                sums[:, i] += m
                sums[:, j] -= m
                s = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
                q[:, i] = np.minimum(q[:, i], s)
                q[:, j] = np.minimum(q[:, j], 1 - s)
            best = (votes + 0.5 * np.tanh(sums / 1e3)).argmax(1)
            out[own] = np.array(langs, object)[best]
            prob[own] *= q[np.arange(len(own)), best]
        return list(out), np.clip(prob, 0.0, 1.0)


def fit(langs: list[str], x: np.ndarray) -> Model | None:
    known = sorted(set(langs))
    if not known:
        return None
    y = np.array(langs, object)
    of = {lang: _FAMILY.get(lang.lower(), lang) for lang in known}
    families = sorted(set(of.values()))
    columns: list[tuple[np.ndarray, float, float]] = []

    def add(rows: np.ndarray, first: np.ndarray) -> int:
        columns.append(linear_svm(x, np.where(first[rows], 1.0, -1.0), rows))
        return len(columns) - 1

    fam = np.array([of[v] for v in langs], object)
    everything = np.arange(len(y))
    family_at = [add(everything, fam == f) for f in families] if len(families) > 1 else [-1]
    members = {f: [v for v in known if of[v] == f] for f in families}
    pairs = {f: [(i, j, add(np.flatnonzero((y == m[i]) | (y == m[j])), y == m[i])) for i in range(len(m)) for j in range(i + 1, len(m))] for f, m in members.items()}
    if not columns:
        columns.append((np.zeros(1 << BITS, np.float32), 0.0, 1.0))
    w, b, s = zip(*columns)
    return Model(np.stack(w, 1), np.array(b), np.array(s), families, family_at, members, pairs)


def train(documents: DataFrame, allowed: Column, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fits on a hash sample of about per_language of the allowed documents (text, lang) of each language."""
    rows = documents.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("draw"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    limit = F.lit(0)
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, F.lit(int(min(1.0, per_language / n) * (1 << 30)))).otherwise(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = T.utf8(b.column("text"))
            for i in range(len(offsets) - 1):
                if offsets[i + 1] > offsets[i]:
                    v = vectors(data, offsets[i : i + 2])[0]
                    at = np.flatnonzero(v)
                    yield pa.RecordBatch.from_arrays([b.column("lang").slice(i, 1).cast(pa.string()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([v[at].astype("<f4").tobytes()], pa.binary())], ["lang", "at", "v"])

    found = rows.where(F.col("draw") < limit).select("lang", "text").mapInArrow(run, "lang string, at binary, v binary").limit(2 * per_language * len(counts)).toArrow().combine_chunks()
    found = found.take(pc.sort_indices(found, sort_keys=[(c, "ascending") for c in ("lang", "at", "v")]))
    langs = found.column("lang").to_pylist()
    x, at, v = np.zeros((len(found), 1 << BITS), np.float32), None, None
    for i, (at, v) in enumerate(zip(found.column("at"), found.column("v"))):
        x[i, np.frombuffer(at.as_buffer(), "<u2")] = np.frombuffer(v.as_buffer(), "<f4")
    x *= SCALE
    del found, at, v
    pa.default_memory_pool().release_unused()
    return fit(langs, x)


def identify(documents: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """lang_pred and score of every row of documents (text), behind the columns in keep."""
    keep = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("__text")
            data, offsets = T.utf8(texts)
            n = len(offsets) - 1
            margins = np.zeros((n, model.weights.shape[1] if model else 1))
            plain = np.zeros(n, bool)
            for i, j in T.slices(offsets):
                part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if not len(part):
                    continue
                letters = (part >= 65) & (part <= 90) | (part >= 97) & (part <= 122)
                plain[i:j] = np.diff(np.concatenate(([0], np.cumsum(letters)))[bounds]) > 0
                if model:
                    g, row = grams(part, bounds)
                    count = np.maximum(np.bincount(row, minlength=j - i), 1)
                    for c in range(margins.shape[1]):
                        margins[i:j, c] = np.bincount(row, model.weights[:, c][g], j - i) / count * SCALE + model.bias[c]
            langs, score = model.score(margins) if model else (["und"] * n, np.zeros(n))
            for i in np.flatnonzero(~plain):
                t = texts[int(i)].as_py()
                if not t or not _LETTER.search(t):
                    langs[i], score[i] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(langs, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{k}` {t}" for k, t in documents.select(*keep).dtypes) + ", lang_pred string, score double"
    return documents.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)

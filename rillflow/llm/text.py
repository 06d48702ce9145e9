"""Vectorised helpers over UTF-8 bytes of Arrow string columns.

The kernels below never build Python strings: they see a batch as one byte
array with document offsets and work on slices of bounded size, so a task's
memory does not depend on how many rows Spark hands over at once.
"""

from __future__ import annotations

import gc
import os
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 20
BATCH_ROWS = 512

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_MULT_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches unless the session has a size of its own, and the package importable by Python workers that start elsewhere."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":  # Spark's default
        spark.conf.set(batch, str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back, with its lineage cut.

    The folder is spark.checkpoint.dir of the session; one is set only where the
    cluster names none (local tests).
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            import tempfile

            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="rillflow-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """Checkpoints df, after the shuffle files of earlier steps are given up."""
    drop_shuffles(df.sparkSession)
    return checkpointed(df)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that nothing refers to any more.

    It does so once the driver's garbage is collected, which else may take long; the
    first collection lets go of Python's handles, the second of what they held.
    """
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(1.0)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most limit bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    with np.errstate(over="ignore"):
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 64)
        for name, base in (("up", _MULT), ("down", _MULT_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[e]-h[s] (times the inverse power of s) the polynomial hash of data[s:e]."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts:ends], the same for equal bytes wherever they stand."""
    _, down = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def spans_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """span_hash of size bytes from every place on that leaves room."""
    n = max(len(prefix) - size, 0)
    _, down = _powers(len(prefix))
    return mix((prefix[size:] - prefix[:n]) * down[:n] + np.uint64(size))


def contained(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of values occur in among (sorted)."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among.take(np.searchsorted(among, values), mode="clip") == values


#: 0 white space, 1 letters, digits and all non-ASCII bytes, 2 other ASCII.
BYTE_KIND = np.array([0 if b in b"\t\n\v\f\r \x1c\x1d\x1e\x1f" else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def tokens(data: np.ndarray, bounds: np.ndarray, symbols_apart: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of rows data[bounds[i]:bounds[i+1]].

    Words are runs without white space, or with symbols_apart runs of one kind in BYTE_KIND.
    """
    kind = BYTE_KIND[data]
    if not symbols_apart:
        kind = np.minimum(kind, 1)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.empty(len(data), bool)
    cut[0] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    cut[inner] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def shingles(data: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of size words (ASCII lower case); a shorter row is one shingle, a row without words none."""
    data = LOWER[data]
    starts, ends, rows = tokens(data, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = span_hash(prefix_hash(data), starts, ends)
    n_rows = len(bounds) - 1
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(counts)))
    made, owner = [], []
    if len(words) >= size:
        acc = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            acc = acc * _MULT + words[k : len(words) - size + 1 + k]
        same = rows[: len(acc)] == rows[size - 1 :]
        made.append(mix(acc[same]))
        owner.append(rows[: len(acc)][same])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        one = np.empty(len(short), np.uint64)
        for i, r in enumerate(short):
            h = 0
            for w in words[first[r] : first[r + 1]]:
                h = (h * int(_MULT) + int(w)) & 0xFFFFFFFFFFFFFFFF
            one[i] = h
        made.append(mix(one + counts[short].astype(np.uint64)))
        owner.append(short)
    if not made:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(made), np.concatenate(owner)

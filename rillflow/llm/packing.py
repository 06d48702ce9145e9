"""Packing along a space-filling curve.

A document's token ids are hashed to a signed count vector, projected to three
dimensions and put on a Hilbert curve.  Documents are range-sorted by their
place on the curve and laid end to end, so that a sequence holds neighbours;
each sequence is full but for the last one, hence a document may be cut.

Steps: tokenise once and store ids; sort (curve key, row) only and sum lengths
within range partitions; add the partitions' offsets; bring each row's place
back to its ids and cut.  Only one number per partition reaches the driver.

A null text counts as empty: such a document has the end id only.  Repeated
rows are packed once each.  Texts are tokenised whole.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import text as T

SEQUENCE, END_ID, DIMS, BITS, HASHED = 4096, 2, 3, 12, 64
CACHE_ENTRIES = 600_000

_SAFE = re.compile("[!-~¡-ɏ]+")
#: Characters for which parts may be lower-cased and cut before they reach the tokenizer.
_UNSAFE = re.compile("[^\\n !-~¡-ɏ]")
#: A full stop or comma that is not alone between a letter or digit and white space.
_RUN = re.compile(r"[.,](?<=[^\w\s].)(?=[ \n]|\Z)")


class _Remembered(dict):
    """Makes the values it lacks, and starts anew when full."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        got = self.make(key)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[key] = got
        return got


class WordTokenizer:
    """The tokenizer, called on single words and remembered.

    For tokenizers that drop white space and split words before the merges, ids of a
    text are those of its parts between spaces.  Parts of plain Latin characters are
    cut by the tokenizer's own split pattern and each piece goes to its model; all
    other parts go to the whole tokenizer.  The memory is emptied when full.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        steps = config["pre_tokenizer"]["pretokenizers"]
        if [x["type"] for x in steps] != ["Split", "ByteLevel"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"]:
            raise ValueError("this tokenizer keeps white space or splits words in another way")
        self.split = regex.compile(steps[0]["pattern"]["Regex"])
        self.special = tuple(x["content"] for x in config["added_tokens"])
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.letters = _byte_letters()
        # words of letters only are one piece if nothing but an apostrophe comes before them in the pattern
        choices = steps[0]["pattern"]["Regex"].split("|")
        self.plain = "[\\p{L}]+" in choices and all(x.startswith("'") for x in choices[: choices.index("[\\p{L}]+")])
        self.pieces = _Remembered(self._piece)
        self.parts = _Remembered(self._part)

    def _piece(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
        return array(self.code, [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _part(self, part: str) -> bytes:
        if _SAFE.fullmatch(part) and not any(s in part for s in self.special) and (part.isascii() or unicodedata.is_normalized("NFC", part)):
            low = part.lower()
            return self._piece(low) if self.plain and low.isalpha() else b"".join(map(self.pieces.__getitem__, self.split.findall(low)))
        return array(self.code, self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian integers."""
        if not _UNSAFE.search(text) and not any(x in text for x in self.special):
            # as the tokenizer would: lower case, and single stops and commas apart from words
            text = text.lower()
            if not _RUN.search(text):
                text = text.replace("\n", " ").replace(". ", " . ").replace(", ", " , ")
        return b"".join(map(self.parts.__getitem__, text.replace("\n", " ").split(" ")))


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of points (n, dims), integers below 2**bits."""
    x = points.astype(np.int64).T.copy()
    dims, high = len(x), 1 << (bits - 1)
    q = high
    while q > 1:
        low = q - 1
        for i in range(dims):
            flip = (x[i] & q) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = high
    while q > 1:
        t = np.where((x[dims - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Hilbert keys of hashed document vectors: a fixed random projection, put on a grid by its spread."""
    v = np.sign(vectors) * np.log1p(np.abs(vectors))
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    way = np.random.default_rng(3).normal(size=(vectors.shape[1], DIMS))
    share = 1 / (1 + np.exp(-2.0 * (v @ way)))
    return hilbert(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def stored(df: DataFrame) -> DataFrame:
    """df written as compressed Parquet under the shared checkpoint folder and read back."""
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        T.checkpointed(spark.range(1))
    path = f"{context.getCheckpointDir().get()}/packing-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def tokenised(documents: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """rid, doc_id, n (ids with the end id), key (on the curve) and ids (bytes) of every row."""
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        mixed = T.mix(np.arange(1 << 16, dtype=np.uint64))
        slot, sign = (mixed % np.uint64(HASHED)).astype(np.int64), np.where(mixed >> np.uint64(63), 1.0, -1.0)
        end = np.array([end_id], tok.dtype).tobytes()
        for b in batches:
            texts = b.column("text")
            for i in range(0, len(texts), 128):
                ids, vectors = [], []
                for t in texts.slice(i, 128):
                    one = tok.encode(t.as_py() or "") + end
                    a = np.frombuffer(one, tok.dtype) & 0xFFFF
                    vectors.append(np.bincount(slot[a], sign[a], HASHED))
                    ids.append(one)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("rid").slice(i, 128),
                        b.column("doc_id").slice(i, 128),
                        pa.array([len(x) // tok.dtype.itemsize for x in ids], pa.int64()),
                        pa.array(curve_keys(np.array(vectors)), pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["rid", "doc_id", "n", "key", "ids"],
                )

    rows = documents.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return stored(rows.mapInArrow(run, f"rid long, doc_id {kind}, n long, key long, ids binary"))


def places(rows: DataFrame) -> DataFrame:
    """rid and begin: where each row's ids start when rows (rid, n, key) are laid end to end along the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            n = b.column("n").to_numpy()
            upto = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("part"), pa.array(upto - n, pa.int64()), pa.array(upto, pa.int64())], ["rid", "part", "begin", "upto"])
            at = int(upto[-1]) if len(upto) else at

    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inner = T.checkpointed(
        rows.select("rid", "n", "key").repartitionByRange(ranges, "key", "rid").sortWithinPartitions("key", "rid").withColumn("part", F.spark_partition_id()).mapInArrow(run, "rid long, part int, begin long, upto long")
    )
    ends = inner.groupBy("part").agg(F.max("upto").alias("n")).orderBy("part").collect()
    starts, at = [], 0
    for r in ends:
        starts.append((r["part"], at))
        at += r["n"]
    offsets = spark.createDataFrame(starts, "part int, base long")
    return inner.join(F.broadcast(offsets), "part").select("rid", (F.col("begin") + F.col("base")).alias("begin"))


def pack(documents: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of documents (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    kind = dict(documents.dtypes)["doc_id"]
    rows = tokenised(documents, path, end_id)
    wide = tokenizer(path).dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            of: list[int] = []
            for i, (begin, raw) in enumerate(zip(b.column("begin").to_pylist(), b.column("ids"))):
                ids = np.frombuffer(raw.as_buffer(), wide).astype("<u4")
                at = 0
                while at < len(ids):
                    seq, offset = divmod(begin + at, sequence)
                    cut = ids[at : at + sequence - offset]
                    out.append((at, len(cut), zlib.crc32(cut), len(ids), seq, offset, cut.tobytes() if with_ids else b""))
                    of.append(i)
                    at += len(cut)
            columns = list(zip(*out)) if out else [()] * 7
            arrays = [b.column("doc_id").take(pa.array(of, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:6])]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(columns[6], pa.binary())] if with_ids else [])], [*names, *(["ids"] if with_ids else [])])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    begins = places(rows)
    return rows.select("rid", "doc_id", "ids").join(begins.hint("shuffle_hash"), "rid").select("doc_id", "begin", "ids").mapInArrow(run, schema)

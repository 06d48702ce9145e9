"""GeoTIFF reading and writing without native libraries.

Reads the first band of strip or tiled, little- or big-endian, classic or big
TIFFs, uncompressed, deflate or LZW, with horizontal differencing; one Spark
task decodes one file's blocks, read through Spark's `binaryFile` source so any
store works.  Writes one strip per row block, LZW by default.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.grid import DEFAULT_NODATA, GridMeta
from ..plans.tiles import checkpointed

# TIFF field types as struct codes, tags, and sample formats.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_KINDS = {1: "u", 2: "i", 3: "f"}
_BIG_BYTES = 4_000_000_000


@dataclass
class Header:
    meta: GridMeta
    dtype: np.dtype
    tags: dict[int, tuple]
    order: str

    @property
    def tiled(self) -> bool:
        return 322 in self.tags

    def blocks(self) -> Iterator[tuple[int, int, int, int, int, int]]:
        """row, col, rows, cols, offset and bytes of each block of the first band."""
        t = self.tags
        height, width = self.meta.nrows, self.meta.ncols
        if self.tiled:
            h, w, offsets, sizes = t[323][0], t[322][0], t[324], t[325]
        else:
            h, w, offsets, sizes = min(t.get(278, (height,))[0], height), width, t[273], t[279]
        across, down = -(-width // w), -(-height // h)
        for i in range(across * down):
            yield (i // across) * h, (i % across) * w, h, w, offsets[i], sizes[i]


def header(raw: bytes) -> Header:
    """Shape, georeference, type and block table of a TIFF file."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    version = struct.unpack(order + "H", raw[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack(order + ("Q" if big else "I"), raw[8:16] if big else raw[4:8])[0]
    count = struct.unpack_from(order + ("Q" if big else "H"), raw, at)[0]
    at += 8 if big else 2
    tags: dict[int, tuple] = {}
    for _ in range(count):
        tag, kind, n = struct.unpack_from(order + ("HHQ" if big else "HHI"), raw, at)
        inline = at + (12 if big else 8)
        size = _SIZES.get(kind, 1) * n
        place = inline if size <= (8 if big else 4) else struct.unpack_from(order + ("Q" if big else "I"), raw, inline)[0]
        if kind in _TYPES:
            code = f"{n}s" if kind == 2 else _TYPES[kind] * n
            tags[tag] = struct.unpack_from(order + code, raw, place)
        at += 20 if big else 12
    bits, form = tags.get(258, (8,))[0], tags.get(339, (1,))[0]
    nodata = tags.get(42113, (b"",))[0].rstrip(b"\0 ").decode() if 42113 in tags else ""
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    keys = tags.get(34735, ())
    model = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] == 1024), 1)
    meta = GridMeta(tags[257][0], tags[256][0], float(scale[0]), float(scale[1]), tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], model == 2, "", float(nodata) if nodata else DEFAULT_NODATA)
    return Header(meta, np.dtype(f"{order}{_KINDS[form]}{bits // 8}"), tags, order)


def lzw_decoded(data: bytes) -> bytes:
    """TIFF's LZW (most significant bit first, codes grow one early)."""
    out, table, width, prev = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, None
    acc = bits = 0
    for byte in data:
        acc, bits = (acc << 8) | byte, bits + 8
        while bits >= width:
            code = (acc >> (bits - width)) & ((1 << width) - 1)
            bits -= width
            acc &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                del table[258:]
                width, prev = 9, None
                continue
            entry = table[code] if code < len(table) else prev + prev[:1]
            out += entry
            if prev is not None:
                table.append(prev + entry[:1])
            prev = entry
            size = len(table) + 1
            width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    return bytes(out)


def lzw_encoded(data: bytes) -> bytes:
    out, acc, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal acc, bits
        acc, bits = (acc << width) | code, bits + width
        while bits >= 8:
            out.append((acc >> (bits - 8)) & 255)
            bits -= 8
        acc &= (1 << bits) - 1

    table = {bytes([i]): i for i in range(256)}
    width, size, word = 9, 258, b""
    put(256, 9)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = size
        size += 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
        if size >= 4094:
            put(256, width)
            table = {bytes([i]): i for i in range(256)}
            width, size = 9, 258
        word = data[i : i + 1]
    if word:
        put(table[word], width)
        size += 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    put(257, width)
    if bits:
        out.append((acc << (8 - bits)) & 255)
    return bytes(out)


def block(raw: bytes, head: Header, rows: int, cols: int, offset: int, size: int) -> np.ndarray:
    """One decoded block (rows, cols); a last strip may be shorter."""
    data = raw[offset : offset + size]
    how = head.tags.get(259, (1,))[0]
    if how == 5:
        data = lzw_decoded(data)
    elif how in (8, 32946):
        data = zlib.decompress(data)
    elif how != 1:
        raise ValueError(f"no decoder for compression {how}")
    bands = head.tags.get(277, (1,))[0] if head.tags.get(284, (1,))[0] == 1 else 1
    a = np.frombuffer(data[: len(data) // (cols * bands * head.dtype.itemsize) * cols * bands * head.dtype.itemsize], head.dtype).reshape(-1, cols, bands)[:, :, 0]
    predictor = head.tags.get(317, (1,))[0]
    if predictor == 2:
        a = np.cumsum(a, axis=1, dtype=head.dtype.newbyteorder("=")).astype(head.dtype)
    elif predictor != 1:
        raise ValueError(f"no decoder for predictor {predictor}")
    return a


def cells_of(raw: bytes, kind: type = float) -> Iterator[pd.DataFrame]:
    """row, col and value (None for nodata) of a file, block by block."""
    head = header(raw)
    for row, col, h, w, offset, size in head.blocks():
        a = block(raw, head, h, w, offset, size)[: head.meta.nrows - row, : head.meta.ncols - col]
        value = a.astype(float).ravel()
        value[np.abs(value - head.meta.nodata) < 1e-5] = np.nan
        r, c = np.divmod(np.arange(a.size), a.shape[1])
        yield pd.DataFrame({"row": (r + row).astype("int32"), "col": (c + col).astype("int32"), "value": value})


def read(spark: SparkSession, path: str, cast: str = "double") -> tuple[DataFrame, GridMeta]:
    """The cells of one file as (row, col, value), NULL for nodata, and its header."""
    files = spark.read.format("binaryFile").load(path)
    first = files.select(F.col("content")).first()
    if first is None:
        raise FileNotFoundError(path)
    meta = header(bytes(first["content"])).meta

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["content"]:
                yield from cells_of(bytes(raw))

    found = files.select("content").mapInPandas(run, "row int, col int, value double")
    return found.select("row", "col", F.nanvl("value", F.lit(None)).cast(cast).alias("value")), meta


_PACKERS = {"lzw": lzw_encoded, "deflate": zlib.compress, "none": bytes}


def frame_of(sizes: list[int], strip_rows: int, meta: GridMeta, dtype: str, compress: str) -> tuple[bytes, bytes]:
    """What stands before and after the packed strips of these sizes in a TIFF file."""
    kind = np.dtype(dtype)
    big = sum(sizes) > _BIG_BYTES
    word, width = ("Q", 16) if big else ("I", 4)
    at, offsets = (16 if big else 8), []
    for n in sizes:
        offsets.append(at)
        at += n
    nodata = f"{meta.nodata:.17g}\0".encode()
    form = {"u": 1, "i": 2, "f": 3}[kind.kind]
    keys = (1, 1, 0, 2, 1024, 0, 1, 2 if meta.geographic else 1, 1025, 0, 1, 1)
    entries = [
        (256, 4, (meta.ncols,)), (257, 4, (meta.nrows,)), (258, 3, (kind.itemsize * 8,)), (259, 3, ({"lzw": 5, "deflate": 8, "none": 1}[compress],)), (262, 3, (1,)), (273, width if big else 4, tuple(offsets)),
        (277, 3, (1,)), (278, 4, (strip_rows,)), (279, width if big else 4, tuple(sizes)), (284, 3, (1,)), (339, 3, (form,)), (33550, 12, (meta.dx, meta.dy, 0.0)),
        (33922, 12, (0.0, 0.0, 0.0, meta.xleft, meta.ytop, 0.0)), (34735, 3, keys), (42113, 2, nodata),
    ]
    fixed, room = (20, 8) if big else (12, 4)
    extra_at = at + (8 if big else 2) + fixed * len(entries) + (8 if big else 4)
    table, extra = struct.pack("<" + ("Q" if big else "H"), len(entries)), b""
    for tag, t, values in entries:
        data = values if t == 2 else struct.pack("<" + _TYPES[t] * len(values), *values)
        n = len(values)
        table += struct.pack("<HH" + word, tag, t, n)
        if len(data) <= room:
            table += data.ljust(room, b"\0")
        else:
            table += struct.pack("<" + word, extra_at + len(extra))
            extra += data + b"\0" * (len(data) % 2)
    table += struct.pack("<" + word, 0)
    lead = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at)
    return lead, table + extra


def strips_of(cells: DataFrame, meta: GridMeta, strip_rows: int, pack: Callable[[np.ndarray], bytes]) -> tuple[DataFrame, list[int], Callable[[int], bytes]]:
    """strip and data of all strips with cells, packed by the tasks and written to the shared folder; the sizes of all strips; and what a strip without cells holds."""
    ncols, nrows = meta.ncols, meta.nrows

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        top = int(key[0]) * strip_rows
        a = np.full((min(strip_rows, nrows - top), ncols), np.nan)
        a[rows["row"].to_numpy() - top, rows["col"].to_numpy()] = rows["value"].to_numpy(dtype=float, na_value=np.nan)
        data = pack(a)
        return pd.DataFrame({"strip": [int(key[0])], "size": [len(data)], "data": [data]})

    strips = checkpointed(cells.withColumn("strip", F.floor(F.col("row") / strip_rows)).groupBy("strip").applyInPandas(run, "strip long, size long, data binary"))
    size = {r["strip"]: r["size"] for r in strips.select("strip", "size").collect()}
    blank = functools.cache(lambda rows: pack(np.full((rows, ncols), np.nan)))
    missing = lambda k: blank(min(strip_rows, nrows - k * strip_rows))
    return strips.select("strip", "data"), [size[k] if k in size else len(missing(k)) for k in range(-(-nrows // strip_rows))], missing


def stream(spark: SparkSession, path: str, lead: bytes, strips: DataFrame, count: int, missing: Callable[[int], bytes], tail: bytes = b"") -> None:
    """Writes lead, the strips in order and tail to a path; the driver holds one partition of strips at a time."""
    out = _created(spark, path)
    try:
        out.write(bytearray(lead))
        at = 0
        for r in strips.orderBy("strip").toLocalIterator():
            for k in range(at, r["strip"]):
                out.write(bytearray(missing(k)))
            out.write(bytearray(r["data"]))
            at = r["strip"] + 1
        for k in range(at, count):
            out.write(bytearray(missing(k)))
        out.write(bytearray(tail))
    finally:
        out.close()


def write(cells: DataFrame, meta: GridMeta, path: str, dtype: str = "<f4", compress: str = "lzw", strip_rows: int = 64) -> None:
    """Writes cells (row, col, value) as one file at path (any store that Spark writes to).

    Strips are packed by the tasks; the driver learns their sizes and streams them into the file.
    """
    nodata, packer = meta.nodata, _PACKERS[compress]
    strips, sizes, missing = strips_of(cells, meta, strip_rows, lambda a: packer(np.where(np.isnan(a), nodata, a).astype(dtype).tobytes()))
    lead, tail = frame_of(sizes, strip_rows, meta, dtype, compress)
    stream(cells.sparkSession, path, lead, strips, len(sizes), missing, tail)


def _created(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(conf).create(place, True)


def save(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes bytes to a path of any Hadoop file system."""
    out = _created(spark, path)
    try:
        out.write(bytearray(data))
    finally:
        out.close()

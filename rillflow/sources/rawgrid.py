"""ENVI, EHdr and SAGA grids: a flat binary file and a text header beside it.

Hadoop splits the file at whole rows, so its size is not bounded by a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.grid import DEFAULT_NODATA, GridMeta
from .geotiff import save, stream, strips_of

# ENVI data type numbers.
ENVI_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4"}


def envi_header(text: str) -> tuple[GridMeta, np.dtype]:
    values = {}
    for line in text.replace("\r", "").split("\n"):
        key, _, value = line.partition("=")
        values[key.strip().lower()] = value.strip()
    info = [v.strip() for v in values.get("map info", "").strip("{}").split(",")]
    dx, dy, x, y = (float(info[5]), float(info[6]), float(info[3]), float(info[4])) if len(info) > 6 else (1.0, 1.0, 0.0, 0.0)
    meta = GridMeta(int(values["lines"]), int(values["samples"]), dx, dy, x, y, bool(info) and info[0].lower().startswith("geographic"), "", float(values.get("data ignore value", DEFAULT_NODATA)))
    return meta, np.dtype((">" if values.get("byte order") == "1" else "<") + ENVI_TYPES[int(values.get("data type", 4))])


def ehdr_header(text: str) -> tuple[GridMeta, np.dtype]:
    values = dict(line.upper().split(None, 1) for line in text.split("\n") if len(line.split(None, 1)) == 2)
    bits, pixel = int(values.get("NBITS", 8)), values.get("PIXELTYPE", "").strip()
    kind = "f" if pixel == "FLOAT" else "i" if pixel == "SIGNEDINT" or (not pixel and bits > 8) else "u"
    dx, dy = float(values.get("XDIM", 1)), float(values.get("YDIM", 1))
    meta = GridMeta(int(values["NROWS"]), int(values["NCOLS"]), dx, dy, float(values.get("ULXMAP", dx / 2)) - dx / 2, float(values.get("ULYMAP", -dy / 2)) + dy / 2, False, "", float(values.get("NODATA", DEFAULT_NODATA)))
    return meta, np.dtype((">" if values.get("BYTEORDER", "I").strip() == "M" else "<") + kind + str(bits // 8))


# SAGA data formats.
SAGA_TYPES = {"FLOAT": "f4", "DOUBLE": "f8", "SHORTINT": "i2", "SHORTINT_UNSIGNED": "u2", "INTEGER": "i4", "INTEGER_UNSIGNED": "u4", "BYTE_UNSIGNED": "u1", "BYTE": "i1"}


def saga_header(text: str) -> tuple[GridMeta, np.dtype, bool]:
    """The third: whether rows go from the top down."""
    values = {k.strip().upper(): v.strip() for k, _, v in (line.partition("=") for line in text.replace("\r", "").split("\n"))}
    size, nrows = float(values["CELLSIZE"]), int(values["CELLCOUNT_Y"])
    left, top = float(values["POSITION_XMIN"]) - size / 2, float(values["POSITION_YMIN"]) + (nrows - 0.5) * size
    meta = GridMeta(nrows, int(values["CELLCOUNT_X"]), size, size, left, top, False, "", float(values.get("NODATA_VALUE", str(DEFAULT_NODATA)).split(";")[0]))
    return meta, np.dtype((">" if values.get("BYTEORDER_BIG", "FALSE").upper() == "TRUE" else "<") + SAGA_TYPES[values["DATAFORMAT"].upper()]), values.get("TOPTOBOTTOM", "FALSE").upper() == "TRUE"


def _text(spark: SparkSession, path: str) -> str:
    return bytes(spark.read.format("binaryFile").load(path).first()["content"]).decode()


def read(spark: SparkSession, path: str, header_path: str | None = None) -> tuple[DataFrame, GridMeta]:
    """The cells of a .bil (EHdr), .bin (ENVI) or .sdat (SAGA) file; the header is beside it as .hdr or .sgrd."""
    saga = path.lower().endswith(".sdat")
    head = _text(spark, header_path or path.rsplit(".", 1)[0] + (".sgrd" if saga else ".hdr"))
    down = True
    if saga:
        meta, dtype, down = saga_header(head)
    else:
        meta, dtype = envi_header(head) if head.lstrip().upper().startswith("ENVI") else ehdr_header(head)
    ncols, nodata, last = meta.ncols, meta.nodata, meta.nrows - 1
    size = ncols * dtype.itemsize

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, raw in zip(b["at"], b["data"]):
                v = np.frombuffer(bytes(raw), dtype).astype(float)
                v[np.abs(v - nodata) < 1e-5] = np.nan
                row = at // size
                yield pd.DataFrame({"row": np.full(ncols, row if down else last - row, "int32"), "col": np.arange(ncols, dtype="int32"), "value": v})

    classes = ("org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable")
    records = spark.sparkContext.newAPIHadoopFile(path, *classes, conf={"fixedlengthinputformat.record.length": str(size)})  # one for each row, by its place in the file
    rows = spark.createDataFrame(records.map(lambda r: (int(r[0]), bytearray(r[1]))), "at long, data binary")
    cells = rows.mapInPandas(run, "row int, col int, value double")
    return cells.select("row", "col", F.nanvl("value", F.lit(None)).alias("value")), meta


def write(cells: DataFrame, meta: GridMeta, path: str, dtype: str = "<f4") -> None:
    """Writes a .bil, .bin or .sdat file and its header; tasks pack strips of rows, the driver streams them."""
    kind, ncols, nodata = np.dtype(dtype), meta.ncols, meta.nodata
    spark = cells.sparkSession
    strips, sizes, missing = strips_of(cells, meta, 64, lambda a: np.where(np.isnan(a), nodata, a).astype(dtype).tobytes())
    stream(spark, path, b"", strips, len(sizes), missing)
    order, number = (1 if kind.byteorder == ">" else 0), {v: k for k, v in ENVI_TYPES.items()}.get(kind.str[1:])
    beside = path.rsplit(".", 1)[0]
    if path.lower().endswith(".sdat"):
        if meta.dx != meta.dy:
            raise ValueError("this format has square cells only")
        form = {v: k for k, v in SAGA_TYPES.items()}[kind.str[1:]]
        head = f"NAME\t= {beside.rpartition('/')[2]}\nDATAFILE_OFFSET\t= 0\nDATAFORMAT\t= {form}\nBYTEORDER_BIG\t= {'TRUE' if order else 'FALSE'}\nPOSITION_XMIN\t= {meta.xleft + meta.dx / 2!r}\nPOSITION_YMIN\t= {meta.ytop - (meta.nrows - 0.5) * meta.dy!r}\nCELLCOUNT_X\t= {ncols}\nCELLCOUNT_Y\t= {meta.nrows}\nCELLSIZE\t= {meta.dx!r}\nZ_FACTOR\t= 1.0\nNODATA_VALUE\t= {nodata!r}\nTOPTOBOTTOM\t= TRUE\n"
        save(spark, f"{beside}.sgrd", head.encode())
        return
    if path.endswith(".bil"):
        pixel = {"f": "FLOAT", "i": "SIGNEDINT", "u": "UNSIGNEDINT"}[kind.kind]
        head = f"BYTEORDER {'M' if order else 'I'}\nLAYOUT BIL\nNROWS {meta.nrows}\nNCOLS {ncols}\nNBANDS 1\nNBITS {kind.itemsize * 8}\nPIXELTYPE {pixel}\nULXMAP {meta.xleft + meta.dx / 2}\nULYMAP {meta.ytop - meta.dy / 2}\nXDIM {meta.dx}\nYDIM {meta.dy}\nNODATA {nodata!r}\n"
    else:
        where = "Geographic Lat/Lon" if meta.geographic else "Arbitrary"
        head = f"ENVI\nsamples = {ncols}\nlines = {meta.nrows}\nbands = 1\nheader offset = 0\nfile type = ENVI Standard\ndata type = {number}\ninterleave = bsq\nbyte order = {order}\nmap info = {{{where}, 1, 1, {meta.xleft}, {meta.ytop}, {meta.dx}, {meta.dy}}}\ndata ignore value = {nodata!r}\n"
    save(spark, path.rsplit(".", 1)[0] + ".hdr", head.encode())

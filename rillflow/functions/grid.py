"""Grids as cell tables (row, col, values) and their geometry.

NULL is nodata.  Row 0 is the northern edge.  Cell sizes are constant, or come
from latitude per row for geographic grids.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The WGS84 ellipsoid (metres), nodata tolerance and output sentinels.
WGS84_A, WGS84_B = 6378137.0, 6356752.314
NODATA_TOLERANCE = 1e-5
OUTPUT_NODATA = {"short": -32768, "int": -2147483647, "float": -3.4028234663852886e38}
DEFAULT_NODATA = -9999.0
# D8 codes 1 to 8, anticlockwise from east, as (row, col) steps.
STEPS = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))
#: Order in which directions are tried: sides first, then diagonals.
TRY_ORDER = (1, 3, 5, 7, 2, 4, 6, 8)


class IncompatibleGrids(ValueError):
    pass


@dataclass(frozen=True)
class GridMeta:
    """Shape and georeference of a grid."""

    nrows: int
    ncols: int
    dx: float = 1.0
    dy: float = 1.0
    xleft: float = 0.0
    ytop: float = 0.0
    geographic: bool = False
    srs: str = ""
    nodata: float = DEFAULT_NODATA

    def assert_compatible(self, other: GridMeta) -> list[str]:
        """Raises unless shapes and cell sizes match; returns warnings about differing edges."""
        if (self.nrows, self.ncols) != (other.nrows, other.ncols):
            raise IncompatibleGrids(f"{self.nrows}x{self.ncols} cells and {other.nrows}x{other.ncols} cells")
        if abs(self.dx - other.dx) > 1e-4 or abs(self.dy - other.dy) > 1e-4:
            raise IncompatibleGrids(f"cell sizes {self.dx}, {self.dy} and {other.dx}, {other.dy}")
        return [f"{name} edges differ: {a} and {b}" for name, a, b in (("left", self.xleft, other.xleft), ("top", self.ytop, other.ytop)) if abs(a - b) > 1e-4]

    def row_sizes(self, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """dx and dy in metres (or the grid's unit) of count rows from first on."""
        if not self.geographic:
            return np.full(count, self.dx), np.full(count, self.dy)
        lat = np.radians(self.ytop - (np.arange(first, first + count) + 0.5) * self.dy)
        beta = np.arctan(WGS84_B / WGS84_A * np.tan(lat))
        return (
            WGS84_A * np.cos(beta) * math.radians(self.dx),
            math.radians(self.dy) * np.sqrt((WGS84_A * np.sin(beta)) ** 2 + (WGS84_B * np.cos(beta)) ** 2) * (WGS84_B / WGS84_A) / ((WGS84_B / WGS84_A * np.sin(lat)) ** 2 + np.cos(lat) ** 2),
        )

    def row_geometry(self, spark: SparkSession) -> DataFrame:
        """row, dx and dy of every row, from column expressions."""
        rows = spark.range(self.nrows).select(F.col("id").cast("int").alias("row"))
        if not self.geographic:
            return rows.select("row", F.lit(self.dx).alias("dx"), F.lit(self.dy).alias("dy"))
        lat = F.radians(F.lit(self.ytop) - (F.col("row") + 0.5) * self.dy)
        ratio = WGS84_B / WGS84_A
        beta = F.atan(F.lit(ratio) * F.tan(lat))
        arc = F.sqrt(F.pow(WGS84_A * F.sin(beta), 2) + F.pow(WGS84_B * F.cos(beta), 2))
        slant = F.lit(ratio) / (F.pow(F.lit(ratio) * F.sin(lat), 2) + F.pow(F.cos(lat), 2))
        return rows.select("row", (WGS84_A * F.cos(beta) * math.radians(self.dx)).alias("dx"), (math.radians(self.dy) * arc * slant).alias("dy"))

    def constant(self, spark: SparkSession, value: float | int | None, kind: str = "double") -> DataFrame:
        """A grid of this shape with one value."""
        cells = spark.range(self.nrows * self.ncols)
        return cells.select((F.col("id") / self.ncols).cast("int").alias("row"), F.pmod("id", F.lit(self.ncols)).cast("int").alias("col"), F.lit(value).cast(kind).alias("value"))

    def with_nodata(self, nodata: float) -> GridMeta:
        return replace(self, nodata=nodata)


def cell_of(x: Column, y: Column, meta: GridMeta, compat: bool = False) -> tuple[Column, Column]:
    """Row and col of a place; compat truncates toward zero instead of flooring."""
    col, row = (x - meta.xleft) / meta.dx, (F.lit(meta.ytop) - y) / meta.dy
    cut = (lambda v: v.cast("int")) if compat else (lambda v: F.floor(v).cast("int"))
    return cut(row), cut(col)


def place_of(row: Column, col: Column, meta: GridMeta) -> tuple[Column, Column]:
    """x and y of a cell's centre."""
    return F.lit(meta.xleft) + meta.dx / 2 + col * meta.dx, F.lit(meta.ytop) - meta.dy / 2 - row * meta.dy


def scanned(value: Column, nodata: float | None) -> Column:
    """value with nodata (within the tolerance; -9999 if the file names none) as NULL."""
    return F.when(F.abs(value - F.lit(DEFAULT_NODATA if nodata is None else nodata)) < NODATA_TOLERANCE, None).otherwise(value)


def joined(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Grids put together by cell."""
    for other in others:
        first = first.join(other, ["row", "col"])
    return first


def neighbours(cells: DataFrame, value: str = "value") -> DataFrame:
    """cells with n1 .. n8, the values of the eight neighbours (NULL outside the grid).

    Two windows (along rows, then along columns) instead of nine copies of each cell.
    """
    from pyspark.sql import Window

    across, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")

    def beside(c: str, shift: int, at: str, over) -> Column:
        move = F.lag if shift < 0 else F.lead
        return F.when(move(at, 1).over(over) == F.col(at) + shift, move(c, 1).over(over))

    out = cells.withColumns({"n5": beside(value, -1, "col", across), "n1": beside(value, 1, "col", across)})
    return out.withColumns({f"n{k}": beside(c, shift, "row", down) for k, c, shift in ((4, "n5", -1), (3, value, -1), (2, "n1", -1), (6, "n5", 1), (7, value, 1), (8, "n1", 1))})


def complete(meta: GridMeta) -> Column:
    """Whether a cell with n1 .. n8 is inside the grid and has no NULL neighbour."""
    edge = (F.col("row") > 0) & (F.col("col") > 0) & (F.col("row") < meta.nrows - 1) & (F.col("col") < meta.ncols - 1)
    for k in range(1, 9):
        edge = edge & F.col(f"n{k}").isNotNull()
    return edge


def step_length(k: Column, dx: Column | float = 1.0, dy: Column | float = 1.0) -> Column:
    """Length of a D8 step."""
    dx, dy = (v if isinstance(v, Column) else F.lit(float(v)) for v in (dx, dy))
    return F.when(k.isin(1, 5), dx).when(k.isin(3, 7), dy).when(k.isin(2, 4, 6, 8), F.sqrt(dx * dx + dy * dy))

"""Operators on single cells: column expressions over grids joined by cell.

Grids are cell tables (row, col, value); the result is one, too.  They are
built from built-in functions only, so they stay inside code generation, and
nothing shuffles where the inputs share a partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.grid import GridMeta, cell_of, neighbours
from .zonal import small


def _grid(df: DataFrame, name: str) -> DataFrame:
    return df.select("row", "col", F.col("value").alias(name))


def _both(**grids: DataFrame) -> DataFrame:
    (first, df), *rest = grids.items()
    out = _grid(df, first)
    for name, other in rest:
        out = out.join(_grid(other, name), ["row", "col"])
    return out


def _value(df: DataFrame, value: Column) -> DataFrame:
    return df.select("row", "col", value.alias("value"))


def threshold(ssa: DataFrame, limit: float = 100.0, mask: DataFrame | None = None) -> DataFrame:
    """1 where ssa reaches limit (and mask, if given, is not negative), else 0."""
    df = _both(ssa=ssa, mask=mask) if mask is not None else _both(ssa=ssa)
    hit = F.col("ssa") >= limit
    if mask is not None:
        hit = hit & (F.coalesce(F.col("mask"), F.lit(-1)) >= 0)
    return _value(df, F.when(F.col("ssa").isNotNull(), hit.cast("int")))


def slope_area(slope: DataFrame, area: DataFrame, m: float = 2.0, n: float = 1.0) -> DataFrame:
    """slope^m area^n where neither is negative."""
    return _value(_both(s=slope, a=area), F.when((F.col("s") >= 0) & (F.col("a") >= 0), F.pow("s", F.lit(m)) * F.pow("a", F.lit(n))))


def slope_area_ratio(slope: DataFrame, area: DataFrame) -> DataFrame:
    """slope / area."""
    return _value(_both(s=slope, a=area), F.when(F.col("a") != 0, F.col("s") / F.col("a")))


def wetness_index(slope: DataFrame, area: DataFrame) -> DataFrame:
    """ln(area / slope) where both are positive."""
    return _value(_both(s=slope, a=area), F.when((F.col("s") > 0) & (F.col("a") > 0), F.log(F.col("a") / F.col("s"))))


def length_area(length: DataFrame, area: DataFrame, m: float = 0.03, y: float = 1.3) -> DataFrame:
    """1 where area (a whole number) reaches m length^y, else 0."""
    hit = F.round("a").cast("int") >= F.lit(m) * F.pow("l", F.lit(y))
    return _value(_both(l=length, a=area), F.when((F.col("l") >= 0) & F.col("a").isNotNull(), hit.cast("int")))


def edit_raster(grid: DataFrame, edits: DataFrame, meta: GridMeta, compat: bool = False) -> DataFrame:
    """grid with the values that edits (line, x, y, value) put into cells; later lines win."""
    row, col = cell_of(F.col("x"), F.col("y"), meta, compat)
    last = edits.withColumns({"row": row, "col": col}).groupBy("row", "col").agg(F.max_by("value", "line").alias("edit"))
    return grid.join(last, ["row", "col"], "left").select("row", "col", F.coalesce(F.col("edit").cast("short"), F.col("value").cast("short")).alias("value"))


def set_region(direction: DataFrame, gage: DataFrame, region: int) -> DataFrame:
    """region where gage has a watershed, where direction is valid, or where a neighbour drains to; else NULL."""
    n = neighbours(_grid(direction, "p"), "p")
    fed = F.lit(False)
    for k in range(1, 9):
        fed = fed | F.coalesce(F.col(f"n{k}") == (k + 3) % 8 + 1, F.lit(False))
    df = n.select("row", "col", (F.col("p").isNotNull() | fed).alias("on")).join(_grid(gage, "g"), ["row", "col"])
    return _value(df, F.when((F.coalesce(F.col("g"), F.lit(0)) > 0) | F.col("on"), F.lit(region)))


def split_proportion(angle: Column, k: int, dx: Column | float = 1.0, dy: Column | float = 1.0) -> Column:
    """Share of the flow at angle (radians from east) that goes in direction k; NULL if under 1e-5."""
    dx, dy = (v if isinstance(v, Column) else F.lit(float(v)) for v in (dx, dy))
    t, pi = F.atan2(dy, dx), F.lit(PI)
    marks = [F.lit(0.0), t, pi / 2, pi - t, pi, pi + t, pi * 1.5, pi * 2 - t, pi * 2]
    lo = marks[k - 2] if k > 1 else t * -1
    mid, hi = marks[k - 1], marks[k]
    a = F.when(angle > pi, angle - pi * 2).otherwise(angle) if k == 1 else angle
    share = F.when((a > lo) & (a < hi), F.when(a > mid, (hi - a) / (hi - mid)).otherwise((a - lo) / (mid - lo)))
    return F.when((angle >= 0) & (share >= 1e-5), share)


# Fixed value: pi as the format's programs write it.
PI = 3.14159265359


def stability_index(slope: DataFrame, area: DataFrame, region: DataFrame, regions: DataFrame, rmin: float, rmax: float, g: float = 9.81, rhow: float = 1000.0, scamin: DataFrame | None = None, scamax: DataFrame | None = None) -> DataFrame:
    """si and sat of an infinite slope whose cohesion, friction and wetness are uniform within the cell's region.

    regions: id, tmin, tmax, cmin, cmax, phimin, phimax (degrees), density.  scamin and
    scamax add area of roads to the wetness bounds.
    """
    df = _both(s=slope, a=area, region=region)
    for name, extra in (("lo", scamin), ("hi", scamax)):
        df = df.join(_grid(extra, name), ["row", "col"], "left") if extra is not None else df.withColumn(name, F.lit(0.0))
    df = df.join(small(regions), df["region"] == regions["id"], "left")
    names = ["s", "a", "lo", "hi", "tmin", "tmax", "cmin", "cmax", "phimin", "phimax", "density"]

    def run(batches):
        for b in batches:
            columns = b[names].to_numpy(float, na_value=np.nan).T
            si, sat = np.full(len(b), np.nan), np.full(len(b), np.nan)
            for i in range(0, len(b), AT_ONCE):
                part = columns[:, i : i + AT_ONCE]
                at = np.flatnonzero(~np.isnan(part).any(0)) + i
                si[at], sat[at] = sinmap_cells(columns[:, at], rmin, rmax, g, rhow)
            yield pd.DataFrame({"row": b["row"], "col": b["col"], "si": si, "sat": sat})

    found = df.select("row", "col", *(F.col(c).cast("double").alias(c) for c in names)).mapInPandas(run, "row int, col int, si double, sat double")
    return found.select("row", "col", F.nanvl("si", F.lit(None)).alias("si"), F.nanvl("sat", F.lit(None)).alias("sat"))


#: Cells that are integrated at a time.
AT_ONCE = 2000


def sinmap_cells(columns: np.ndarray, rmin: float, rmax: float, g: float, rhow: float) -> tuple[np.ndarray, np.ndarray]:
    """Stability index and saturation class of cells, by rows slope, area, lo, hi, tmin, tmax, cmin, cmax, phimin, phimax, density.

    With FS = (C + cos(theta) (1 - w r) T) / sin(theta), C, T = tan(phi) and w
    uniform and w cut at 1: FS of the worst case if that is over 1, else the
    probability of FS > 1.
    """
    slope, area, lo, hi, tmin, tmax, c1, c2, phimin, phimax, density = columns
    si, sat = np.full(len(slope), np.nan), np.full(len(slope), np.nan)
    si[slope == 0], sat[slope == 0] = 10.0, 3.0
    on = np.flatnonzero((slope > 0) & (area >= 0))
    slope, area, lo, hi, tmin, tmax, c1, c2, phimin, phimax, density = columns[:, on]
    theta, r = np.arctan(slope), rhow / density
    need, cosine = np.sin(theta), np.cos(theta)
    w1, w2 = (area * rmin + lo) / tmax / need, (area * rmax + hi) / tmin / need
    t1, t2 = np.tan(np.radians(phimin)), np.tan(np.radians(phimax))

    def fs(w: np.ndarray, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (c + cosine * (1 - np.minimum(w, 1.0) * r) * t) / need

    worst = fs(w2, c1, t1)
    found = np.where(fs(w1, c2, t2) < 1, 0.0, np.minimum(worst, 10.0))
    mixed = np.flatnonzero((fs(w1, c2, t2) >= 1) & (worst < 1))
    found[mixed] = 1.0 - _probability_below(*(v[mixed] for v in (need, cosine, r, w1, w2, c1, c2, t1, t2)))
    si[on], sat[on] = found, np.where(w1 > 1, 3.0, np.where(w2 > 1, 2.0, w2))
    return si, sat


def _probability_below(need: np.ndarray, cosine: np.ndarray, r: np.ndarray, w1: np.ndarray, w2: np.ndarray, c1: np.ndarray, c2: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
    """P(C + cosine (1 - min(w, 1) r) T < need) for independent uniform C, T and w.

    Given w the sum of two uniforms is piecewise quadratic; over w it is integrated
    by Gauss-Legendre between the points where the pieces change.
    """

    def given(k: np.ndarray) -> np.ndarray:
        """P(C + k T < need), k with the cells as first axis."""
        wide = (-1,) + (1,) * (k.ndim - 1)
        n, lo, hi, low, high = (v.reshape(wide) for v in (need, c1, c2, t1, t2))
        a, b = np.minimum(k * low, k * high), np.maximum(k * low, k * high)
        width, reach = hi - lo, b - a
        narrow = np.clip(np.where(reach > 1e-12, (n - lo - a) / np.maximum(reach, 1e-300), (n - lo > a) * 1.0), 0, 1)

        def area(x: np.ndarray) -> np.ndarray:
            return 0.5 * np.clip(x, 0, width) ** 2 / np.maximum(width, 1e-300) + np.maximum(x - width, 0)

        thin = np.clip((n - a - lo) / np.maximum(width, 1e-300), 0, 1)
        both = np.clip((area(n - lo - a) - area(n - lo - b)) / np.maximum(reach, 1e-300), 0, 1)
        return np.where(width < 1e-12, narrow, np.where(reach < 1e-12, thin, both))

    whole = given(cosine * (1 - r))
    top = np.minimum(w2, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        marks = [(1 - (need - c) / (cosine * t)) / r for c in (c1, c2) for t in (t1, t2)]
    edges = np.sort(np.stack([w1, np.maximum(top, w1), *(np.clip(np.where(np.isfinite(m), m, w1), w1, np.maximum(top, w1)) for m in marks)], 1), 1)
    x, weight = np.polynomial.legendre.leggauss(24)
    half, centre = np.diff(edges, axis=1) / 2, (edges[:, 1:] + edges[:, :-1]) / 2
    w = half[:, :, None] * x + centre[:, :, None]
    total = (given(cosine[:, None, None] * (1 - w * r[:, None, None])) * weight).sum(2) * half
    spread = (total.sum(1) + np.maximum(w2 - 1.0, 0.0) * whole) / np.maximum(w2 - w1, 1e-300)
    return np.where(w1 >= 1, whole, np.where(w2 - w1 < 1e-12, given(cosine * (1 - w1 * r)), spread))

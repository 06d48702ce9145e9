"""Compositions of operators: stream definitions and limited accumulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.grid import GridMeta
from ..operators import direction, flow, local, network


def _defined(ssa: DataFrame, limit: float | None, drops: DataFrame | None) -> DataFrame:
    """Stream cells at the given threshold, or at the optimum of a drop analysis (the largest one tried if none qualifies)."""
    if drops is None:
        return local.threshold(ssa, limit)
    best = drops.agg(F.coalesce(F.min(F.when(F.abs("t") < 2, F.col("threshold"))), F.max("threshold"), F.lit(limit)).alias("limit"))
    return ssa.crossJoin(F.broadcast(best)).select("row", "col", F.when(F.col("value").isNotNull(), (F.col("value") >= F.col("limit")).cast("int")).alias("value"))


def drop_stream(p: DataFrame, dem: DataFrame, ssa: DataFrame, area: DataFrame, outlets: DataFrame, meta: GridMeta, low: float, high: float, count: int = 10, logarithmic: bool = True) -> DataFrame:
    """Streams where ssa reaches the drop analysis' optimum threshold."""
    drops = network.drop_statistics(p, dem, ssa, area, outlets, meta, network.drop_thresholds(low, high, count, logarithmic))
    return _defined(ssa, high, drops)


def valley_stream(dem: DataFrame, p: DataFrame, meta: GridMeta, limit: float = 50.0, outlets: DataFrame | None = None, area: DataFrame | None = None, weights: tuple[float, float, float] = (0.4, 0.1, 0.05), drop: tuple[float, float, int] = (5, 500, 10)) -> DataFrame:
    """Streams where enough valley cells drain through; with outlets and area the threshold is the drop analysis' optimum."""
    ssa = flow.area_d8(p, meta, direction.peuker_douglas(dem, meta, *weights), outlets, check=False)
    drops = network.drop_statistics(p, dem, ssa, area, outlets, meta, network.drop_thresholds(*drop)) if outlets is not None and area is not None else None
    return _defined(ssa, limit, drops)


def slope_area_stream(slope: DataFrame, sca: DataFrame, p: DataFrame, meta: GridMeta, limit: float, dem: DataFrame | None = None, area: DataFrame | None = None, outlets: DataFrame | None = None, m: float = 2.0, n: float = 1.0, drop: tuple[float, float, int] = (5, 500, 10)) -> DataFrame:
    """Streams where the largest slope-area product upstream reaches a threshold."""
    ssa = flow.extreme_up(p, local.slope_area(slope, sca, m, n), meta, outlets=outlets, check=False)
    drops = network.drop_statistics(p, dem, ssa, area, outlets, meta, network.drop_thresholds(*drop)) if outlets is not None and area is not None else None
    return _defined(ssa, limit, drops)


def conc_limited(ang: DataFrame, weight: DataFrame, decay: DataFrame, indicator: DataFrame, meta: GridMeta, threshold: float = 1.0, check: bool = True) -> DataFrame:
    """Concentration limited accumulation over the specific discharge of weight."""
    discharge = flow.area_dinf(ang, meta, weight, check=check)
    return flow.conc_lim_accum(ang, decay, discharge, indicator, meta, threshold, check=check)


def stability(slope: DataFrame, ang: DataFrame, regions: DataFrame, calibration: DataFrame, meta: GridMeta, rmin: float, rmax: float, road_min: DataFrame | None = None, road_max: DataFrame | None = None, g: float = 9.81, rhow: float = 1000.0) -> DataFrame:
    """Stability index from slope and the specific catchment area of ang, with optional weights of roads."""
    sca = flow.area_dinf(ang, meta, check=False)
    lo = flow.area_dinf(ang, meta, road_min, check=False) if road_min is not None else None
    hi = flow.area_dinf(ang, meta, road_max, check=False) if road_max is not None else None
    return local.stability_index(slope, sca, regions, calibration, rmin, rmax, g, rhow, lo, hi)

"""D8 paths: the cell that each cell drains to, and where each cell's path goes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.grid import STEPS, GridMeta
from ..operators.flow import Flow
from .tiles import TILE, Near, Patch


def receivers(p: DataFrame, meta: GridMeta) -> DataFrame:
    """row, col, r, c, d, ok: the cell each cell (direction not NULL) drains to and the step's length; ok: it has a direction, too."""
    k = F.col("value").cast("int")
    pick = lambda i: F.element_at(F.array(*(F.lit(s[i]) for s in STEPS)), k)
    length = F.when(k.isin(1, 5), meta.dx).when(k.isin(3, 7), meta.dy).otherwise((meta.dx**2 + meta.dy**2) ** 0.5)
    inside = p.where("value is not null")
    to = inside.where("value between 1 and 8").select("row", "col", (F.col("row") + pick(0)).alias("r"), (F.col("col") + pick(1)).alias("c"), length.alias("d"))
    valid = inside.select(F.col("row").alias("r"), F.col("col").alias("c"), F.lit(True).alias("ok"))
    return to.join(valid, ["r", "c"], "left").select("row", "col", "r", "c", "d", F.coalesce("ok", F.lit(False)).alias("ok"))


def follow(p: DataFrame, meta: GridMeta, stop: DataFrame, most: int | None = None, size: int = TILE) -> DataFrame:
    """row, col, r, c, dist, hops and stopped of each cell with a direction: the first cell of stop (row, col) on its path.

    A cell of stop stops at once; a path without one ends at its last cell with a
    direction (stopped false).  most bounds the hops.  One evaluation from the paths' ends upward.
    """
    cells = p.select("row", "col", F.col("value").cast("double").alias("p")).join(stop.select("row", "col").distinct().withColumn("stop", F.lit(1.0)), ["row", "col"], "left")
    names = ["r", "c", "dist", "hops", "stopped"]

    def ends(q: Patch, at: np.ndarray, stopped: float) -> tuple:
        zero = np.zeros(len(at))
        return at // q.width + q.row0 - 1.0, at % q.width + q.col0 - 1.0, zero, zero, zero + stopped

    def seeds(q: Patch, s: dict) -> np.ndarray:
        on = q.inside & (q["stop"] == 1) & ~np.isnan(q["p"])
        at = np.flatnonzero(on)
        for n, v in zip(names, ends(q, at, 1.0)):
            s[n][at] = v
        return on

    def step(q: Patch, s: dict, at: np.ndarray, near: Near) -> None:
        k, n = (near.w > 0).argmax(axis=0), np.arange(len(at))
        j = near.j[k, n]
        goes = (near.w[k, n] > 0) & ~np.isnan(s["r"][j])
        more = (0.0, 0.0, q.lengths(at)[k, n], 1.0, 0.0)
        for name, m, v in zip(names, more, ends(q, at, 0.0)):
            s[name][at] = np.where(goes, s[name][j] + m, v)

    found = Flow(cells, meta, "p", upstream=False, size=size).run(names, step, seeds=seeds).where("r >= 0 AND NOT isnan(r)")
    stopped = F.col("stopped") == 1
    if most is not None:
        stopped = stopped & (F.col("hops") <= most)
    return found.select("row", "col", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "dist", F.col("hops").cast("int").alias("hops"), stopped.alias("stopped"))

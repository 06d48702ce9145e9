"""Flow directions: depressions, D8, D-infinity, flats, and valley cells.

Stencils are windows along rows and columns; what spreads over the grid (fill,
flats) is solved tile by tile with exchanged rims.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.grid import TRY_ORDER, GridMeta, complete, neighbours, step_length
from ..plans.tiles import TILE, Patch, checkpointed, solve

# Fixed values of the eight facets: side and diagonal neighbour, which cell size comes first, base and sign of the angle.
FACETS = ((1, 2, "xy", 0, 1), (3, 2, "yx", 1, -1), (3, 4, "yx", 1, 1), (5, 4, "xy", 2, -1), (5, 6, "xy", 2, 1), (7, 6, "yx", 3, -1), (7, 8, "yx", 3, 1), (1, 8, "xy", 4, -1))
#: Directions of neighbours whose flow a diagonal step would cross: {k: ((neighbour, its direction), ...)}.
CROSSING = {2: ((1, 4), (3, 8)), 4: ((3, 6), (5, 2)), 6: ((7, 4), (5, 8)), 8: ((1, 6), (7, 2))}


def fill_pits(dem: DataFrame, meta: GridMeta, four_way: bool = False, kept: DataFrame | None = None, size: int = TILE) -> DataFrame:
    """dem raised so that every cell drains over its neighbours to the edge, to NULL, or to a kept depression.

    The level of a cell is the least, over paths to such an outlet, of the path's highest cell.
    """
    steps = (1, 3, 5, 7) if four_way else range(1, 9)
    masked = kept is not None
    cells = dem.select("row", "col", F.col("value").alias("z"))
    if kept is not None:
        cells = cells.join(kept.select("row", "col", F.col("value").alias("kept")), ["row", "col"], "left")

    def kernel(p: Patch) -> dict[str, np.ndarray]:
        z = p["z"]
        valid = p.exists & ~np.isnan(z)
        if "level" not in p.memo:
            outlet = np.zeros(len(z), bool)
            for k in steps:
                outlet |= ~p.shifted(valid, k, False)
            # the grid's edge is an outlet in either mode
            at = np.arange(len(z))
            row, col = at // p.width + p.row0 - 1, at % p.width + p.col0 - 1
            outlet |= (row == 0) | (col == 0) | (row == meta.nrows - 1) | (col == meta.ncols - 1)
            if masked:
                outlet |= p["kept"] == 1
            p.memo["level"] = np.where(valid & outlet & p.inside, z, np.inf)
            start = p.memo["level"] < np.inf
        else:
            start = np.zeros(len(z), bool)
        # levels only fall, so a later run goes on from the cells of the rim that are lower
        level, rim = p.memo["level"], p.rim["w"]
        lower = ~p.inside & (rim < level)
        level[lower] = rim[lower]
        _flood(p, z, valid, level, steps, np.flatnonzero(start | lower))
        return {"w": np.where(valid & p.inside & np.isfinite(level), level, np.where(valid & p.inside, np.inf, np.nan))}

    return solve(cells, meta, kernel, ["w"], ["w"], size).select("row", "col", F.col("w").alias("value"))


def _flood(p: Patch, z: np.ndarray, valid: np.ndarray, level: np.ndarray, steps, start: np.ndarray) -> None:
    """Priority flood from start in place: level becomes max(z, least neighbouring level) where that is lower."""
    import heapq

    if not len(start):
        return
    heap = list(zip(level[start].tolist(), start.tolist()))
    heapq.heapify(heap)
    offsets = [p.offsets[k - 1] for k in steps]
    open_cell = (valid & p.inside).tolist()
    ground, now, done = z.tolist(), level.tolist(), [False] * len(z)
    while heap:
        w, i = heapq.heappop(heap)
        if done[i] or w > now[i]:
            continue
        done[i] = True
        for off in offsets:
            j = i + off
            if 0 <= j < len(now) and open_cell[j] and not done[j]:
                to = ground[j] if ground[j] > w else w
                if to < now[j]:
                    now[j] = to
                    heapq.heappush(heap, (to, j))
    level[:] = now


def d8_first(dem: DataFrame, meta: GridMeta) -> DataFrame:
    """row, col, p and slope: steepest descent, 0 where there is none, NULL (slope too) at edges and next to NULL.

    Sides are tried before diagonals and a later direction must be steeper.
    """
    n = neighbours(dem.select("row", "col", F.col("value").alias("z")), "z")
    dx, dy = F.lit(float(meta.dx)), F.lit(float(meta.dy))
    if meta.geographic:
        n = n.join(F.broadcast(meta.row_geometry(dem.sparkSession)), "row")
        dx, dy = F.col("dx"), F.col("dy")
    best, slope = F.lit(0), F.lit(0.0)
    n = n.withColumns({f"s{k}": (F.col("z") - F.col(f"n{k}")) / step_length(F.lit(k), dx, dy) for k in TRY_ORDER})
    top = F.greatest(F.lit(0.0), *(F.col(f"s{k}") for k in TRY_ORDER))
    for k in reversed(TRY_ORDER):
        best = F.when((F.col(f"s{k}") == F.col("top")) & (F.col("top") > 0), k).otherwise(best)
    ok = F.col("z").isNotNull() & complete(meta)
    return n.withColumn("top", top).select("row", "col", F.when(ok, best).alias("p"), F.when(ok, F.col("top")).alias("slope"))


def d8_direction(dem: DataFrame, meta: GridMeta, size: int = TILE) -> DataFrame:
    """row, col, p and slope with flats resolved; slope is that of the first pass (0 in flats)."""
    first = checkpointed(d8_first(dem, meta))
    cells = dem.select("row", "col", F.col("value").alias("z")).join(first, ["row", "col"])
    flats = first.where("p = 0").count()
    while flats:
        cells, left = _d8_flat_round(cells, meta, size)
        if not left or left >= flats:
            break
        flats = left
    return cells.select("row", "col", F.col("p").cast("int").alias("p"), "slope") if flats or "e" in cells.columns else first


def _noncrossing(p: Patch, direction: np.ndarray, k: int) -> np.ndarray:
    ok = np.ones(len(direction), bool)
    for n, d in CROSSING.get(k, ()):
        ok &= p.shifted(direction, n) != d
    return ok


def _fronts(p: Patch, start: np.ndarray, allowed: list[np.ndarray]) -> np.ndarray:
    """Least number of steps from start (values, inf elsewhere); allowed[k]: whether a cell may take its value from direction k + 1."""
    best = start.copy()
    while True:
        new = best.copy()
        for k in range(1, 9):
            new = np.where(allowed[k - 1], np.minimum(new, p.shifted(best, k, np.inf) + 1), new)
        if np.array_equal(new, best):
            return best
        best = new


def flat_steps(cells: DataFrame, meta: GridMeta, flat: float, size: int) -> DataFrame:
    """row, col, a (passes a flat cell is raised toward lower ground; inf in pits) and b (sweep in which higher ground reaches it)."""

    def kernel(p: Patch) -> dict[str, np.ndarray]:
        z, d = p["z"], p["p"]
        is_flat = p.exists & (d == flat)
        drains = p.exists & ~np.isnan(d) & (d > 0) if flat == 0 else p.exists & ~np.isnan(d) & (d >= 0)
        own = np.where(is_flat & p.inside, np.inf, np.nan)
        a, ways, reach, marked = own.copy(), [], [], np.zeros(len(z), bool)
        for k in range(1, 9):
            nz = p.shifted(z, k)
            free = _noncrossing(p, d, k) if flat == 0 else np.ones(len(z), bool)
            a = np.where(is_flat & p.inside & free & (z >= nz) & p.shifted(drains, k, False), 0.0, a)
            level = is_flat & p.inside & free & (z == nz)
            ways.append(level & p.shifted(is_flat, k, False))
            # a neighbour without a direction at the same height is never raised
            a = np.where(level & ~p.shifted(is_flat | drains, k, False), np.minimum(a, 1.0), a)
            marked |= is_flat & p.inside & (nz > z)
            reach.append(is_flat & p.inside & p.shifted(is_flat, k, False))
        rim = {n: np.where(~p.inside & ~np.isnan(p.rim[n]), p.rim[n], np.inf) for n in ("a", "b")}
        a = _fronts(p, np.where(p.inside, np.where(is_flat, a, np.inf), rim["a"]), ways)
        b = _fronts(p, np.where(p.inside, np.where(marked, 1.0, np.inf), rim["b"]), reach)
        inner = is_flat & p.inside
        return {"a": np.where(inner, a, np.nan), "b": np.where(inner, b, np.nan)}

    return solve(cells.select("row", "col", "z", "p"), meta, kernel, ["a", "b"], ["a", "b"], size)


def _raised(cells: DataFrame, meta: GridMeta, flat: float, size: int) -> DataFrame:
    """cells with a, b and e, the artificial height of all cells (1 outside flats)."""
    steps = checkpointed(flat_steps(cells, meta, flat, size))
    inf = float("inf")
    last = steps.agg(F.max(F.when(F.col("a") < inf, F.col("a"))), F.max(F.when(F.col("b") < inf, F.col("b")))).first()
    pit, sweeps = float(last[0] or 0) + 2, float(last[1] or 0) + 1
    up = F.when(F.col("a") < inf, F.col("a")).otherwise(F.lit(pit))
    away = F.when(F.col("b") < inf, sweeps - F.col("b") + 1).otherwise(0.0)
    return cells.join(steps, ["row", "col"]).withColumn("e", F.when(F.col("a").isNotNull(), 1.0 + up + away).otherwise(1.0))


def _d8_flat_round(cells: DataFrame, meta: GridMeta, size: int) -> tuple[DataFrame, int]:
    grown = _raised(cells.select("row", "col", "z", "p", "slope"), meta, 0, size)

    def kernel(p: Patch) -> dict[str, np.ndarray]:
        z, e, d = p["z"], p["e"], p["p"]
        flat, inside = p.exists & (d == 0), p.inside
        in_flat = flat & np.isfinite(p["b"])
        best, out, steep = np.where(np.isinf(p["a"]), np.nan, 0.0), np.zeros(len(z), bool), np.zeros(len(z))
        for k in TRY_ORDER:
            rim = p.shifted(in_flat, k, False)
            slope = (e - p.shifted(e, k)) / p.length(k)
            better = flat & ~out & rim & (slope > steep)
            leave = flat & ~out & ~rim & (z - p.shifted(z, k) >= 0)
            best = np.where(better | leave, k, best)
            steep = np.where(better, slope, steep)
            out |= leave
        return {"q": np.where(flat, best, d), "ok": inside * 1.0}

    done = solve(grown.select("row", "col", "z", "p", "a", "b", "e"), meta, kernel, ["q"], [], size)
    merged = checkpointed(grown.select("row", "col", "z", "slope", "e").join(done, ["row", "col"]).withColumnRenamed("q", "p"))
    left = merged.where("p = 0").count()
    z = F.when(F.col("z").isNotNull(), F.col("e")) if left else F.col("z")
    return merged.withColumn("z", z), left


def dinf_first(dem: DataFrame, meta: GridMeta) -> DataFrame:
    """row, col, ang and slope of the steepest of eight facets; -1 and 0 where there is none."""
    n = neighbours(dem.select("row", "col", F.col("value").alias("z")), "z")
    dx, dy = F.lit(float(meta.dx)), F.lit(float(meta.dy))
    if meta.geographic:
        n = n.join(F.broadcast(meta.row_geometry(dem.sparkSession)), "row")
        dx, dy = F.col("dx"), F.col("dy")
    cols = {}
    for i, (e1, e2, kind, base, sign) in enumerate(FACETS, 1):
        d1, d2 = (dx, dy) if kind == "xy" else (dy, dx)
        slope, angle = facet(F.col("z"), F.col(f"n{e1}"), F.col(f"n{e2}"), d1, d2)
        cols[f"s{i}"], cols[f"g{i}"] = slope, base * PI / 2 + sign * angle
    n = n.withColumns(cols)
    top = F.greatest(F.lit(0.0), *(F.col(f"s{i}") for i in range(1, 9)))
    angle: Column = F.lit(-1.0)
    for i in range(8, 0, -1):
        angle = F.when((F.col(f"s{i}") == F.col("top")) & (F.col("top") > 0), F.col(f"g{i}")).otherwise(angle)
    ok = F.col("z").isNotNull() & complete(meta)
    return n.withColumn("top", top).select("row", "col", F.when(ok, angle).alias("ang"), F.when(ok, F.col("top")).alias("slope"))


# Fixed value: pi as the format's programs write it.
PI = 3.14159265359


def facet(e0: Column, e1: Column, e2: Column, d1: Column, d2: Column) -> tuple[Column, Column]:
    """Slope and angle (from the side's direction) of steepest descent on one triangular facet."""
    s1, s2 = (e0 - e1) / d1, (e1 - e2) / d2
    a = F.when((s1 == 0) & (s2 == 0), 0.0).otherwise(F.atan2(s2, s1))
    most = F.atan2(d2, d1)
    slope = F.when(a < 0, s1).when(a > most, (e0 - e2) / F.sqrt(d1 * d1 + d2 * d2)).otherwise(F.sqrt(s1 * s1 + s2 * s2))
    return slope, F.when(a < 0, 0.0).when(a > most, most).otherwise(a)


def dinf_direction(dem: DataFrame, meta: GridMeta, size: int = TILE) -> DataFrame:
    """row, col, ang and slope with flats resolved."""
    first = checkpointed(dinf_first(dem, meta))
    flats = first.where("ang = -1").count()
    if not flats:
        return first
    cells = dem.select("row", "col", F.col("value").alias("z")).join(first, ["row", "col"]).withColumnRenamed("ang", "p")
    while flats:
        cells, left = _dinf_flat_round(cells, meta, size)
        if not left or left >= flats:
            break
        flats = left
    return cells.select("row", "col", F.col("p").alias("ang"), "slope")


def _np_facet(e0, e1, e2, d1, d2):
    s1, s2 = (e0 - e1) / d1, (e1 - e2) / d2
    a = np.where((s1 == 0) & (s2 == 0), 0.0, np.arctan2(s2, s1))
    most = np.arctan2(d2, d1)
    slope = np.where(a < 0, s1, np.where(a > most, (e0 - e2) / np.hypot(d1, d2), np.hypot(s1, s2)))
    return slope, np.where(a < 0, 0.0, np.where(a > most, most, a))


def _dinf_flat_round(cells: DataFrame, meta: GridMeta, size: int) -> tuple[DataFrame, int]:
    grown = _raised(cells.select("row", "col", "z", "p", "slope"), meta, -1, size)

    def kernel(p: Patch) -> dict[str, np.ndarray]:
        z, e, d = p["z"], p["e"], p["p"]
        flat = p.exists & (d == -1)
        in_flat = flat & np.isfinite(p["b"])
        n = len(z)
        angle, steep = np.where(np.isinf(p["a"]), np.nan, -1.0), np.zeros(n)
        ended, diagonal = np.zeros(n, bool), np.zeros(n, bool)
        chosen = np.full(n, np.nan)
        for k1, k2, kind, base, sign in FACETS:
            d1, d2 = (p.dx, p.dy) if kind == "xy" else (p.dy, p.dx)
            in1, in2 = p.shifted(in_flat, k1, False), p.shifted(in_flat, k2, False)
            z1, z2, e1, e2 = p.shifted(z, k1), p.shifted(z, k2), p.shifted(e, k1), p.shifted(e, k2)
            turned = lambda a: base * PI / 2 + sign * a
            live = flat & ~ended
            s, a = _np_facet(z, z1, z2, d1, d2)
            out = live & ~in1 & ~in2 & (s >= 0)
            far = out & (z1 > z) & ~diagonal
            near = out & ~(z1 > z)
            edge = live & ~in1 & in2 & (z >= z1)
            corner = live & in1 & ~in2 & (z >= z2)
            first_corner = corner & ~diagonal
            h1 = np.where(in1, e1, np.maximum(e, e2))
            h2 = np.where(in2, e2, np.maximum(e, e1))
            s2, a2 = _np_facet(e, h1, h2, d1, d2)
            climb = live & (in1 | in2) & ~edge & ~corner & (s2 > steep)
            chosen = np.where(far | near, turned(a), chosen)
            chosen = np.where(edge, turned(np.zeros(n)), chosen)
            chosen = np.where(first_corner, turned(np.arctan2(d2, d1)), chosen)
            chosen = np.where(climb, turned(a2), chosen)
            steep = np.where(climb, s2, steep)
            diagonal |= far | first_corner
            ended |= near | edge
        found = flat & ~np.isnan(chosen) & (chosen >= 0)
        return {"q": np.where(found, chosen, np.where(flat, angle, d))}

    done = solve(grown.select("row", "col", "z", "p", "a", "b", "e"), meta, kernel, ["q"], [], size)
    merged = checkpointed(grown.select("row", "col", "z", "slope", "e").join(done, ["row", "col"]).withColumnRenamed("q", "p"))
    left = merged.where("p = -1").count()
    return merged.withColumn("z", F.when(F.col("z").isNotNull(), F.col("e")) if left else F.col("z")), left


def peuker_douglas(dem: DataFrame, meta: GridMeta, centre: float = 0.4, side: float = 0.1, diagonal: float = 0.05) -> DataFrame:
    """1 on valley cells: smoothed heights, then in each block of 2 by 2 cells the highest is no valley.

    Blocks with a NULL or outside cell (but for their first cell) and cells equal to the highest are cleared, too.
    """
    n = neighbours(dem.select("row", "col", F.col("value").alias("z")), "z")
    total, weight = F.col("z") * centre, F.lit(centre)
    for k in range(1, 9):
        w = side if k % 2 else diagonal
        if w > 0:
            total = total + F.coalesce(F.col(f"n{k}") * w, F.lit(0.0))
            weight = weight + F.when(F.col(f"n{k}").isNotNull(), w).otherwise(0.0)
    inner = (F.col("row") > 0) & (F.col("col") > 0) & (F.col("row") < meta.nrows - 1) & (F.col("col") < meta.ncols - 1)
    smooth = n.select("row", "col", F.when(F.col("z").isNotNull(), F.when(inner, F.round(total / weight, 9)).otherwise(F.col("z"))).alias("v"))
    s = neighbours(smooth, "v")
    start = F.when((inner) & F.col("v").isNotNull(), 1).otherwise(0)
    cleared: Column = F.lit(False)
    # the four blocks that hold the cell: (first cell, the three others), as neighbour numbers, 0 the cell itself
    for first, others in ((0, (1, 7, 8)), (5, (0, 6, 7)), (3, (2, 0, 1)), (4, (3, 5, 0))):
        at = lambda k: F.col("v") if k == 0 else F.col(f"n{k}")
        gap: Column = F.lit(False)
        for k in others:
            gap = gap | at(k).isNull()
        highest = F.greatest(at(first), *(at(k) for k in others))
        block = gap | (F.col("v") >= highest)
        cleared = cleared | F.coalesce(block, F.lit(False))
    return s.select("row", "col", F.when(F.col("v").isNull() | cleared, 0).otherwise(start).alias("value"))

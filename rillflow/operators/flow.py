"""Flow algebra: recurrences along D8 and D-infinity flow.

Each operator is a step for one front of cells whose sources are known, run by
`plans.tiles.solve` tile by tile.  Upstream operators take a cell's donors as
sources, downstream ones its receivers.  Grids are cell tables (row, col,
value); NULL is nodata.  With outlets only cells upstream of them are evaluated.

`check` (on where the operator has it) makes cells NULL that have a NULL or
outside neighbour, or a donor that is so (edge contamination).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.grid import STEPS, GridMeta
from ..plans.tiles import TILE, Near, Patch, solve, sweep
from .local import PI

Sources = list[np.ndarray]


def _cells(**grids: DataFrame | None) -> DataFrame:
    out = None
    for name, g in grids.items():
        if g is not None:
            one = g.select("row", "col", F.col("value").cast("double").alias(name))
            out = one if out is None else out.join(one, ["row", "col"], "left")
    return out


def donors_d8(p: Patch, name: str = "p") -> Sources:
    """1 for each neighbour that drains into a cell."""
    return [np.where(p.shifted(p[name], k) == (k + 3) % 8 + 1, 1.0, 0.0) for k in range(1, 9)]


def receivers_d8(p: Patch, name: str = "p") -> Sources:
    return [np.where(p[name] == k, 1.0, 0.0) for k in range(1, 9)]


def shares(angle: np.ndarray, k: int, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """Share of the flow at angle that goes in direction k, 0 if under 1e-5."""
    t = np.arctan2(dy, dx)
    zero = np.zeros_like(t)
    marks = [zero, t, zero + PI / 2, PI - t, zero + PI, PI + t, zero + 1.5 * PI, 2 * PI - t, zero + 2 * PI]
    lo, mid, hi = (marks[k - 2] if k > 1 else -t), marks[k - 1], marks[k]
    a = np.where(angle > PI, angle - 2 * PI, angle) if k == 1 else angle
    with np.errstate(invalid="ignore"):
        share = np.where((a > lo) & (a < hi), np.where(a > mid, (hi - a) / (hi - mid), (a - lo) / (mid - lo)), 0.0)
        return np.where((angle >= 0) & (share >= 1e-5), share, 0.0)


def donors_dinf(p: Patch, name: str = "ang") -> Sources:
    out = []
    for k in range(1, 9):
        given = shares(p[name], (k + 3) % 8 + 1, p.dx, p.dy)  # by a cell toward the one it would be a donor of
        out.append(p.shifted(given, k, 0.0))
    return out


def receivers_dinf(p: Patch, name: str = "ang") -> Sources:
    return [shares(p[name], k, p.dx, p.dy) for k in range(1, 9)]


def upstream_of(cells: DataFrame, outlets: DataFrame | None, meta: GridMeta, receivers: Callable[[Patch], Sources], direction: str, size: int) -> DataFrame:
    """cells with use: 1 where flow reaches one of outlets (row, col) that has a direction; cells as they are without outlets."""
    if outlets is None:
        return cells
    marked = cells.join(outlets.select("row", "col").distinct().withColumn("outlet", F.lit(1.0)), ["row", "col"], "left")

    def kernel(p: Patch) -> dict[str, np.ndarray]:
        to = receivers(p)
        use = np.where(p.inside, np.where((p["outlet"] == 1) & ~np.isnan(p[direction]), 1.0, 0.0), np.nan)
        use = np.where(~p.inside, p.rim["use"], use)
        return {"use": _spread(p, use, to)}

    found = solve(marked, meta, kernel, ["use"], ["use"], size)
    return cells.join(found, ["row", "col"])


def _spread(p: Patch, use: np.ndarray, to: Sources) -> np.ndarray:
    """use with 1 on all cells that have a source which is 1, front by front."""
    front = np.flatnonzero(use == 1)
    while len(front):
        nxt = []
        for k, off in enumerate(p.offsets):
            at = front - off
            at = at[(at >= 0) & (at < len(use))]
            nxt.append(at[p.inside[at] & (to[k][at] > 0) & (use[at] != 1)])
        front = np.unique(np.concatenate(nxt))
        use[front] = 1.0
    return use


class Flow:
    """One operator over a flow graph.

    start(patch) may prepare; step(patch, state, cells, near) sets state[name][cells]
    from near, (source, weight) for each of the eight directions.
    """

    def __init__(self, cells: DataFrame, meta: GridMeta, direction: str, upstream: bool = True, outlets: DataFrame | None = None, check: bool = False, all_linked: bool = True, size: int = TILE):
        d8 = direction == "p"
        self.meta, self.direction, self.upstream, self.check, self.size, self.all_linked = meta, direction, upstream, check, size, all_linked
        self.donors, self.receivers = (donors_d8, receivers_d8) if d8 else (donors_dinf, receivers_dinf)
        self.cells = upstream_of(cells, outlets, meta, self.receivers, direction, size)

    def run(self, outputs: list[str], step: Callable[[Patch, dict[str, np.ndarray], np.ndarray, Near], None], links: Callable[[Patch, Sources], Sources] | None = None, seeds: Callable[[Patch, dict[str, np.ndarray]], np.ndarray] | None = None, summary: tuple[Callable[[Patch, Sources, dict[str, np.ndarray]], dict[str, float]], list[str]] | None = None) -> DataFrame:
        """Evaluates step; links may drop sources, seeds sets values of cells that need none (returned as a mask).

        summary: (f, names) gives a row for each tile instead, of what f makes of its sources and final state.
        """
        check, upstream, direction, near_by = self.check, self.upstream, self.direction, self.donors if self.upstream else self.receivers

        def linked(p: Patch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            sources = near_by(p)
            if links:
                sources = links(p, sources)
            valid = p.exists & ~np.isnan(p[direction])
            used = valid & (p["use"] == 1) if "use" in p.values else valid
            near = used if upstream else p.exists
            return np.stack([np.where(p.shifted(near, k, False), sources[k - 1], 0.0) for k in range(1, 9)]), valid, used

        def kernel(p: Patch) -> dict[str, np.ndarray]:
            state = p.rim  # what neighbours tell stands on the rim of the same arrays
            sources, valid, used = linked(p)
            take = used & p.inside
            known = ~p.inside & ~np.isnan(state["done"])
            # cells without a direction hold nothing and keep nobody waiting
            known |= p.exists & ~valid
            if seeds:
                if "seeded" not in p.memo:
                    p.memo["seeded"] = seeds(p, state) & p.inside
                    state["done"][p.memo["seeded"]] = 1.0
                known |= p.memo["seeded"]
                take &= ~p.memo["seeded"]
            bare = p.bare(direction) if check and upstream else None

            def front(at: np.ndarray, near: Near) -> None:
                step(p, state, at, near)
                state["done"][at] = 1.0
                if check and upstream:
                    bad = bare[at] | ((near.w > 0) & np.isnan(state[outputs[0]][near.j])).any(axis=0)
                    for o in outputs:
                        state[o][at[bad]] = np.nan

            with np.errstate(invalid="ignore", divide="ignore"):
                sweep(p, sources, take, known, front)
            return state

        def totals(p: Patch, found: dict[str, np.ndarray]) -> dict[str, float]:
            return summary[0](p, linked(p)[0], found)

        return solve(self.cells, self.meta, kernel, outputs, ["done", *outputs], self.size, summary=(totals, summary[1]) if summary else None)


def _total(state: np.ndarray, near: Near, scale: np.ndarray | None = None) -> np.ndarray:
    """Sum of weight times state over sources (NULL sources give nothing)."""
    v = state[near.j] if scale is None else state[near.j] * scale[near.j]
    return _added(np.where((near.w > 0) & ~np.isnan(v), near.w * v, 0.0))


def _added(rows: np.ndarray) -> np.ndarray:
    """Sum of rows, one after the other, so that it does not depend on how many cells a front has."""
    out = 0.0
    for row in rows:
        out = out + row
    return out


def _only(state: np.ndarray, near: Near, rest: np.ndarray) -> np.ndarray:
    """State of the receiver (there is at most one), rest where there is none."""
    k, n = (near.w > 0).argmax(axis=0), np.arange(near.w.shape[1])
    return np.where(near.w[k, n] > 0, state[near.j[k, n]], rest)


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.select("row", "col", F.nanvl(name, F.lit(None)).alias("value"))


# ---------------------------------------------------------------- D8, upstream


def area_d8(p: DataFrame, meta: GridMeta, weight: DataFrame | None = None, outlets: DataFrame | None = None, check: bool = True, size: int = TILE) -> DataFrame:
    """Cells (or weight) that drain through each cell, itself included; a NULL weight gives NULL."""

    weighted = weight is not None

    def step(q: Patch, s: dict, at: np.ndarray, near: Near) -> None:
        own = q["w"][at] if weighted else 1.0
        s["v"][at] = own + _total(s["v"], near)

    return _named(Flow(_cells(p=p, w=weight), meta, "p", outlets=outlets, check=check, size=size).run(["v"], step), "v")


def extreme_up(p: DataFrame, values: DataFrame, meta: GridMeta, largest: bool = True, outlets: DataFrame | None = None, check: bool = True, size: int = TILE) -> DataFrame:
    """Largest (or smallest) value upstream of each cell, itself included."""
    pick = np.fmax if largest else np.fmin

    def step(q: Patch, s: dict, at: np.ndarray, near: Near) -> None:
        s["v"][at] = pick(q["a"][at], pick.reduce(np.where(near.w > 0, s["v"][near.j], np.nan)))

    return _named(Flow(_cells(p=p, a=values), meta, "p", outlets=outlets, check=check, size=size).run(["v"], step), "v")


def condition(p: DataFrame, dem: DataFrame, meta: GridMeta, size: int = TILE) -> DataFrame:
    """Each cell lowered to the lowest cell upstream; cells without a direction keep their height."""

    def step(q: Patch, s: dict, at: np.ndarray, near: Near) -> None:
        s["v"][at] = np.fmin(q["z"][at], np.fmin.reduce(np.where(near.w > 0, s["v"][near.j], np.nan)))

    cells = _cells(p=p, z=dem)
    found = Flow(cells, meta, "p", size=size).run(["v"], step)
    return cells.join(found, ["row", "col"]).select("row", "col", F.coalesce(F.nanvl("v", F.lit(None)), "z").alias("value"))


def strahler(orders: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Order of cells from the orders and weights (in eight rows) of their sources: the largest, or one more if two sources have it."""
    o = np.where((weights > 0) & ~np.isnan(orders), orders, 0.0)
    o.sort(axis=-2)
    return np.maximum(np.maximum(o[..., -1, :], o[..., -2, :] + 1), 1.0)


def grid_net(p: DataFrame, meta: GridMeta, mask: DataFrame | None = None, limit: float = 0.0, outlets: DataFrame | None = None, size: int = TILE) -> DataFrame:
    """row, col, plen (longest path upstream), tlen (length of all paths) and gord (Strahler order) of cells whose mask reaches limit."""
    cells = _cells(p=p, mask=mask)
    if mask is not None:
        cells = cells.withColumn("p", F.when(F.col("mask") >= limit, F.col("p")))

    def step(q: Patch, s: dict, at: np.ndarray, near: Near) -> None:
        d, plen = q.lengths(at), s["plen"][near.j]
        ok = (near.w > 0) & ~np.isnan(plen)
        s["plen"][at] = np.where(ok, plen + d, 0.0).max(axis=0)
        s["tlen"][at] = _added(np.where(ok, s["tlen"][near.j] + d, 0.0))
        s["gord"][at] = strahler(s["gord"][near.j], near.w)

    return Flow(cells, meta, "p", outlets=outlets, size=size).run(["plen", "tlen", "gord"], step)


# -------------------------------------------------------------- D8, downstream


def _down_d8(cells: DataFrame, meta: GridMeta, limit: float, more: Callable[[Patch, np.ndarray, np.ndarray], np.ndarray], size: int) -> DataFrame:
    def seeds(q: Patch, s: dict) -> np.ndarray:
        on = q.exists & (q["src"] >= limit) & ~np.isnan(q["p"])
        s["v"][on & q.inside] = 0.0
        return on

    def step(q: Patch, s: dict, at: np.ndarray, near: Near) -> None:
        s["v"][at] = np.fmax.reduce(np.where(near.w > 0, s["v"][near.j] + more(q, at, near.j), np.nan))  # there is one receiver

    return _named(Flow(cells, meta, "p", upstream=False, size=size).run(["v"], step, seeds=seeds), "v")


def hdist_d8(p: DataFrame, stream: DataFrame, meta: GridMeta, limit: float = 1.0, size: int = TILE) -> DataFrame:
    """Distance along flow to the first cell whose stream value reaches limit; NULL if there is none."""
    return _down_d8(_cells(p=p, src=stream), meta, limit, lambda q, at, j: q.lengths(at), size)


def vdist_d8(p: DataFrame, dem: DataFrame, stream: DataFrame, meta: GridMeta, limit: float = 1.0, size: int = TILE) -> DataFrame:
    """Drop along flow to the first stream cell."""
    return _down_d8(_cells(p=p, z=dem, src=stream), meta, limit, lambda q, at, j: q["z"][at] - q["z"][j], size)


def slope_ave_down(p: DataFrame, dem: DataFrame, meta: GridMeta, dn: float = 50.0, size: int = TILE) -> DataFrame:
    """Slope from each cell to the first cell downstream that is farther than dn; NULL if its path is shorter.

    Ancestor tables: after round j a cell knows its descendant 2^j steps on; paths are
    then put together from the longest jumps that stay within dn.
    """
    hops = int(dn / min(meta.dx, meta.dy)) + 1
    cells = _cells(p=p, z=dem).select("row", "col", "p", "z")
    step = cells.where("p between 1 and 8").select(
        "row", "col", *(F.element_at(F.array(*(F.lit(d[i]) for d in STEPS)), F.col("p").cast("int")).alias(n) for i, n in ((0, "dr"), (1, "dc"))), F.when(F.col("p").isin(1, 5), meta.dx).when(F.col("p").isin(3, 7), meta.dy).otherwise((meta.dx**2 + meta.dy**2) ** 0.5).alias("d")
    )
    at = cells.where("p is not null").select("row", "col", F.col("z").alias("z0"), F.col("row").alias("r"), F.col("col").alias("c"), F.lit(0.0).alias("dist"), F.lit(False).alias("over"))
    hop = step.select(F.col("row").alias("r"), F.col("col").alias("c"), (F.col("row") + F.col("dr")).alias("nr"), (F.col("col") + F.col("dc")).alias("nc"), "d")
    valid = cells.where("z is not null").select(F.col("row").alias("nr"), F.col("col").alias("nc"))
    hop = hop.join(valid, ["nr", "nc"], "left_semi")
    from ..plans.tiles import checkpointed

    jumps = [checkpointed(hop)]
    while 2 ** len(jumps) <= hops:
        a = jumps[-1]
        b = a.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("nr").alias("mr"), F.col("nc").alias("mc"), F.col("d").alias("e"))
        jumps.append(checkpointed(a.join(b, ["nr", "nc"]).select("r", "c", F.col("mr").alias("nr"), F.col("mc").alias("nc"), (F.col("d") + F.col("e")).alias("d"))))
    for j in reversed(jumps):
        moved = at.join(j, ["r", "c"], "left")
        go = F.col("d").isNotNull() & (F.col("dist") + F.col("d") <= dn)
        at = moved.select("row", "col", "z0", F.when(go, F.col("nr")).otherwise(F.col("r")).alias("r"), F.when(go, F.col("nc")).otherwise(F.col("c")).alias("c"), F.when(go, F.col("dist") + F.col("d")).otherwise(F.col("dist")).alias("dist"), "over")
    last = at.join(jumps[0], ["r", "c"], "left").select("row", "col", "z0", F.coalesce("nr", "r").alias("r"), F.coalesce("nc", "c").alias("c"), (F.col("dist") + F.coalesce("d", F.lit(0.0))).alias("dist"))
    low = cells.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("z").alias("z1"))
    found = last.join(low, ["r", "c"]).select("row", "col", F.when(F.col("dist") > dn, (F.col("z0") - F.col("z1")) / F.col("dist")).alias("value"))
    return cells.select("row", "col").join(found, ["row", "col"], "left")


# --------------------------------------------------------- D-infinity, upstream


def _dx(p: Patch, at: np.ndarray) -> np.ndarray:
    return p.dx[at]


def area_dinf(ang: DataFrame, meta: GridMeta, weight: DataFrame | None = None, outlets: DataFrame | None = None, check: bool = True, size: int = TILE) -> DataFrame:
    """Specific catchment area: own weight (or cell width) and the shares of the donors' areas."""

    weighted = weight is not None

    def step(q: Patch, s: dict, at: np.ndarray, near: Near) -> None:
        s["v"][at] = (q["w"][at] if weighted else _dx(q, at)) + _total(s["v"], near)

    return _named(Flow(_cells(ang=ang, w=weight), meta, "ang", outlets=outlets, check=check, size=size).run(["v"], step), "v")


def decay_accum(ang: DataFrame, decay: DataFrame, meta: GridMeta, weight: DataFrame | None = None, outlets: DataFrame | None = None, check: bool = True, size: int = TILE) -> DataFrame:
    """As area_dinf, with what leaves a donor scaled by its decay."""

    weighted = weight is not None

    def step(q: Patch, s: dict, at: np.ndarray, near: Near) -> None:
        s["v"][at] = (q["w"][at] if weighted else _dx(q, at)) + _total(s["v"], near, q["dm"])

    return _named(Flow(_cells(ang=ang, dm=decay, w=weight), meta, "ang", outlets=outlets, check=check, size=size).run(["v"], step), "v")


def conc_lim_accum(ang: DataFrame, decay: DataFrame, discharge: DataFrame, indicator: DataFrame, meta: GridMeta, threshold: float = 1.0, outlets: DataFrame | None = None, check: bool = True, size: int = TILE) -> DataFrame:
    """Concentration: threshold where indicator is positive, else the donors' decayed load over the discharge; NULL without discharge."""

    def step(q: Patch, s: dict, at: np.ndarray, near: Near) -> None:
        load = _total(s["v"], near, q["q"] * q["dm"])
        flow = q["q"][at]
        s["v"][at] = np.where(flow > 0, np.where(q["dg"][at] > 0, threshold, load / flow), np.nan)

    return _named(Flow(_cells(ang=ang, dm=decay, q=discharge, dg=indicator), meta, "ang", outlets=outlets, check=check, size=size).run(["v"], step), "v")


def trans_lim_accum(ang: DataFrame, supply: DataFrame, capacity: DataFrame, meta: GridMeta, concentration: DataFrame | None = None, outlets: DataFrame | None = None, check: bool = True, size: int = TILE) -> DataFrame:
    """row, col, tla (transport), tdep (deposition) and, with a concentration of the supply, ctpt."""
    mixed = concentration is not None
    outputs = ["tla", "tdep", *(["ctpt"] if mixed else [])]

    def step(q: Patch, s: dict, at: np.ndarray, near: Near) -> None:
        given, cap = q["tsup"][at], q["tc"][at]
        came = _total(s["tla"], near)
        moved = np.minimum(came + given, cap)
        s["tla"][at] = moved
        s["tdep"][at] = came + given - moved
        if mixed:
            load = _total(s["tla"], near, s["ctpt"])
            load = np.where(moved >= came, load + q["cs"][at] * (moved - came), load * moved / np.where(came > 0, came, 1.0))
            s["ctpt"][at] = np.where(moved > 0, load / np.where(moved > 0, moved, 1.0), 0.0)

    return Flow(_cells(ang=ang, tsup=supply, tc=capacity, cs=concentration), meta, "ang", outlets=outlets, check=check, size=size).run(outputs, step)


def ret_lim_flow(ang: DataFrame, weight: DataFrame, retention: DataFrame, meta: GridMeta, size: int = TILE) -> DataFrame:
    """Runoff: what comes in and the cell's own weight, less its retention, not under 0."""

    def step(q: Patch, s: dict, at: np.ndarray, near: Near) -> None:
        s["v"][at] = np.maximum(0.0, _total(s["v"], near) + q["w"][at] - q["rc"][at])

    return _named(Flow(_cells(ang=ang, w=weight, rc=retention), meta, "ang", size=size).run(["v"], step), "v")


def avalanche(ang: DataFrame, dem: DataFrame, source: DataFrame, meta: GridMeta, thresh: float = 0.2, alpha: float = 18.0, direct: bool = False, size: int = TILE) -> DataFrame:
    """row, col, rz (angle to the source, degrees, where at least alpha) and dm (distance to it).

    A cell takes, of the sources of its donors (share at least thresh), the one under the steepest angle.
    """

    def place(q: Patch, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return at // q.width + q.row0 - 1.0, at % q.width + q.col0 - 1.0

    def links(q: Patch, sources: Sources) -> Sources:
        return [np.where(w >= thresh, w, 0.0) for w in sources]

    def seeds(q: Patch, s: dict) -> np.ndarray:
        on = q.exists & (q["ass"] > 0) & ~np.isnan(q["ang"]) & q.inside
        at = np.flatnonzero(on)
        r, c = place(q, at)
        for name, v in (("rz", alpha), ("dm", 0.0), ("sr", r), ("sc", c), ("sz", q["z"][at])):
            s[name][at] = v
        return on

    def step(q: Patch, s: dict, at: np.ndarray, near: Near) -> None:
        r, c = place(q, at)
        came = {n: s[n][near.j] for n in ("dm", "sr", "sc", "sz")}
        path = came["dm"] + q.lengths(at) if not direct else np.hypot((came["sr"] - r) * q.dy[at], (came["sc"] - c) * q.dx[at])
        beta = np.degrees(np.arctan((came["sz"] - q["z"][at]) / path))
        take = (near.w > 0) & (s["rz"][near.j] >= alpha) & (beta >= alpha)
        k, n = np.where(take, beta, -np.inf).argmax(axis=0), np.arange(len(at))
        some = take[k, n]
        for name, v in (came | {"rz": beta, "dm": path}).items():
            s[name][at] = np.where(some, v[k, n], np.nan)

    flow = Flow(_cells(ang=ang, z=dem, ass=source), meta, "ang", size=size)
    return flow.run(["rz", "dm", "sr", "sc", "sz"], step, links, seeds).select("row", "col", F.nanvl("rz", F.lit(None)).alias("rz"), F.nanvl("dm", F.lit(None)).alias("dm"))


# ------------------------------------------------------- D-infinity, downstream


def rev_accum(ang: DataFrame, weight: DataFrame, meta: GridMeta, size: int = TILE) -> DataFrame:
    """row, col, racc (weight summed over what lies downstream, by shares) and dmax (the largest weight there)."""

    def step(q: Patch, s: dict, at: np.ndarray, near: Near) -> None:
        s["racc"][at] = q["w"][at] + _total(s["racc"], near)
        s["dmax"][at] = np.fmax(q["w"][at], np.fmax.reduce(np.where(near.w > 0, s["dmax"][near.j], np.nan)))

    return Flow(_cells(ang=ang, w=weight), meta, "ang", upstream=False, size=size).run(["racc", "dmax"], step)


def up_dependence(ang: DataFrame, target: DataFrame, meta: GridMeta, size: int = TILE) -> DataFrame:
    """Share of a cell's flow that passes a target cell."""

    def step(q: Patch, s: dict, at: np.ndarray, near: Near) -> None:
        s["v"][at] = np.where(q["dg"][at] >= 1, 1.0, _total(s["v"], near))

    return _named(Flow(_cells(ang=ang, dg=target), meta, "ang", upstream=False, size=size).run(["v"], step), "v")


def _gather(stat: str, values: np.ndarray, weights: np.ndarray, zero_start: bool = False) -> np.ndarray:
    """Average (by weight), largest or smallest of values, in eight rows; NaN without any."""
    ok = weights > 0
    if stat == "ave":
        weight = _added(np.where(ok, weights, 0.0))
        return _added(np.where(ok, weights * values, 0.0)) / np.where(weight > 0, weight, np.nan)
    best = (np.fmax if stat == "max" else np.fmin).reduce(np.where(ok, values, np.nan))
    return np.where(ok.any(axis=0), np.fmax(best, 0.0), np.nan) if zero_start and stat == "max" else best


def _steps(q: Patch, at: np.ndarray, j: np.ndarray, weighted: bool) -> dict[str, np.ndarray]:
    """Increments of the horizontal, vertical (for v and for p) and surface length of the eight steps."""
    flat = q.lengths(at) * (q["w"][at] if weighted else 1.0)
    drop = np.abs(q["z"][at] - q["z"][j])
    return {"h": flat, "v": drop, "q": drop, "s": np.hypot(flat, drop)}


#: What each kind of distance is made of: horizontal h, vertical v, or q where h leads, and surface s.
_PARTS = {"h": ("h",), "v": ("v",), "p": ("h", "q"), "s": ("s",)}


class _Distances:
    """The states kept for kinds and stats, named by part and stat, and the values made of them."""

    def __init__(self, kinds: str, stats: tuple[str, ...]):
        self.kinds, self.stats = kinds, stats
        parts = dict.fromkeys(n for kind in kinds for n in _PARTS[kind])
        self.names = [f"{n}_{stat}" for stat in stats for n in parts]

    def step(self, q: Patch, s: dict, at: np.ndarray, near: Near, weighted: bool, close: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        moves = _steps(q, at, near.j, weighted)
        for name in self.names:
            n, _, stat = name.partition("_")
            came = s[name][near.j]
            found = _gather(stat, came + moves[n], np.where(np.isnan(came), 0.0, near.w), n == "h")
            s[name][at] = close(found, s[f"h_{stat}"][near.j] if n == "q" else came)

    def values(self, found: DataFrame) -> DataFrame:
        """row, col and a column kind_stat for each distance."""
        value = lambda k, s: F.sqrt(F.col(f"h_{s}") * F.col(f"h_{s}") + F.col(f"q_{s}") * F.col(f"q_{s}")) if k == "p" else F.col(f"{k}_{s}")
        return found.select("row", "col", *(F.nanvl(value(k, s), F.lit(None)).alias(f"{k}_{s}") for k in self.kinds for s in self.stats))


def distances_down(ang: DataFrame, dem: DataFrame, stream: DataFrame, meta: GridMeta, kinds: str = "hvps", stats: tuple[str, ...] = ("ave", "max", "min"), weight: DataFrame | None = None, check: bool = True, size: int = TILE) -> DataFrame:
    """row, col and a column kind_stat for each of dist_down's distances, in one evaluation."""
    d, weighted = _Distances(kinds, stats), weight is not None

    def seeds(q: Patch, s: dict) -> np.ndarray:
        on = q.exists & (q["src"] >= 1) & q.inside & ~np.isnan(q["ang"])
        for n in d.names:
            s[n][on] = 0.0
        return on

    def step(q: Patch, s: dict, at: np.ndarray, near: Near) -> None:
        d.step(q, s, at, near, weighted, lambda found, led: np.where(((near.w > 0) & np.isnan(led)).any(axis=0), np.nan, found) if check else found)

    return d.values(Flow(_cells(ang=ang, z=dem, src=stream, w=weight), meta, "ang", upstream=False, size=size).run(d.names, step, seeds=seeds))


def dist_down(ang: DataFrame, dem: DataFrame, stream: DataFrame, meta: GridMeta, kind: str = "h", stat: str = "ave", weight: DataFrame | None = None, check: bool = True, size: int = TILE) -> DataFrame:
    """Distance down to stream cells (1 or more): horizontal h, vertical v, straight p or along the surface s; ave, max or min over the ways.

    NULL where no way leads to a stream, or, with check, where one of them does not.
    """
    return distances_down(ang, dem, stream, meta, kind, (stat,), weight, check, size).select("row", "col", F.col(f"{kind}_{stat}").alias("value"))


def distances_up(ang: DataFrame, dem: DataFrame, meta: GridMeta, kinds: str = "hvps", stats: tuple[str, ...] = ("ave", "max", "min"), weight: DataFrame | None = None, thresh: float = 0.0, check: bool = True, size: int = TILE) -> DataFrame:
    """row, col and a column kind_stat for each of dist_up's distances, in one evaluation."""
    d, weighted = _Distances(kinds, stats), weight is not None

    def links(q: Patch, sources: Sources) -> Sources:
        return [np.where(w > thresh, w, 0.0) for w in sources]

    def step(q: Patch, s: dict, at: np.ndarray, near: Near) -> None:
        some = (near.w > 0).any(axis=0)
        d.step(q, s, at, near, weighted, lambda found, led: np.where(some, found, 0.0))

    return d.values(Flow(_cells(ang=ang, z=dem, w=weight), meta, "ang", check=check, size=size).run(d.names, step, links))


def dist_up(ang: DataFrame, dem: DataFrame, meta: GridMeta, kind: str = "h", stat: str = "ave", weight: DataFrame | None = None, thresh: float = 0.0, check: bool = True, size: int = TILE) -> DataFrame:
    """Distance up to the ridge over donors whose share is over thresh; ridge cells are 0."""
    return distances_up(ang, dem, meta, kind, (stat,), weight, thresh, check, size).select("row", "col", F.col(f"{kind}_{stat}").alias("value"))

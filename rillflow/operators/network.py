"""From grids to networks: watersheds, outlets, stream links and their statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.grid import GridMeta, neighbours, place_of
from ..plans.paths import follow, receivers
from ..plans.tiles import TILE, Near, Patch, checkpointed
from .flow import Flow, _cells, _only, area_d8, strahler


def numbered(df: DataFrame, columns: list, name: str) -> DataFrame:
    """df with name, from 0 in the order of columns: ranges are numbered apart and put one after the other."""
    parts = checkpointed(df.repartitionByRange(*columns).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["n"] for r in parts.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # one row for each partition
    before, offsets = 0, {}
    for k in sorted(sizes):
        offsets[k], before = before, before + sizes[k]
    starts = F.create_map(*(F.lit(x) for pair in offsets.items() for x in pair)) if offsets else F.create_map(F.lit(0), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*columns))
    return parts.withColumn(name, (F.element_at(starts, F.col("__part")) + rank - 1).cast("long")).drop("__part")


def gage_watershed(p: DataFrame, gages: DataFrame, meta: GridMeta, size: int = TILE) -> DataFrame:
    """Cells labelled with the id of the first of gages (id, row, col) downstream; NULL without one."""
    ids = gages.groupBy("row", "col").agg(F.max("id").cast("double").alias("gage"))
    cells = p.select("row", "col", F.col("value").cast("double").alias("p")).join(ids, ["row", "col"], "left")

    def seeds(q: Patch, s: dict) -> np.ndarray:
        on = q.inside & ~np.isnan(q["gage"]) & ~np.isnan(q["p"])
        s["v"][on] = q["gage"][on]
        return on

    def step(q: Patch, s: dict, at: np.ndarray, near: Near) -> None:
        s["v"][at] = _only(s["v"], near, s["v"][at])

    found = Flow(cells, meta, "p", upstream=False, size=size).run(["v"], step, seeds=seeds)
    return found.select("row", "col", F.nanvl("v", F.lit(None)).cast(gages.schema["id"].dataType).alias("value"))


def open_neighbours(p: DataFrame, labels: DataFrame, meta: GridMeta) -> DataFrame:
    """row, col of cells without a direction beside a cell with a label: where a watershed may go on beyond the grid."""
    near = neighbours(labels.select("row", "col", "value").join(p.select("row", "col", F.col("value").alias("p")), ["row", "col"]), "value")
    beside = F.lit(False)
    for k in range(1, 9):
        beside = beside | F.col(f"n{k}").isNotNull()
    return near.where(F.col("p").isNull() & beside).select("row", "col")


def gage_links(p: DataFrame, gages: DataFrame, meta: GridMeta) -> DataFrame:
    """id and iddown (the next gage downstream, -1 if none) of every gage."""
    labels = gage_watershed(p, gages, meta).select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("value").alias("iddown"))
    below = receivers(p, meta).select("row", "col", "r", "c").join(labels, ["r", "c"], "left").select("row", "col", "iddown")
    return gages.join(below, ["row", "col"], "left").select("id", F.coalesce("iddown", F.lit(-1)).alias("iddown"))


def move_outlets(p: DataFrame, stream: DataFrame, outlets: DataFrame, meta: GridMeta, most: int = 50) -> DataFrame:
    """outlets (id, row, col, ...) moved down to the first stream cell within most steps.

    Adds dist_moved; a point without such a cell stays and has -1.
    """
    paths = follow(p, meta, stream.where("value >= 1"), most).where("stopped").select("row", "col", "r", "c", "hops")
    moved = outlets.join(paths, ["row", "col"], "left")
    rest = [c for c in outlets.columns if c not in ("row", "col")]
    return moved.select(*rest, F.coalesce("r", "row").alias("row"), F.coalesce("c", "col").alias("col"), F.coalesce("hops", F.lit(-1)).alias("dist_moved"))


def walk_down(p: DataFrame, points: DataFrame, meta: GridMeta, steps: int) -> DataFrame:
    """points (row, col, ...) with r and c: where they are after at most steps steps along flow."""
    hop = receivers(p, meta).where("ok").select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("r").alias("nr"), F.col("c").alias("nc"))
    jumps = [checkpointed(hop)]
    while 2 ** len(jumps) <= steps:
        a = jumps[-1]
        jumps.append(checkpointed(a.join(a.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("nr").alias("mr"), F.col("nc").alias("mc")), ["nr", "nc"]).select("r", "c", F.col("mr").alias("nr"), F.col("mc").alias("nc"))))
    at = points.withColumns({"r": F.col("row"), "c": F.col("col"), "hops": F.lit(0)})
    for j in range(len(jumps) - 1, -1, -1):
        go = F.col("nr").isNotNull() & (F.col("hops") + 2**j <= steps)
        at = at.join(jumps[j], ["r", "c"], "left").select(*points.columns, F.when(go, F.col("nr")).otherwise(F.col("r")).alias("r"), F.when(go, F.col("nc")).otherwise(F.col("c")).alias("c"), (F.col("hops") + F.when(go, 2**j).otherwise(0)).alias("hops"))
    return at


def connect_down(p: DataFrame, watershed: DataFrame, area: DataFrame, meta: GridMeta, steps: int = 10) -> DataFrame:
    """id, row, col (the cell of most area of each watershed), ad8, r, c (it after steps along flow) and id_down (the watershed there, -1 if none)."""
    cells = watershed.where("value >= 0").select("row", "col", F.col("value").alias("id")).join(area.where("value is not null").select("row", "col", F.col("value").alias("ad8")), ["row", "col"])
    best = cells.groupBy("id").agg(F.max_by(F.struct("row", "col", "ad8"), F.struct("ad8", (-F.col("row")).alias("a"), (-F.col("col")).alias("b"))).alias("best"))
    points = best.select("id", "best.row", "best.col", "best.ad8")
    to = watershed.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("value").alias("id_down"))
    return walk_down(p, points, meta, steps).join(to, ["r", "c"], "left").select("id", "row", "col", "ad8", "r", "c", F.coalesce("id_down", F.lit(-1)).alias("id_down"))


def drop_thresholds(low: float, high: float, count: int, logarithmic: bool = True) -> list[float]:
    if count < 2:
        return [float(low)]
    if logarithmic:
        step = math.exp((math.log(high) - math.log(low)) / (count - 1))
        return [low * step**i for i in range(count)]
    return [low + (high - low) / (count - 1) * i for i in range(count)]


def drop_statistics(p: DataFrame, dem: DataFrame, ssa: DataFrame, area: DataFrame, outlets: DataFrame, meta: GridMeta, thresholds: list[float], size: int = TILE) -> DataFrame:
    """One row for each threshold: stream length over area, and the drops of first- and higher-order streams with the t statistic of their means.

    A stream cell has ssa of at least the threshold.  At a junction, streams of lower
    order than the cell's end; their drop is from where they began to the cell.
    """
    flow = Flow(_cells(p=p, z=dem, ssa=ssa), meta, "p", outlets=outlets, size=size)
    # all thresholds are evaluated at once, on the cells that are streams at the least of them
    flow.cells = flow.cells.where(F.col("ssa") >= min(thresholds))
    n, limits, parts = len(thresholds), np.array(thresholds, float)[:, None], ("len", "n1", "d1", "q1", "n2", "d2", "q2")

    def step(q: Patch, s: dict, at: np.ndarray, near: Near) -> None:
        orders, heads = q.rims[1 : n + 1], q.rims[n + 1 :]  # a row for each threshold; done comes first
        on = q["ssa"][at] >= limits
        above = orders[:, near.j]
        order = strahler(above, near.w)
        # the stream goes on from the first source of its order
        goes_on = (near.w > 0) & (above == order[:, None])
        k, i = goes_on.argmax(axis=1), np.arange(len(at))
        head = np.where(goes_on.any(axis=1), heads[np.arange(n)[:, None], near.j[k, i]], q["z"][at])
        orders[:, at], heads[:, at] = np.where(on, order, np.nan), np.where(on, head, np.nan)

    def total(q: Patch, sources: np.ndarray, s: dict) -> dict[str, float]:
        """Sums of a tile's stream cells."""
        orders, heads = q.rims[1 : n + 1], q.rims[n + 1 :]
        at = np.flatnonzero(q.inside & (s["done"] == 1))
        on = ~np.isnan(orders[:, at])
        sums = {p: np.zeros(n) for p in parts}
        for k, off in enumerate(q.offsets):
            w, above = sources[k][at], orders[:, at + off]
            came = on & (w > 0) & ~np.isnan(above)
            sums["len"] += np.where(came, q.length(k + 1)[at], 0.0).sum(axis=1)
            ends = came & (above < orders[:, at])
            drop = np.where(ends, heads[:, at + off] - q["z"][at], 0.0)
            for c, mine in ((1, ends & (above == 1)), (2, ends & (above > 1))):
                sums[f"n{c}"] += mine.sum(axis=1)
                sums[f"d{c}"] += np.where(mine, drop, 0.0).sum(axis=1)
                sums[f"q{c}"] += np.where(mine, drop**2, 0.0).sum(axis=1)
        return {f"{p}{i}": float(v) for p in parts for i, v in enumerate(sums[p])}

    names = [f"{p}{i}" for p in parts for i in range(n)]
    found = flow.run([f"{p}{i}" for p in ("ord", "head") for i in range(n)], step, summary=(total, names))
    sums = found.agg(*(F.sum(c).alias(c) for c in names))
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(float(limit)).alias("threshold"), *(F.col(f"{p}{i}").alias(p) for p in parts)) for i, limit in enumerate(thresholds)))).alias("row")).select("row.*")
    # the outlets that drain to no stream give the area
    ends = outlets.select("row", "col").distinct().join(receivers(p, meta).select("row", "col", "r", "c"), ["row", "col"], "left")
    lower = _cells(ssa=ssa).where(F.col("ssa").isNotNull() & (F.col("ssa") >= min(thresholds))).select(F.col("row").alias("r"), F.col("col").alias("c"), F.lit(True).alias("below"))
    total = ends.join(lower, ["r", "c"], "left").where("below is null").join(area.select("row", "col", F.col("value").alias("a")), ["row", "col"]).agg((F.sum("a") * meta.dx * meta.dy).alias("area"))
    rows = rows.crossJoin(F.broadcast(total))
    n1, n2 = F.col("n1"), F.col("n2")
    mean1, mean2 = F.col("d1") / F.nullif(n1, F.lit(0)), F.col("d2") / F.nullif(n2, F.lit(0))
    ss1, ss2 = F.col("q1") - F.col("d1") * mean1, F.col("q2") - F.col("d2") * mean2
    sd1 = F.when(n1 > 1, F.sqrt(F.greatest(ss1, F.lit(0.0)) / (n1 - 1)))
    sd2 = F.when(n2 > 1, F.sqrt(F.greatest(ss2, F.lit(0.0)) / (n2 - 1)))
    pooled = F.sqrt((F.greatest(ss1, F.lit(0.0)) + F.greatest(ss2, F.lit(0.0))) / (n1 + n2 - 2))
    t = F.when((n1 > 1) & (n2 > 1) & (pooled > 0), (mean1 - mean2) / (pooled * F.sqrt(F.lit(1.0) / n1 + F.lit(1.0) / n2)))
    return rows.select("threshold", (F.col("len") / F.col("area")).alias("drain_density"), n1.cast("long").alias("n_first"), n2.cast("long").alias("n_high"), mean1.alias("mean_first"), mean2.alias("mean_high"), sd1.alias("sd_first"), sd2.alias("sd_high"), t.alias("t")).where("n_first > 1 and n_high > 1")


def optimum_threshold(drops: DataFrame) -> DataFrame:
    """threshold: the smallest with |t| under 2."""
    return drops.where(F.abs("t") < 2).agg(F.min("threshold").alias("threshold"))


def stream_net(p: DataFrame, dem: DataFrame, area: DataFrame, stream: DataFrame, meta: GridMeta, outlets: DataFrame | None = None, single_watershed: bool = False, size: int = TILE) -> dict[str, DataFrame]:
    """links, points (hops: steps to the link's end, d: distance to the outlet), watershed and order of the stream network.

    Links run from a source, a junction or an outlet to the next junction, outlet or
    end, and share the junction's cell.  Ids follow the place of the link's first cell
    (row, then col); where more than two links meet, links of length 0 keep the
    tree binary and are numbered after all others.
    """
    on = p.join(stream.where("value > 0").select("row", "col"), ["row", "col"], "left_semi").where("value is not null")
    to = checkpointed(receivers(on, meta).where("ok").select("row", "col", "r", "c", "d"))
    inflow = to.groupBy(F.col("r").alias("row"), F.col("c").alias("col")).agg(F.count("*").alias("inflows"))
    cells = on.select("row", "col").join(inflow, ["row", "col"], "left").withColumn("inflows", F.coalesce("inflows", F.lit(0)))
    breaks = (outlets.select("row", "col", F.col("id").alias("node")).dropDuplicates(["row", "col"]) if outlets is not None else on.select("row", "col", F.lit(None).cast("int").alias("node")).limit(0))
    cells = checkpointed(cells.join(breaks, ["row", "col"], "left").join(to, ["row", "col"], "left"))
    heads = cells.where("inflows <> 1").select("row", "col")
    # past an outlet a new link starts in its receiver's place: the outlet's cell is shared
    starts = heads.unionByName(cells.where("node is not null and inflows = 1 and r is not null").select("row", "col"))
    junction = starts.select(F.col("row").alias("r"), F.col("col").alias("c"), F.lit(True).alias("joins"))
    tails = cells.join(junction, ["r", "c"], "left").where("joins or r is null").select("row", "col")
    ends = follow(on, meta, tails)
    # a cell that starts a link goes on with what is below it, so links are told apart by their last cell
    first = numbered(starts.join(ends.select("row", "col", "r", "c"), ["row", "col"]), [F.col("row"), F.col("col")], "link")
    link_of = first.select("link", F.col("r").alias("tr"), F.col("c").alias("tc"), F.col("row").alias("hr"), F.col("col").alias("hc"))
    member = checkpointed(ends.select("row", "col", F.col("r").alias("tr"), F.col("c").alias("tc"), "dist", "hops").join(link_of, ["tr", "tc"]))
    values = _cells(z=dem, a=area)
    z_at = lambda r, c, name: values.select(F.col("row").alias(r), F.col("col").alias(c), F.col("z").alias(f"z_{name}"), F.col("a").alias(f"a_{name}"))
    stream_p = _cells(p=on)
    order = Flow(stream_p, meta, "p", size=size).run(["v"], lambda q, s, at, near: s["v"].__setitem__(at, strahler(s["v"][near.j], near.w))).select("row", "col", F.col("v").cast("int").alias("ord"))
    magnitude = area_d8(on, meta, cells.select("row", "col", F.when(F.col("inflows") == 0, 1.0).otherwise(0.0).alias("value")), check=False, size=size).select(F.col("row").alias("hr"), F.col("col").alias("hc"), F.col("value").cast("long").alias("magnitude"))
    last = to.select(F.col("row").alias("tr"), F.col("col").alias("tc"), F.col("r").alias("er"), F.col("c").alias("ec"), F.col("d").alias("last_step"))
    node = breaks.select(F.col("row").alias("er"), F.col("col").alias("ec"), F.col("node").alias("dsnode"))
    x, y = place_of(F.col("hr"), F.col("hc"), meta), place_of(F.col("er"), F.col("ec"), meta)
    out_length = follow(on, meta, on.limit(0)).select(F.col("row").alias("er"), F.col("col").alias("ec"), F.col("dist").alias("doutend"))
    links = (
        member.where("row = hr and col = hc")
        .join(last, ["tr", "tc"], "left")
        .withColumns({"er": F.coalesce("er", "tr"), "ec": F.coalesce("ec", "tc"), "length": F.col("dist") + F.coalesce("last_step", F.lit(0.0))})
        .join(z_at("hr", "hc", "up"), ["hr", "hc"])
        .join(z_at("er", "ec", "end"), ["er", "ec"])
        .join(z_at("tr", "tc", "tail"), ["tr", "tc"])
        .join(out_length, ["er", "ec"])
        .join(node, ["er", "ec"], "left")
        .join(magnitude, ["hr", "hc"])
        .join(order.select(F.col("row").alias("hr"), F.col("col").alias("hc"), "ord"), ["hr", "hc"])
        .withColumn("drop", F.col("z_up") - F.col("z_end"))
        .select(
            "link", "hr", "hc", "er", "ec", F.col("ord").alias("strmorder"), "magnitude", "length", "drop", F.when(F.col("length") > 0, F.col("drop") / F.col("length")).otherwise(0.0).alias("slope"),
            F.sqrt(F.pow(x[1] - y[1], 2) + F.pow(x[0] - y[0], 2)).alias("straightl"), (F.col("a_up") * meta.dx * meta.dy).alias("uscontarea"), (F.col("a_tail") * meta.dx * meta.dy).alias("dscontarea"),
            "doutend", (F.col("doutend") + F.col("length")).alias("doutstart"), (F.col("doutend") + F.col("length") / 2).alias("doutmid"), F.coalesce("dsnode", F.lit(-1)).alias("dsnode"),
            F.col("last_step").isNotNull().alias("shared"),
        )
    )
    links = checkpointed(links)
    below = links.select(F.col("link").alias("down"), F.col("hr").alias("er"), F.col("hc").alias("ec"))
    joined = links.where("er <> hr or ec <> hc").join(below, ["er", "ec"]).select("link", "down", "strmorder", "magnitude", "er", "ec")
    n_links = links.count()

    def tree(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        """us1, us2 and ds of the links around one junction; extra links of length 0 have negative ids."""
        g = g.sort_values(["strmorder", "link"], ascending=[False, True])
        down, rows = int(key[0]), []
        up = [(int(r.link), int(r.strmorder), int(r.magnitude)) for r in g.itertuples()]
        first, k = up[0], 0
        for second in up[1:]:
            k += 1
            final = k == len(up) - 1
            here = down if final else -(down * 8 + k) - 1
            top, low = max(first[1], second[1]), min(first[1], second[1])
            made = (here, max(top, low + 1), first[2] + second[2])
            rows.append((here, first[0], second[0], made[1], made[2], int(g["er"].iloc[0]), int(g["ec"].iloc[0])))
            first = made
        if len(up) == 1:
            rows.append((down, up[0][0], -1, up[0][1], up[0][2], int(g["er"].iloc[0]), int(g["ec"].iloc[0])))
        return pd.DataFrame(rows, columns=["here", "us1", "us2", "o", "m", "jr", "jc"])

    # one or two links, as nearly everywhere, need no Python
    met = joined.groupBy("down").agg(F.sort_array(F.collect_list(F.struct((-F.col("strmorder")).alias("o"), "link", "magnitude", "er", "ec"))).alias("up"))
    a, b = F.get("up", F.lit(0)), F.get("up", F.lit(1))
    few = met.where(F.size("up") <= 2).select(
        F.col("down").cast("long").alias("here"), a["link"].cast("long").alias("us1"), F.coalesce(b["link"].cast("long"), F.lit(-1)).alias("us2"),
        F.greatest(-a["o"], 1 - b["o"]).cast("int").alias("o"), (a["magnitude"] + F.coalesce(b["magnitude"], F.lit(0))).cast("long").alias("m"), a["er"].alias("jr"), a["ec"].alias("jc"),
    )
    many = met.where(F.size("up") > 2).select("down", F.inline("up")).withColumn("strmorder", -F.col("o")).drop("o")
    ups = checkpointed(few.unionByName(many.groupBy("down").applyInPandas(tree, "here long, us1 long, us2 long, o int, m long, jr int, jc int")))
    extra = ups.where("here < 0")
    renamed = numbered(extra.select(F.col("here").alias("old")), [F.desc("old")], "new").withColumn("new", F.col("new") + n_links)

    def real(df: DataFrame, c: str) -> DataFrame:
        return df.join(renamed.withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("new", F.col(c))).drop("new")

    ups = real(real(real(ups, "here"), "us1"), "us2")
    downs = ups.select(F.explode(F.array("us1", "us2")).alias("link"), F.col("here").alias("dslink")).where("link >= 0")
    end = links.select(F.col("hr").alias("jr"), F.col("hc").alias("jc"), "doutstart", "uscontarea")
    zero = (
        ups.where(F.col("here") >= n_links).join(end, ["jr", "jc"])
        .select(F.col("here").alias("link"), F.col("jr").alias("hr"), F.col("jc").alias("hc"), F.col("jr").alias("er"), F.col("jc").alias("ec"), F.col("o").alias("strmorder"), F.col("m").alias("magnitude"), F.lit(0.0).alias("length"), F.lit(0.0).alias("drop"), F.lit(0.0).alias("slope"), F.lit(0.0).alias("straightl"), "uscontarea", F.col("uscontarea").alias("dscontarea"), F.col("doutstart").alias("doutend"), "doutstart", F.col("doutstart").alias("doutmid"), F.lit(-1).alias("dsnode"), F.lit(True).alias("shared"))
    )
    whole = links.withColumn("link", F.col("link").cast("long")).unionByName(zero)
    net = (
        whole.join(ups.select(F.col("here").alias("link"), "us1", "us2"), "link", "left").join(downs, "link", "left")
        .select("link", F.coalesce("dslink", F.lit(-1)).alias("dslink"), F.coalesce("us1", F.lit(-1)).alias("us1"), F.coalesce("us2", F.lit(-1)).alias("us2"), F.col("dsnode"), "strmorder", "magnitude", "length", "drop", "slope", "straightl", "uscontarea", "dscontarea", "doutend", "doutstart", "doutmid", "hr", "hc", "er", "ec")
    )
    net = checkpointed(net)
    # the points of a link: its cells, and where it shares one the cell of its end; d: distance to the outlet
    own = member.join(last.select("tr", "tc", "last_step"), ["tr", "tc"], "left").join(net.select("link", "doutend"), "link")
    own = own.select("link", (F.col("hops") + 1).alias("hops"), "row", "col", (F.col("doutend") + F.col("dist") + F.coalesce("last_step", F.lit(0.0))).alias("d"))
    end_points = whole.where("shared").select("link", F.lit(0).alias("hops"), F.col("er").alias("row"), F.col("ec").alias("col"), F.col("doutend").alias("d"))
    points = own.unionByName(end_points).join(values, ["row", "col"]).select("link", "hops", "row", "col", "d", "z", "a")
    first_stream = follow(p, meta, on.select("row", "col")).where("stopped").select("row", "col", "r", "c")
    label = F.lit(1).cast("long") if single_watershed else F.col("link").cast("long")
    watershed = first_stream.join(member.select(F.col("row").alias("r"), F.col("col").alias("c"), "link"), ["r", "c"]).select("row", "col", label.alias("value"))
    return {"links": net, "points": points, "watershed": p.select("row", "col").join(watershed, ["row", "col"], "left"), "order": p.select("row", "col").join(order.withColumnRenamed("ord", "value"), ["row", "col"], "left")}


def catch_outlets(links: DataFrame, p: DataFrame, meta: GridMeta, min_distance: float = 0.0, first_id: int = 1, min_area: float = 0.0) -> DataFrame:
    """id, link, row, col and dist of outlets walked up from each terminal link of links (as stream_net's).

    A terminal link gives its end, one step further down; going up, a link gives its
    start if that is over min_distance above the last outlet and its area over min_area, and the walk ends
    where the area is not.  Each tree is one group; ids count trees by their terminal link, and up from there.
    """
    tree = links.select("link", "dslink", "us1", "us2", "doutend", "doutstart", "uscontarea", "hr", "hc", "er", "ec")
    at = checkpointed(tree.select("link", F.when(F.col("dslink") < 0, F.col("link")).otherwise(F.col("dslink")).alias("to")))
    for _ in range(40):
        nxt = at.select(F.col("link").alias("to"), F.col("to").alias("on"))
        new = checkpointed(at.join(nxt, "to").select("link", F.col("on").alias("to")))
        if new.join(at.select("link", F.col("to").alias("was")), "link").where("to <> was").isEmpty():
            break
        at = new

    def walk(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        at, to = {link: i for i, link in enumerate(g["link"].tolist())}, int(key[0])
        us1, us2, start, area = (g[c].to_numpy() for c in ("us1", "us2", "doutstart", "uscontarea"))
        hr, hc, i = g["hr"].to_numpy(), g["hc"].to_numpy(), at[to]
        root, out = g.iloc[i], []
        if root.us1 >= 0 or root.dslink < 0:
            out.append((to, 0, to, int(root.er), int(root.ec), float(root.doutend), True))
        stack = [(int(u), 0.0) for u in (us2[i], us1[i]) if u >= 0]
        while stack:
            link, last = stack.pop()
            i = at[link]
            if area[i] > min_area:
                if start[i] - last > min_distance and us1[i] >= 0:
                    out.append((to, len(out), link, int(hr[i]), int(hc[i]), float(start[i]), False))
                    last = start[i]
                stack += [(int(u), last) for u in (us2[i], us1[i]) if u >= 0]
        return pd.DataFrame(out, columns=["root", "seq", "link", "row", "col", "dist", "terminal"])

    found = tree.join(at, "link").groupBy("to").applyInPandas(walk, "root long, seq long, link long, row int, col int, dist double, terminal boolean")
    moved = found.join(receivers(p, meta).select("row", "col", "r", "c"), ["row", "col"], "left")
    placed = moved.select("root", "seq", "link", F.when(F.col("terminal"), F.coalesce("r", "row")).otherwise(F.col("row")).alias("row"), F.when(F.col("terminal"), F.coalesce("c", "col")).otherwise(F.col("col")).alias("col"), "dist")
    ids = numbered(placed, [F.col("root"), F.col("seq")], "id")
    return ids.withColumn("id", (F.col("id") + first_id).cast("int")).drop("root", "seq")

"""Terrain and hydrology operators: micro-grids, plain loops, and independence of the tiling."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.functions.grid import STEPS, GridMeta, IncompatibleGrids
from rillflow.operators import direction, flow, local, network, zonal
from rillflow.plans.tiles import checkpointed


def grid(spark, a, kind="double"):
    a = np.asarray(a, float)
    rows = [(r, c, None if math.isnan(a[r, c]) else float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "row int, col int, value double").withColumn("value", F.col("value").cast(kind))


def array(df, shape, column="value"):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", F.col(column).cast("double").alias("v")).collect():
        out[r["row"], r["col"]] = np.nan if r["v"] is None else r["v"]
    return out


def around(a, r, c):
    for k, (dr, dc) in enumerate(STEPS, 1):
        if 0 <= r + dr < a.shape[0] and 0 <= c + dc < a.shape[1]:
            yield k, r + dr, c + dc


def rough(seed=1, shape=(23, 19), top=12):
    rng = np.random.default_rng(seed)
    return np.round(rng.integers(0, top, shape) + 0.5 * np.add.outer(np.arange(shape[0])[::-1], np.abs(np.arange(shape[1]) - 9)))


def brute_fill(z):
    level, heap = np.full(z.shape, np.inf), []
    for r in range(z.shape[0]):
        for c in range(z.shape[1]):
            if not math.isnan(z[r, c]) and sum(not math.isnan(z[i, j]) for _, i, j in around(z, r, c)) < 8:
                level[r, c] = z[r, c]
                heapq.heappush(heap, (z[r, c], r, c))
    while heap:
        w, r, c = heapq.heappop(heap)
        for _, i, j in around(z, r, c):
            if not math.isnan(z[i, j]) and max(z[i, j], w) < level[i, j]:
                level[i, j] = max(z[i, j], w)
                heapq.heappush(heap, (level[i, j], i, j))
    return np.where(np.isnan(z), np.nan, level)


@pytest.mark.parametrize("size", [512, 6])
def test_fill(spark, size):
    z = rough(2)
    z[10:12, 4:6] = np.nan
    meta = GridMeta(*z.shape)
    got = array(direction.fill_pits(grid(spark, z), meta, size=size), z.shape)
    np.testing.assert_array_equal(got, brute_fill(z))


def test_fill_single_pit_and_kept(spark):
    z = np.full((5, 5), 9.0)
    z[2, 2] = 1
    meta = GridMeta(5, 5)
    assert array(direction.fill_pits(grid(spark, z), meta), z.shape)[2, 2] == 9
    kept = np.zeros((5, 5))
    kept[2, 2] = 1
    assert array(direction.fill_pits(grid(spark, z), meta, kept=grid(spark, kept, "int")), z.shape)[2, 2] == 1


@pytest.mark.parametrize("size", [512, 7])
def test_flats_drain(spark, size):
    """After filling, every inner cell drains to the edge without a loop, whatever the tiles."""
    z = brute_fill(rough(3, (24, 20), 5))
    meta = GridMeta(*z.shape)
    p = array(direction.d8_direction(grid(spark, z), meta, size), z.shape, "p")
    if size != 512:
        np.testing.assert_array_equal(p, array(direction.d8_direction(grid(spark, z), meta), z.shape, "p"))
    inner = p[1:-1, 1:-1]
    assert not (inner == 0).any() and np.isnan(p[0]).all() and not np.isnan(inner).any()
    for r in range(1, z.shape[0] - 1):
        for c in range(1, z.shape[1] - 1):
            i, j, n = r, c, 0
            while not math.isnan(p[i, j]):
                dr, dc = STEPS[int(p[i, j]) - 1]
                assert z[i + dr, j + dc] <= z[i, j]
                i, j, n = i + dr, j + dc, n + 1
                assert n < z.size


def test_dinf_plane(spark):
    z = np.add.outer(np.zeros(7), np.arange(7.0))
    ang = array(direction.dinf_direction(grid(spark, z), GridMeta(7, 7)), z.shape, "ang")
    np.testing.assert_allclose(ang[1:-1, 1:-1], math.pi, atol=1e-9)
    slanted = np.add.outer(np.arange(7.0), 2 * np.arange(7.0))
    meta = GridMeta(7, 7)
    a = direction.dinf_first(grid(spark, slanted), meta).select("row", "col", F.col("ang").alias("value"))
    found = array(a, z.shape)
    np.testing.assert_allclose(found[3, 3], math.pi - math.atan2(1, 2), atol=1e-9)


@pytest.mark.parametrize("size", [512, 6])
def test_dinf_flats_tiling(spark, size):
    z = brute_fill(rough(5, (20, 18), 4))
    meta = GridMeta(*z.shape)
    ang = array(direction.dinf_direction(grid(spark, z), meta, size), z.shape, "ang")
    assert not np.isnan(ang[1:-1, 1:-1]).any() and (ang[1:-1, 1:-1] >= 0).all()
    if size != 512:
        np.testing.assert_allclose(ang, array(direction.dinf_direction(grid(spark, z), meta), z.shape, "ang"))


def d8_of(spark, z, meta):
    return checkpointed(direction.d8_direction(grid(spark, z), meta).select("row", "col", F.col("p").cast("int").alias("value")))


def brute_up(p, own, put):
    """put(values of the cell and its donors) by recursion."""
    out = np.full(p.shape, np.nan)

    def at(r, c):
        if math.isnan(out[r, c]):
            donors = [(k, i, j) for k, i, j in around(p, r, c) if p[i, j] == (k + 3) % 8 + 1]
            out[r, c] = put(own[r, c], [at(i, j) for _, i, j in donors])
        return out[r, c]

    for r in range(p.shape[0]):
        for c in range(p.shape[1]):
            if not math.isnan(p[r, c]):
                at(r, c)
    return out


@pytest.mark.parametrize("size", [512, 6])
def test_d8_algebra(spark, size):
    z = brute_fill(rough(4))
    meta = GridMeta(*z.shape)
    p = d8_of(spark, z, meta)
    pa = array(p, z.shape)
    value = np.random.default_rng(1).integers(0, 50, z.shape).astype(float)
    area = array(flow.area_d8(p, meta, check=False, size=size), z.shape)
    np.testing.assert_array_equal(area, brute_up(pa, np.ones(z.shape), lambda v, d: v + sum(d)))
    np.testing.assert_array_equal(array(flow.extreme_up(p, grid(spark, value), meta, check=False, size=size), z.shape), brute_up(pa, value, lambda v, d: max([v, *d])))
    low = brute_up(pa, value, lambda v, d: min([v, *d]))
    np.testing.assert_array_equal(array(flow.condition(p, grid(spark, value), meta, size=size), z.shape), np.where(np.isnan(low), value, low))
    order = brute_up(pa, z, lambda v, d: 1 if not d else max(max(d), sorted(d)[-2] + 1 if len(d) > 1 else 0))
    net = flow.grid_net(p, meta, size=size)
    np.testing.assert_array_equal(array(net, z.shape, "gord"), order)
    plen, tlen = array(net, z.shape, "plen"), array(net, z.shape, "tlen")
    assert (plen[~np.isnan(plen)] <= tlen[~np.isnan(tlen)] + 1e-9).all()
    stream = checkpointed(local.threshold(grid(spark, area), 6))
    h = array(flow.hdist_d8(p, stream, meta, size=size), z.shape)
    s = array(stream, z.shape)
    for r in range(z.shape[0]):
        for c in range(z.shape[1]):
            i, j, d = r, c, 0.0
            while not math.isnan(pa[i, j]) and s[i, j] != 1:
                dr, dc = STEPS[int(pa[i, j]) - 1]
                i, j, d = i + dr, j + dc, d + math.hypot(dr, dc)
            want = np.nan if math.isnan(pa[r, c]) or math.isnan(pa[i, j]) else d
            np.testing.assert_allclose(h[r, c], want)


def test_contamination(spark):
    z = np.add.outer(np.zeros(6), np.arange(6.0)[::-1])
    p = array(d8_of(spark, z, GridMeta(6, 6)), z.shape)
    assert (p[1:-1, 1:-1] == 1).all()
    checked = array(flow.area_d8(d8_of(spark, z, GridMeta(6, 6)), GridMeta(6, 6)), z.shape)
    assert np.isnan(checked).all()
    free = array(flow.area_d8(d8_of(spark, z, GridMeta(6, 6)), GridMeta(6, 6), check=False), z.shape)
    np.testing.assert_array_equal(free[2, 1:5], [1, 2, 3, 4])


@pytest.mark.parametrize("size", [512, 6])
def test_dinf_algebra(spark, size):
    z = rough(6, (18, 15), 3) + np.add.outer(3.0 * np.arange(18)[::-1], np.zeros(15))
    z = brute_fill(z)
    meta = GridMeta(*z.shape)
    ang = checkpointed(direction.dinf_direction(grid(spark, z), meta).select("row", "col", F.col("ang").alias("value")))
    a = array(ang, z.shape)
    links = {}
    for r in range(z.shape[0]):
        for c in range(z.shape[1]):
            for k, i, j in around(z, r, c):
                w = float(flow.shares(np.array([a[r, c]]), k, np.ones(1), np.ones(1))[0])
                if w > 0 and not math.isnan(a[i, j]):
                    links.setdefault((r, c), []).append((i, j, w))
    assert all(abs(sum(w for *_, w in v) - 1) < 1e-4 for k, v in links.items() if len(v) == 2)
    weight = np.random.default_rng(2).integers(0, 9, z.shape) / 2
    total = np.where(np.isnan(a), np.nan, weight)
    mass = {k: weight[k] for k in np.ndindex(z.shape) if not math.isnan(a[k])}
    for _ in range(400):
        moved = {}
        for k, v in mass.items():
            for i, j, w in links.get(k, ()):
                moved[i, j] = moved.get((i, j), 0) + v * w
        for k, v in moved.items():
            total[k] += v
        mass = moved
    np.testing.assert_allclose(array(flow.area_dinf(ang, meta, grid(spark, weight), check=False, size=size), z.shape), total, rtol=1e-9)
    cap = np.full(z.shape, 4.0)
    found = flow.trans_lim_accum(ang, grid(spark, weight), grid(spark, cap), meta, check=False, size=size)
    tla, dep = array(found, z.shape, "tla"), array(found, z.shape, "tdep")
    assert np.nanmax(tla) <= 4 and np.nanmin(dep) >= 0
    runoff = array(flow.ret_lim_flow(ang, grid(spark, weight), grid(spark, cap / 4), meta, size=size), z.shape)
    assert np.nanmin(runoff) >= 0
    mark = (np.random.default_rng(3).random(z.shape) < 0.1).astype(float)
    part = array(flow.up_dependence(ang, grid(spark, mark), meta, size=size), z.shape)
    assert np.nanmin(part) >= 0 and np.nanmax(part) <= 1 + 1e-9
    for kind in "hvps":
        lo, mid, hi = (array(flow.dist_down(ang, grid(spark, z), grid(spark, mark), meta, kind, s, check=False, size=size), z.shape) for s in ("min", "ave", "max"))
        ok = ~np.isnan(lo)
        assert (lo[ok] <= mid[ok] + 1e-9).all() and (mid[ok] <= hi[ok] + 1e-9).all()


def test_networks(spark):
    z = brute_fill(rough(7, (30, 25), 4) + np.add.outer(2.0 * np.arange(30)[::-1], np.zeros(25)))
    meta = GridMeta(*z.shape)
    p = d8_of(spark, z, meta)
    pa = array(p, z.shape)
    area = checkpointed(flow.area_d8(p, meta, check=False))
    stream = checkpointed(local.threshold(area, 8))
    net = network.stream_net(p, grid(spark, z), area, stream, meta)
    links = {r["link"]: r for r in net["links"].collect()}
    s, a = array(stream, z.shape), array(area, z.shape)
    heads = 0
    for r in range(z.shape[0]):
        for c in range(z.shape[1]):
            if s[r, c] == 1:
                n = sum(s[i, j] == 1 and pa[i, j] == (k + 3) % 8 + 1 for k, i, j in around(z, r, c))
                heads += 1 if n == 0 else n - 1 if n > 1 else 0
    assert len(links) == heads
    for k, r in links.items():
        assert r["dslink"] == -1 or k in (links[r["dslink"]]["us1"], links[r["dslink"]]["us2"])
        if r["us1"] >= 0 and r["us2"] >= 0:
            assert r["magnitude"] == links[r["us1"]]["magnitude"] + links[r["us2"]]["magnitude"]
            o = sorted((links[r["us1"]]["strmorder"], links[r["us2"]]["strmorder"]))
            assert r["strmorder"] >= max(o[1], o[0] + 1) - 0
        else:
            assert r["us1"] == -1 and r["strmorder"] == 1
        assert abs(r["doutstart"] - r["doutend"] - r["length"]) < 1e-9 and r["drop"] >= 0
    w = array(net["watershed"], z.shape)
    for r in range(z.shape[0]):
        for c in range(z.shape[1]):
            if not math.isnan(pa[r, c]):
                dr, dc = STEPS[int(pa[r, c]) - 1]
                if s[r, c] != 1 and not math.isnan(pa[r + dr, c + dc]):
                    assert w[r, c] == w[r + dr, c + dc] or (math.isnan(w[r, c]) and math.isnan(w[r + dr, c + dc]))
    ends = spark.createDataFrame([(int(c), int(r), int(c)) for r in (28,) for c in range(1, 24)], "id int, row int, col int")
    drops = network.drop_statistics(p, grid(spark, z), area, area, ends, meta, [4.0, 8.0]).collect()
    assert all(r["n_first"] > 1 and r["mean_first"] >= 0 for r in drops)
    catch = network.catch_outlets(net["links"], p, meta, 3.0, 5, 10.0).toPandas()
    assert sorted(catch["id"]) == list(range(5, 5 + len(catch)))
    assert np.nansum(a) > 0


def test_zonal_brackets(spark):
    table = spark.createDataFrame([(1, 1.0, 10.0), (1, 2.0, 20.0), (1, 4.0, 80.0)], "id int, stage double, flow double")
    asked = spark.createDataFrame([(1, 15.0), (1, 20.0), (1, 5.0), (1, 90.0), (2, 1.0)], "id int, flow double")
    found = {(r["id"], r["flow"]): r["stage"] for r in zonal.stage_of_flow(asked, table).collect()}
    assert found == {(1, 15.0): 1.5, (1, 20.0): 2.0, (1, 5.0): None, (1, 90.0): None, (2, 1.0): None}
    assert {r["flow"]: r["stage"] for r in zonal.stage_of_flow(asked, table, compat=True).collect()}[20.0] is None


def test_stability_probability():
    """The index against random draws."""
    rng = np.random.default_rng(0)
    args = dict(tmin=2.0, tmax=3.0, cmin=0.0, cmax=0.25, phimin=30.0, phimax=45.0, density=2000.0)
    for slope, area in ((0.8, 300.0), (1.2, 1500.0), (0.9, 40.0)):
        si = float(local.sinmap_cells(np.array([[slope, area, 0.0, 0.0, *args.values()]] * 2).T, 0.0009, 0.00135, 9.81, 1000.0)[0][1])
        theta = math.atan(slope)
        x1, x2 = area * 0.0009 / 3.0 / math.sin(theta), area * 0.00135 / 2.0 / math.sin(theta)
        w = np.minimum(rng.uniform(x1, x2, 400_000), 1)
        c, t = rng.uniform(0, 0.25, 400_000), rng.uniform(math.tan(math.radians(30)), math.tan(math.radians(45)), 400_000)
        fs = (c + math.cos(theta) * (1 - w * 0.5) * t) / math.sin(theta)
        if 0 < si < 1:
            assert abs(si - (fs > 1).mean()) < 5e-3
    flat = local.sinmap_cells(np.array([[0.0, 1.0, 0, 0, *args.values()], [-1.0, 1.0, 0, 0, *args.values()]]).T, 0.1, 0.2, 9.81, 1000.0)
    assert [x[0] for x in flat] == [10.0, 3.0] and np.isnan([x[1] for x in flat]).all()


def test_compatible():
    assert GridMeta(3, 4).assert_compatible(GridMeta(3, 4)) == []
    assert len(GridMeta(3, 4).assert_compatible(GridMeta(3, 4, xleft=1.0))) == 1
    with pytest.raises(IncompatibleGrids):
        GridMeta(3, 4).assert_compatible(GridMeta(4, 3))


def test_tiles_that_do_not_settle_are_an_error(spark):
    from rillflow.plans import tiles

    cells = spark.createDataFrame([(r, c, 1.0) for r in range(8) for c in range(8)], "row int, col int, x double")
    run = lambda rounds: tiles.solve(cells, GridMeta(8, 8), lambda patch: {"v": patch.values["x"].ravel()}, ["v"], ["v"], size=4, rounds=rounds)
    with pytest.raises(RuntimeError, match="settle"):
        run(1)
    assert run(2).count() == 64


def test_a_long_path_settles_in_few_rounds(spark):
    """Fifty tiles in a row take no round each: they exchange their rims in one task."""
    from rillflow.plans import tiles

    meta = GridMeta(200, 4)
    cells = spark.range(800).select((F.col("id") / 4).cast("int").alias("row"), (F.col("id") % 4).cast("int").alias("col"), F.lit(1.0).alias("x"))

    def kernel(p):
        v = np.where(p.inside, np.nan, p.rim["v"]).reshape(p.h + 2, p.width)
        for r in range(1, p.h + 1):
            v[r, 1:-1] = 1 if p.row0 + r == 1 else v[r - 1, 1:-1] + 1
        return {"v": v.ravel()}

    found = array(tiles.solve(cells, meta, kernel, ["v"], ["v"], size=4, rounds=5), (200, 4), "v")
    np.testing.assert_array_equal(found, np.repeat(np.arange(1.0, 201)[:, None], 4, 1))


@pytest.mark.parametrize("bytes_", [1, 40_000])
def test_blocks(spark, monkeypatch, bytes_):
    """Results do not depend on how tiles are dealt to blocks."""
    from rillflow.plans import tiles

    z = rough(4, (24, 20))
    filled = brute_fill(z)
    meta = GridMeta(*z.shape)
    p = d8_of(spark, filled, meta)
    ang = checkpointed(direction.dinf_direction(grid(spark, filled), meta).select("row", "col", F.col("ang").alias("value")))
    area = checkpointed(flow.area_d8(p, meta, check=False))
    ends = spark.createDataFrame([(22, c, c) for c in range(1, 19)], "row int, col int, id int")
    mark = (np.random.default_rng(3).random(z.shape) < 0.1).astype(float)

    def results(size):
        yield array(direction.fill_pits(grid(spark, z), meta, size=size), z.shape)
        yield array(direction.d8_direction(grid(spark, filled), meta, size), z.shape, "p")
        yield array(flow.area_d8(p, meta, check=False, size=size), z.shape)
        yield array(flow.area_d8(p, meta, outlets=ends, size=size), z.shape)
        yield array(flow.area_dinf(ang, meta, check=False, size=size), z.shape)
        yield array(flow.avalanche(ang, grid(spark, z), grid(spark, mark), meta, alpha=1.0, size=size), z.shape, "dm")
        yield array(flow.dist_down(ang, grid(spark, z), grid(spark, mark), meta, "p", "max", size=size), z.shape)
        drops = network.drop_statistics(p, grid(spark, filled), area, area, ends, meta, [2.0, 4.0], size).orderBy("threshold").collect()
        assert drops
        yield np.array([[np.nan if v is None else float(v) for v in r] for r in drops])

    want = list(results(512))
    monkeypatch.setattr(tiles, "BLOCK_BYTES", bytes_)
    for a, b in zip(want, results(6)):
        np.testing.assert_allclose(b, a)


def test_distances_together(spark):
    """All kinds and stats in one evaluation are those found one by one."""
    z = brute_fill(rough(6, (18, 15), 3) + np.add.outer(3.0 * np.arange(18)[::-1], np.zeros(15)))
    meta = GridMeta(*z.shape)
    ang = checkpointed(direction.dinf_direction(grid(spark, z), meta).select("row", "col", F.col("ang").alias("value")))
    mark = grid(spark, (np.random.default_rng(3).random(z.shape) < 0.1).astype(float))
    dem = np.where(np.random.default_rng(4).random(z.shape) < 0.05, np.nan, z)
    down = flow.distances_down(ang, grid(spark, dem), mark, meta).cache()
    up = flow.distances_up(ang, grid(spark, dem), meta, check=False).cache()
    for kind in "hvps":
        np.testing.assert_array_equal(array(down, z.shape, f"{kind}_max"), array(flow.dist_down(ang, grid(spark, dem), mark, meta, kind, "max"), z.shape))
        np.testing.assert_array_equal(array(up, z.shape, f"{kind}_ave"), array(flow.dist_up(ang, grid(spark, dem), meta, kind, "ave", check=False), z.shape))


def test_many_rows_in_small_files_are_not_broadcast(spark):
    """A checkpoint of few bytes and many rows is joined by sorting."""
    a, b = (checkpointed(spark.range(300_000).select((F.col("id") / 1000).cast("int").alias("row"), (F.col("id") % 1000).cast("int").alias("col"), F.lit(None).cast("double").alias(n))) for n in "xy")
    plan = a.join(b, ["row", "col"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert a.join(b, ["row", "col"]).count() == 300_000


def test_junctions_of_one_to_three_links(spark):
    """Two links meet without Python; of three, a link of length 0 takes the first two."""
    p = np.full((7, 7), np.nan)
    p[1, 2], p[1, 3], p[1, 4], p[2, 3], p[3, 3], p[4, 3], p[3, 2], p[5, 3] = 8, 7, 6, 7, 7, 7, 8, 7
    meta, z = GridMeta(7, 7), np.add.outer(np.arange(7.0)[::-1], np.zeros(7))
    pd8 = checkpointed(grid(spark, p).select("row", "col", F.col("value").cast("int").alias("value")))
    area = checkpointed(flow.area_d8(pd8, meta, check=False))
    net = {r["link"]: r for r in network.stream_net(pd8, grid(spark, z), area, checkpointed(local.threshold(area, 1)), meta)["links"].collect()}
    assert {k: (r["us1"], r["us2"], r["dslink"], r["strmorder"], r["magnitude"]) for k, r in net.items()} == {
        0: (-1, -1, 6, 1, 1), 1: (-1, -1, 6, 1, 1), 2: (-1, -1, 3, 1, 1), 3: (6, 2, 5, 2, 3), 4: (-1, -1, 5, 1, 1), 5: (3, 4, -1, 2, 4), 6: (0, 1, 3, 2, 2)
    }
    assert net[6]["length"] == 0

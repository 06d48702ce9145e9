"""Command line over raster files: `python -m rillflow.cli TOOL -flag value ...`.

Flags and their simple form (one file, the others named by suffix) follow the
suite's conventions; each tool reads grids, applies one operator and writes grids.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.grid import GridMeta, place_of
from .operators import direction, flow, local, network, zonal
from .plans import workflows
from .sources import geotiff, rawgrid, tables, vector


def read_grid(spark: SparkSession, path: str) -> tuple[DataFrame, GridMeta]:
    return (rawgrid if path.lower().endswith((".bil", ".bin", ".sdat")) else geotiff).read(spark, path)


def write_grid(cells: DataFrame, meta: GridMeta, path: str, kind: str = "float") -> None:
    dtype, nodata = {"float": ("<f4", -3.4028234663852886e38), "short": ("<i2", -32768.0), "int": ("<i4", -2147483647.0)}[kind]
    meta = meta.with_nodata(nodata)
    if path.lower().endswith((".bil", ".bin", ".sdat")):
        rawgrid.write(cells, meta, path, dtype)
    else:
        geotiff.write(cells, meta, path if path.lower().endswith((".tif", ".tiff")) else f"{path}.tif", dtype)


class Job:
    """Flags of one call; the first input's header is the grid's."""

    def __init__(self, spark: SparkSession, args: list[str], simple: tuple[str, ...] = ()):
        self.spark, self.flags, self.meta = spark, {}, None
        if len(args) == 1 and not args[0].startswith("-"):
            self.flags = {f.partition(".")[0]: [args[0] if i == 0 and f == "z" else tables.name_add(args[0], f)] for i, f in enumerate(simple)}
            return
        name = ""
        for a in args:
            if a.startswith("-") and not a[1:2].isdigit() and a[1:2] != ".":
                name = a[1:]
                self.flags[name] = []
            elif name:
                self.flags[name].append(a)
            else:
                raise SystemExit(f"no flag before {a}")

    def has(self, name: str) -> bool:
        return name in self.flags

    def path(self, name: str) -> str:
        if not self.flags.get(name):
            raise SystemExit(f"-{name} is missing")
        return self.flags[name][0]

    def number(self, name: str, default: float, i: int = 0) -> float:
        return float(self.flags[name][i]) if len(self.flags.get(name, ())) > i else default

    def grid(self, name: str) -> DataFrame | None:
        if name not in self.flags:
            return None
        cells, meta = read_grid(self.spark, self.path(name))
        if self.meta is None:
            self.meta = meta
        else:
            for warning in self.meta.assert_compatible(meta):
                print(warning, file=sys.stderr)
        return cells

    def outlets(self) -> DataFrame | None:
        return vector.read_outlets(self.spark, self.path("o"), self.meta) if self.has("o") else None

    def put(self, name: str, cells: DataFrame, kind: str = "float", column: str = "value") -> None:
        if self.flags.get(name):
            write_grid(cells.select("row", "col", F.col(column).alias("value")), self.meta, self.path(name), kind)


def _pitremove(j: Job) -> None:
    dem, mask = j.grid("z"), j.grid("depmask")
    j.put("fel", direction.fill_pits(dem, j.meta, j.has("4way"), mask))


def _d8flowdir(j: Job) -> None:
    dem = j.grid("fel")
    found = direction.d8_direction(dem, j.meta)
    j.put("p", found, "short", "p")
    j.put("sd8", found, column="slope")


def _dinfflowdir(j: Job) -> None:
    dem = j.grid("fel")
    found = direction.dinf_direction(dem, j.meta)
    j.put("ang", found, column="ang")
    j.put("slp", found, column="slope")


def _gridnet(j: Job) -> None:
    p, mask = j.grid("p"), j.grid("mask")
    found = flow.grid_net(p, j.meta, mask, j.number("thresh", 0.0), j.outlets())
    for name, kind in (("plen", "float"), ("tlen", "float"), ("gord", "short")):
        j.put(name, found, kind, name)


def _streamnet(j: Job) -> None:
    dem, p, area, src = (j.grid(n) for n in ("fel", "p", "ad8", "src"))
    found = network.stream_net(p, dem, area, src, j.meta, j.outlets(), j.has("sw"))
    j.put("ord", found["order"], "short")
    j.put("w", found["watershed"], "int")
    path = lambda n: j.path(n) if j.has(n) else None
    tables.write_network(found["links"], found["points"], j.meta, path("tree"), path("coord"))
    if j.has("net"):
        vector.write_layer(tables.net_layer(found["links"], found["points"], j.meta), j.path("net"))


def _distance(down: bool) -> Callable[[Job], None]:
    def run(j: Job) -> None:
        ang, dem, src, weight = (j.grid(n) for n in ("ang", "fel", "src", "wg"))
        modes = [m[:3].lower() for m in j.flags.get("m", [])]
        kind = next((m[0] for m in modes if m[0] in "hvps"), "h")
        stat = next((m for m in modes if m in ("ave", "max", "min")), "ave")
        if down:
            j.put("dd", flow.dist_down(ang, dem, src, j.meta, kind, stat, weight, not j.has("nc")))
        else:
            j.put("du", flow.dist_up(ang, dem, j.meta, kind, stat, weight, j.number("thresh", 0.0), not j.has("nc")))

    return run


def _one(output: str, inputs: str, make: Callable[..., DataFrame], kind: str = "float") -> Callable[[Job], None]:
    def run(j: Job) -> None:
        j.put(output, make(j, *(j.grid(n) for n in inputs.split())), kind)

    return run


def _two(inputs: str, make: Callable[..., DataFrame], *outputs: str, names: tuple[str, ...] = ()) -> Callable[[Job], None]:
    def run(j: Job) -> None:
        found = make(j, *(j.grid(n) for n in inputs.split()))
        for o, c in zip(outputs, names or outputs):
            if c in found.columns:
                j.put(o, found, column=c)

    return run


def _points(make: Callable[[Job], DataFrame], out: str) -> Callable[[Job], None]:
    def run(j: Job) -> None:
        found = make(j)
        x, y = F.lit(j.meta.xleft + j.meta.dx / 2) + F.col("col") * j.meta.dx, F.lit(j.meta.ytop - j.meta.dy / 2) - F.col("row") * j.meta.dy
        vector.write_layer(found.withColumns({"x": x, "y": y}).drop("row", "col", "props"), j.path(out))

    return run


def _move(j: Job) -> DataFrame:
    p, src = j.grid("p"), j.grid("src")
    return network.move_outlets(p, src, j.outlets().drop("x", "y"), j.meta, int(j.number("md", 50)))


def _connect(j: Job) -> None:
    p, w, area = j.grid("p"), j.grid("w"), j.grid("ad8")
    found = network.connect_down(p, w, area, j.meta, int(j.number("d", 10)))
    _points(lambda _: found.select("id", "id_down", "ad8", "row", "col"), "o")(j)
    if j.has("od"):
        _points(lambda _: found.select("id", "id_down", "ad8", F.col("r").alias("row"), F.col("c").alias("col")), "od")(j)


def _gage(j: Job) -> None:
    p = j.grid("p")
    gages = j.outlets().select("id", "row", "col")
    j.put("gw", network.gage_watershed(p, gages, j.meta), "int")
    if j.has("id"):
        tables.write(network.gage_links(p, gages, j.meta), j.path("id"), " ")
    if j.has("upid"):
        x, y = place_of(F.col("row"), F.col("col"), j.meta)
        edge = network.open_neighbours(p, network.gage_watershed(p, gages, j.meta), j.meta)
        edge.select(F.format_string("%f, %f", x, y)).write.mode("overwrite").text(j.path("upid"))


def _catch(j: Job) -> None:
    """Outlets from a stream layer: LINKNO, DSLINKNO, USLINKNO1, USLINKNO2, DOUTEND and Id at their places."""
    p = j.grid("p")
    net = vector.read_lines(j.spark, j.path("net"), j.meta)
    found = network.catch_outlets(net, p, j.meta, j.number("mindist", 0), int(j.number("gwstartno", 1)), j.number("minarea", 0))
    own = net.select("link", "dslink", "us1", "us2")
    _points(lambda _: found.join(own, "link").select(F.col("link").alias("LINKNO"), F.col("dslink").alias("DSLINKNO"), F.col("us1").alias("USLINKNO1"), F.col("us2").alias("USLINKNO2"), F.col("dist").alias("DOUTEND"), F.col("id").alias("Id"), "row", "col"), "o")(j)


def _stability(j: Job) -> None:
    """The stability index by a control file of key=value lines."""
    keys = tables.read_control(j.spark, j.path("params"))
    j.flags |= {k: [v] for k, v in keys.items()}
    slope, ang, cal = j.grid("slp"), j.grid("ang"), j.grid("cal")
    number = lambda name, default: float(keys.get(name) or default)
    if keys.get("sca"):
        j.put("sca", flow.area_dinf(ang, j.meta, check=False))
    found = workflows.stability(slope, ang, cal, tables.read(j.spark, keys["calpar"], tables.REGIONS), j.meta, number("minimumterrainrecharge", 0.0009), number("maximumterrainrecharge", 0.00135), g=number("g", 9.81), rhow=number("rhow", 1000.0))
    j.put("si", found, column="si")
    j.put("sat", found, column="sat")


def _copy(j: Job) -> None:
    points = vector.read_points(j.spark, j.path("in"))
    fields = sorted(r[0] for r in points.select(F.explode(F.map_keys("props"))).distinct().collect())  # the layer's field names
    vector.write_layer(points.select("x", "y", *(F.col("props")[n].alias(n) for n in fields)), j.path("out"))


def _verify(j: Job) -> None:
    """How many cells of two grids differ by more than a tolerance."""
    a, b = j.grid("a"), j.grid("b")
    other, gap = F.col("other"), F.abs(F.col("value") - F.col("other"))
    differs = F.coalesce(gap > j.number("tol", 0.0), F.col("value").isNull() != other.isNull())
    found = a.join(b.withColumnRenamed("value", "other"), ["row", "col"], "full").agg(F.count("*").alias("cells"), F.count_if(differs).alias("differing"), F.max(gap).alias("most")).first()
    print(f"{found['differing']} of {found['cells']} cells differ; largest difference {found['most']}")


def _drop(j: Job) -> None:
    area, p, dem, ssa = (j.grid(n) for n in ("ad8", "p", "fel", "ssa"))
    steps = network.drop_thresholds(j.number("par", 5, 0), j.number("par", 500, 1), int(j.number("par", 10, 2)), j.number("par", 0, 3) == 0)
    tables.write_drops(network.drop_statistics(p, dem, ssa, area, j.outlets(), j.meta, steps), j.path("drp"), max(steps))


def _edit(j: Job) -> None:
    cells = j.grid("in")
    j.put("out", local.edit_raster(cells, tables.read_edits(j.spark, j.path("changes")), j.meta), "short")


def _hydro(j: Job) -> None:
    hand, catch, slope = j.grid("hand"), j.grid("catch"), j.grid("slp")
    stages = [r["stage"] for r in tables.read(j.spark, j.path("h"), tables.STAGES).collect()]
    tables.write(zonal.hydraulic_table(hand, catch, tables.read(j.spark, j.path("catchlist"), tables.CATCHMENTS), slope, stages, j.meta).toDF(*tables.RATING_HEADINGS), j.path("table"))


def _inundation(j: Job) -> None:
    hand, catch, mask = j.grid("hand"), j.grid("catch"), j.grid("mask")
    stages = zonal.stage_of_flow(tables.read(j.spark, j.path("fc"), tables.FORECAST), tables.read(j.spark, j.path("hp"), tables.RATING))
    j.put("inun", zonal.inundation(hand, catch, stages, mask))
    if j.has("depth"):
        tables.write(zonal.inundated_area(hand, catch, stages, j.meta).toDF(*tables.INUNDATION_HEADINGS).na.fill(-9999.0), j.path("depth"))


def _sinmap(j: Job) -> None:
    slope, area, cal, lo, hi = (j.grid(n) for n in ("slp", "sca", "cal", "scamin", "scamax"))
    par = [j.number("par", v, i) for i, v in enumerate((0.0009, 0.00135, 9.81, 1000.0))]
    found = local.stability_index(slope, area, cal, tables.read(j.spark, j.path("calpar"), tables.REGIONS), *par, lo, hi)
    j.put("si", found, column="si")
    j.put("sat", found, column="sat")


CHECK = lambda j: {"outlets": j.outlets(), "check": not j.has("nc")}
TOOLS: dict[str, tuple[Callable[[Job], None], tuple[str, ...]]] = {
    "pitremove": (_pitremove, ("z", "fel")),
    "d8flowdir": (_d8flowdir, ("fel", "p", "sd8")),
    "dinfflowdir": (_dinfflowdir, ("fel", "ang", "slp")),
    "aread8": (_one("ad8", "p wg", lambda j, p, w: flow.area_d8(p, j.meta, w, **CHECK(j))), ("p", "ad8")),
    "areadinf": (_one("sca", "ang wg", lambda j, a, w: flow.area_dinf(a, j.meta, w, **CHECK(j))), ("ang", "sca")),
    "gridnet": (_gridnet, ("p", "plen", "tlen", "gord")),
    "peukerdouglas": (_one("ss", "fel", lambda j, z: direction.peuker_douglas(z, j.meta, *(j.number("par", v, i) for i, v in enumerate((0.4, 0.1, 0.05)))), "short"), ("fel", "ss")),
    "d8flowpathextremeup": (_one("ssa", "p sa", lambda j, p, a: flow.extreme_up(p, a, j.meta, not j.has("min"), **CHECK(j))), ("p", "sa", "ssa")),
    "slopearea": (_one("sa", "slp sca", lambda j, s, a: local.slope_area(s, a, j.number("par", 2, 0), j.number("par", 1, 1))), ("slp", "sca", "sa")),
    "lengtharea": (_one("ss", "plen ad8", lambda j, length, a: local.length_area(length, a, j.number("par", 0.03, 0), j.number("par", 1.3, 1)), "short"), ("plen", "ad8", "ss")),
    "dropanalysis": (_drop, ()),
    "threshold": (_one("src", "ssa mask", lambda j, a, m: local.threshold(a, j.number("thresh", 100), m), "short"), ("ssa", "src")),
    "streamnet": (_streamnet, ("fel", "p", "ad8", "src", "ord", "tree.dat", "coord.dat", "net.shp", "w")),
    "moveoutletstostreams": (_points(_move, "om"), ()),
    "gagewatershed": (_gage, ()),
    "connectdown": (_connect, ()),
    "catchoutlets": (_catch, ()),
    "stabilityindex": (_stability, ()),
    "ogrcopy": (_copy, ()),
    "demverify": (_verify, ()),
    "d8hdisttostrm": (_one("dist", "p src", lambda j, p, s: flow.hdist_d8(p, s, j.meta, j.number("thresh", 1))), ("p", "src", "dist")),
    "d8vdisttostrm": (_one("dist", "p fel src", lambda j, p, z, s: flow.vdist_d8(p, z, s, j.meta, j.number("thresh", 1))), ("p", "fel", "src", "dist")),
    "dinfdistdown": (_distance(True), ("ang", "fel", "src", "dd")),
    "dinfdistup": (_distance(False), ("ang", "fel", "du")),
    "dinfrevaccum": (_two("ang wg", lambda j, a, w: flow.rev_accum(a, w, j.meta), "racc", "dmax"), ("ang", "wg", "racc", "dmax")),
    "dinfupdependence": (_one("dep", "ang dg", lambda j, a, g: flow.up_dependence(a, g, j.meta)), ("ang", "dg", "dep")),
    "dinfdecayaccum": (_one("dsca", "ang dm wg", lambda j, a, d, w: flow.decay_accum(a, d, j.meta, w, **CHECK(j))), ("ang", "dm", "dsca")),
    "dinfconclimaccum": (_one("ctpt", "ang dm q dg", lambda j, a, d, q, g: flow.conc_lim_accum(a, d, q, g, j.meta, j.number("csol", 1), **CHECK(j))), ("ang", "dm", "q", "dg", "ctpt")),
    "dinftranslimaccum": (_two("ang tsup tc cs", lambda j, a, s, c, k: flow.trans_lim_accum(a, s, c, j.meta, k, **CHECK(j)), "tla", "tdep", "ctpt"), ("ang", "tsup", "tc", "tla", "tdep")),
    "dinfavalanche": (_two("ang fel ass", lambda j, a, z, s: flow.avalanche(a, z, s, j.meta, j.number("thresh", 0.2), j.number("alpha", 18), j.has("direct")), "rz", "dfs", names=("rz", "dm")), ("ang", "fel", "ass", "rz", "dfs")),
    "slopearearatio": (_one("sar", "slp sca", lambda j, s, a: local.slope_area_ratio(s, a)), ("slp", "sca", "sar")),
    "slopeavedown": (_one("slpd", "p fel", lambda j, p, z: flow.slope_ave_down(p, z, j.meta, j.number("dn", 50))), ("p", "fel", "slpd")),
    "twi": (_one("twi", "slp sca", lambda j, s, a: local.wetness_index(s, a)), ("slp", "sca", "twi")),
    "catchhydrogeo": (_hydro, ()),
    "inundepth": (_inundation, ()),
    "editraster": (_edit, ()),
    "flowdircond": (_one("zfdc", "p z", lambda j, p, z: flow.condition(p, z, j.meta)), ("z", "p", "zfdc")),
    "retlimflow": (_one("qrl", "ang wg rc", lambda j, a, w, r: flow.ret_lim_flow(a, w, r, j.meta)), ("ang", "wg", "rc", "qrl")),
    "setregion": (_one("out", "p gw", lambda j, p, g: local.set_region(p, g, int(j.number("id", 1))), "int"), ()),
    "sinmapsi": (_sinmap, ()),
}


def run(spark: SparkSession, args: list[str]) -> None:
    if not args or args[0] not in TOOLS:
        raise SystemExit("tools: " + " ".join(sorted(TOOLS)))
    tool, simple = TOOLS[args[0]]
    tool(Job(spark, args[1:], simple))


if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), sys.argv[1:])

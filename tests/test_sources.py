"""Round trips of raster and vector files, and the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow import cli
from rillflow.functions.grid import GridMeta
from rillflow.sources import geotiff, rawgrid, tables, vector

META = GridMeta(70, 9, 30.0, 20.0, 100.0, 900.0, False, "", -9999.0)


def cells(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(r, c, None if (r + c) % 11 == 0 else float(rng.integers(-50, 50))) for r in range(70) for c in range(9)], "row int, col int, value double")


def content(df):
    return {(r["row"], r["col"]): r["value"] for r in df.collect()}


@pytest.mark.parametrize("compress", ["lzw", "deflate", "none"])
@pytest.mark.parametrize("dtype", ["<f4", "<i2", "<i4", "<f8"])
def test_geotiff(spark, tmp_path, compress, dtype):
    df = cells(spark)
    geotiff.write(df, META, f"file://{tmp_path}/a.tif", dtype, compress)
    back, meta = geotiff.read(spark, f"file://{tmp_path}/a.tif")
    assert meta == META and content(back) == content(df)


def test_lzw():
    rng = np.random.default_rng(2)
    for data in (b"", b"a", b"abab" * 5000, rng.integers(0, 256, 30000).astype("u1").tobytes(), rng.integers(0, 3, 60000).astype("u1").tobytes()):
        assert geotiff.lzw_decoded(geotiff.lzw_encoded(data)) == data


@pytest.mark.parametrize("name", ["a.bil", "a.bin"])
def test_raw(spark, tmp_path, name):
    df = cells(spark)
    rawgrid.write(df, META, f"file://{tmp_path}/{name}")
    back, meta = rawgrid.read(spark, f"file://{tmp_path}/{name}")
    assert (meta.nrows, meta.ncols, meta.dx, meta.dy, meta.xleft, meta.ytop) == (70, 9, 30.0, 20.0, 100.0, 900.0)
    assert content(back) == content(df)


def test_saga(spark, tmp_path):
    df, meta = cells(spark).where("row <> 65"), GridMeta(70, 9, 30.0, 30.0, 100.0, 900.0, False, "", -9999.0)
    rawgrid.write(df, meta, f"file://{tmp_path}/a.sdat")
    back, found = rawgrid.read(spark, f"file://{tmp_path}/a.sdat")
    assert found == meta and {k: v for k, v in content(back).items() if k[0] != 65} == content(df)
    head, body = (tmp_path / "a.sgrd").read_text(), (tmp_path / "a.sdat").read_bytes()
    (tmp_path / "b.sgrd").write_text(head.replace("TOPTOBOTTOM\t= TRUE", "TOPTOBOTTOM\t= FALSE"))
    (tmp_path / "b.sdat").write_bytes(b"".join(body[k * 36 : k * 36 + 36] for k in range(69, -1, -1)))
    assert content(rawgrid.read(spark, f"file://{tmp_path}/b.sdat")[0]) == content(back)


def test_strips_without_cells(spark, tmp_path):
    df = cells(spark).where("row between 20 and 25")
    geotiff.write(df, META, f"file://{tmp_path}/a.tif", strip_rows=8)
    back, _ = geotiff.read(spark, f"file://{tmp_path}/a.tif")
    assert {k: v for k, v in content(back).items() if 20 <= k[0] <= 25} == content(df) and back.where("value is not null and not row between 20 and 25").count() == 0


@pytest.mark.parametrize("ext", ["geojson", "kml", "shp"])
def test_points(spark, tmp_path, ext):
    df = spark.createDataFrame([(7, 115.0, 885.0, "a"), (9, 145.0, 845.0, "b")], "id int, x double, y double, name string")
    path = f"file://{tmp_path}/p.{ext}"
    vector.write_layer(df, path)
    found = sorted((r["id"], r["row"], r["col"], r["x"], r["y"], r["props"]["name"]) for r in vector.read_outlets(spark, path, META).collect())
    assert found == [(7, 0, 0, 115.0, 885.0, "a"), (9, 2, 1, 145.0, 845.0, "b")]


def test_lines_and_sqlite(spark, tmp_path):
    df = spark.createDataFrame([(1, [(0.0, 1.0), (2.0, 3.0)])], "link int, coords array<struct<x:double,y:double>>")
    for ext in ("json", "kml", "shp", "sqlite"):
        vector.write_layer(df, f"file://{tmp_path}/l.{ext}")
    assert json.loads((tmp_path / "l.json").read_text())["features"][0]["geometry"]["coordinates"] == [[0.0, 1.0], [2.0, 3.0]]
    with pytest.raises(vector.NotPoints):
        vector.read_points(spark, f"file://{tmp_path}/l.shp")


def test_names():
    assert tables.name_add("/a/b.c/dem.tif", "fel") == "/a/b.c/demfel.tif" and tables.name_add("dem", "p") == "demp"
    assert tables.name_add("/a/dem.tif", "tree.dat") == "/a/demtree.dat"


def test_cli(spark, tmp_path):
    z = [(r, c, float(30 - r + abs(c - 5) + (r * 7 + c * 3) % 3)) for r in range(15) for c in range(11)]
    meta = GridMeta(15, 11, 1.0, 1.0, 0.0, 15.0)
    base = f"file://{tmp_path}/dem.tif"
    geotiff.write(spark.createDataFrame(z, "row int, col int, value double"), meta, base)
    cli.run(spark, ["pitremove", "-z", base, "-fel", tables.name_add(base, "fel")])
    cli.run(spark, ["d8flowdir", base])
    cli.run(spark, ["aread8", "-p", tables.name_add(base, "p"), "-ad8", tables.name_add(base, "ad8"), "-nc"])
    cli.run(spark, ["threshold", "-ssa", tables.name_add(base, "ad8"), "-src", tables.name_add(base, "src"), "-thresh", "5"])
    found, _ = geotiff.read(spark, tables.name_add(base, "src"))
    assert found.where("value = 1").count() > 0 and found.where(F.col("value").isNull()).count() == 2 * 15 + 2 * 9
    with pytest.raises(SystemExit):
        cli.run(spark, ["nothing"])
    # the network's files
    grid = lambda n: tables.name_add(base, n)
    out = lambda n: f"file://{tmp_path}/{n}"
    cli.run(spark, ["streamnet", "-fel", grid("fel"), "-p", grid("p"), "-ad8", grid("ad8"), "-src", grid("src"), "-ord", grid("ord"), "-w", grid("w"), "-tree", out("tree"), "-coord", out("coord"), "-net", out("net.json")])
    read = lambda n: [r["value"] for r in spark.read.text(out(n)).collect()]
    tree, coord = sorted([int(x) for x in v.split()] for v in read("tree")), read("coord")
    assert all(v.startswith("\t") and len(v.split("\t")) == 6 for v in coord) and all(len(t) == 9 for t in tree)
    assert [t[0] for t in tree] == list(range(len(tree))) and tree[0][1] == 0 and tree[-1][2] == len(coord) - 1
    assert all(a[2] + 1 == b[1] for a, b in zip(tree, tree[1:]))
    points = [tuple(float(x) for x in v.split()) for v in sorted(coord, key=coord.index)]
    first = points[tree[0][1] : tree[0][2] + 1]
    assert all(a[2] > b[2] and a[3] >= b[3] and abs(a[2] - b[2] - ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5) < 1e-4 for a, b in zip(first, first[1:]))
    net = json.loads((tmp_path / "net.json").read_text())["features"]
    assert list(net[0]["properties"]) == list(tables.NET_FIELDS) and len(net) == len(tree)
    assert {f["properties"]["LINKNO"]: len(f["geometry"]["coordinates"]) for f in net} == {t[0]: max(2, t[2] - t[1] + 1) for t in tree}
    cli.run(spark, ["catchoutlets", "-p", grid("p"), "-net", out("net.json"), "-o", out("out.json"), "-mindist", "1", "-minarea", "5"])
    made = json.loads((tmp_path / "out.json").read_text())["features"]
    assert sorted(f["properties"]["Id"] for f in made) == list(range(1, len(made) + 1)) and len(made) >= sum(t[3] < 0 for t in tree)
    (tmp_path / "o.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": 3}, "geometry": {"type": "Point", "coordinates": [5.5, 1.5]}}]}))
    cli.run(spark, ["dropanalysis", "-ad8", grid("ad8"), "-p", grid("p"), "-fel", grid("fel"), "-ssa", grid("ad8"), "-o", out("o.json"), "-drp", out("drp.csv"), "-par", "2", "8", "3", "0"])
    lines = (tmp_path / "drp.csv").read_text().splitlines()
    assert lines[0] == tables.DROP_HEADING and lines[-1].startswith("Optimum Threshold Value: ") and tables.read_optimum(spark, out("drp.csv")) >= 2
    cli.run(spark, ["gagewatershed", "-p", grid("p"), "-gw", grid("gw"), "-o", out("o.json"), "-id", out("id.txt"), "-upid", out("up.txt")])
    cli.run(spark, ["ogrcopy", "-in", out("o.json"), "-out", out("copy.json")])
    assert json.loads((tmp_path / "copy.json").read_text())["features"][0]["geometry"]["coordinates"] == [5.5, 1.5]
    cli.run(spark, ["demverify", "-a", grid("fel"), "-b", grid("fel")])
    (tmp_path / "control.txt").write_text("# limits\nslp = a.tif # slope\ng=9.81\n")
    assert tables.read_control(spark, out("control.txt")) == {"slp": "a.tif", "g": "9.81"}

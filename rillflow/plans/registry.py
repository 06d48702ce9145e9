"""Registered queries over the driver's tables and the SQL that they equal.

The `orders` table has dense keys; as a grid of 125 columns it gives a tilted
valley (`dem`), a rough variant with pits and flats (`rough`), and attributes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import grid as G
from ..operators import direction, flow, local, network, zonal
from . import oracles, workflows

COLS = 125
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ the inputs


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    price = F.floor("o_totalprice").cast("long")
    row, col = F.floor(key / float(COLS)), F.pmod(key, F.lit(COLS))
    shape = lambda tilt, noise: (F.lit(tilt) * (2000 - row) + 2 * F.abs(col - 62) + price % noise).cast("double")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        row.cast("int").alias("row"),
        col.cast("int").alias("col"),
        shape(8, 7).alias("dem"),
        shape(1, 40).alias("rough"),
        ((F.col("o_custkey") % 10) / 2.0).alias("weight"),
        F.when(F.col("o_orderstatus") != "P", (F.col("o_custkey") % 40) / 64.0 - 0.0625).alias("slp"),
        (F.floor(F.col("o_totalprice") / 1024.0) - 20).cast("double").alias("sca"),
        ((price % 8) / 8.0).alias("decay"),
        (price % 30 == 0).cast("int").alias("mark"),
        (price % 13).cast("int").alias("height"),
    )


def meta_of(spark: SparkSession, sf_dir: str, dx: float = 1.0, dy: float = 1.0) -> G.GridMeta:
    return G.GridMeta(spark.read.parquet(f"{sf_dir}/orders.parquet").count() // COLS, COLS, dx, dy)


def attribute(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return orders(spark, sf_dir).select("row", "col", F.col(name).alias("value"))


def d8(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, G.GridMeta]:
    meta = meta_of(spark, sf_dir)
    return direction.d8_first(attribute(spark, sf_dir, "dem"), meta).select("row", "col", F.col("p").alias("value")), meta


def dinf(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, G.GridMeta]:
    meta = meta_of(spark, sf_dir)
    return direction.dinf_first(attribute(spark, sf_dir, "dem"), meta).select("row", "col", F.col("ang").alias("value")), meta


def gages(spark: SparkSession, sf_dir: str, meta: G.GridMeta) -> DataFrame:
    n = meta.nrows * meta.ncols
    cell = (F.col("n_nationkey") * 587) % n
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("id"), F.floor(cell / COLS).cast("int").alias("row"), (cell % COLS).cast("int").alias("col"))


def region_of(df: DataFrame) -> DataFrame:
    return df.select("row", "col", (F.floor(F.col("row") / 20) * 5 + F.floor(F.col("col") / 25)).cast("int").alias("value"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in (names or ("value",)) else F.col(c) for c in df.columns))


def streams(spark: SparkSession, sf_dir: str, limit: float = 40) -> tuple[DataFrame, DataFrame, DataFrame, G.GridMeta]:
    """p, area and stream cells of the valley."""
    from .tiles import checkpointed

    p, meta = d8(spark, sf_dir)
    p = checkpointed(p)
    area = checkpointed(flow.area_d8(p, meta, check=False))
    return p, area, local.threshold(area, limit), meta


# ------------------------------------------------------------- the SQL they equal

_CELLS = f"""cells AS (
    SELECT CAST(floor(o_orderkey / {COLS}.0) AS INT) AS row, CAST(o_orderkey % {COLS} AS INT) AS col,
           CAST(8 * (2000 - floor(o_orderkey / {COLS}.0)) + 2 * abs(o_orderkey % {COLS} - 62) + CAST(floor(o_totalprice) AS BIGINT) % 7 AS DOUBLE) AS z,
           CAST(1 * (2000 - floor(o_orderkey / {COLS}.0)) + 2 * abs(o_orderkey % {COLS} - 62) + CAST(floor(o_totalprice) AS BIGINT) % 40 AS DOUBLE) AS rough,
           (o_custkey % 10) / 2.0 AS weight,
           CASE WHEN o_orderstatus <> 'P' THEN (o_custkey % 40) / 64.0 - 0.0625 END AS slp,
           CAST(floor(o_totalprice / 1024.0) - 20 AS DOUBLE) AS sca,
           (CAST(floor(o_totalprice) AS BIGINT) % 8) / 8.0 AS decay,
           CAST(CAST(floor(o_totalprice) AS BIGINT) % 30 = 0 AS INT) AS mark,
           CAST(CAST(floor(o_totalprice) AS BIGINT) % 13 AS INT) AS height,
           o_orderkey AS id
    FROM orders)"""
_STEPS = """steps(k, dr, dc, len, pri) AS (VALUES (1, 0, 1, 1.0::DOUBLE, 1), (2, -1, 1, sqrt(2.0::DOUBLE), 5), (3, -1, 0, 1.0::DOUBLE, 2), (4, -1, -1, sqrt(2.0::DOUBLE), 6),
    (5, 0, -1, 1.0::DOUBLE, 3), (6, 1, -1, sqrt(2.0::DOUBLE), 7), (7, 1, 0, 1.0::DOUBLE, 4), (8, 1, 1, sqrt(2.0::DOUBLE), 8))"""
_D8 = f"""{_CELLS}, {_STEPS},
near AS (SELECT c.id, s.k, s.pri, (c.z - n.z) / s.len AS slope FROM cells c, steps s, cells n WHERE n.row = c.row + s.dr AND n.col = c.col + s.dc),
best AS (SELECT id, count(*) AS n, max(slope) AS top, (list(k ORDER BY slope DESC, pri))[1] AS k FROM near GROUP BY id),
d8 AS (SELECT c.id, c.row, c.col, c.z, CASE WHEN b.n = 8 THEN CASE WHEN b.top > 0 THEN b.k ELSE 0 END END AS p, CASE WHEN b.n = 8 THEN greatest(b.top, 0) END AS slope
       FROM cells c JOIN best b USING (id)),
edges AS (SELECT a.id AS src, b.id AS dst, s.len, s.k FROM d8 a JOIN steps s ON s.k = a.p JOIN d8 b ON b.row = a.row + s.dr AND b.col = a.col + s.dc WHERE b.p IS NOT NULL)"""
_REACH = f"""{_D8},
reach(id, pos, len, hops) AS (
    SELECT id, id, 0.0::DOUBLE, 0 FROM d8 WHERE p IS NOT NULL
    UNION ALL SELECT r.id, e.dst, r.len + e.len, r.hops + 1 FROM reach r JOIN edges e ON e.src = r.pos)"""
_BARE = """bare AS (SELECT a.id, count(*) < 8 OR bool_or(b.p IS NULL) AS bare FROM d8 a, steps s, d8 b WHERE b.row = a.row + s.dr AND b.col = a.col + s.dc GROUP BY a.id)"""
_ANGLE = f"""{_CELLS}, {_STEPS},
nb AS (SELECT c.id, max(CASE WHEN s.k = 1 THEN n.z END) AS n1, max(CASE WHEN s.k = 2 THEN n.z END) AS n2, max(CASE WHEN s.k = 3 THEN n.z END) AS n3, max(CASE WHEN s.k = 4 THEN n.z END) AS n4,
              max(CASE WHEN s.k = 5 THEN n.z END) AS n5, max(CASE WHEN s.k = 6 THEN n.z END) AS n6, max(CASE WHEN s.k = 7 THEN n.z END) AS n7, max(CASE WHEN s.k = 8 THEN n.z END) AS n8, count(*) AS n
       FROM cells c, steps s, cells n WHERE n.row = c.row + s.dr AND n.col = c.col + s.dc GROUP BY c.id),
facets AS (SELECT c.id, f.i, f.base, f.sign, c.z - f.e1 AS s1, f.e1 - f.e2 AS s2, c.z - f.e2 AS s3
           FROM cells c JOIN nb USING (id), LATERAL (VALUES (1, n1, n2, 0, 1), (2, n3, n2, 1, -1), (3, n3, n4, 1, 1), (4, n5, n4, 2, -1), (5, n5, n6, 2, 1), (6, n7, n6, 3, -1), (7, n7, n8, 3, 1), (8, n1, n8, 4, -1)) f(i, e1, e2, base, sign)
           WHERE nb.n = 8),
tilted AS (SELECT *, CASE WHEN s1 = 0 AND s2 = 0 THEN 0 ELSE atan2(s2, s1) END AS a FROM facets),
sloped AS (SELECT id, i, base, sign, CASE WHEN a < 0 THEN s1 WHEN a > atan2(1.0::DOUBLE, 1.0::DOUBLE) THEN s3 / sqrt(2.0::DOUBLE) ELSE sqrt(s1 * s1 + s2 * s2) END AS slope,
           CASE WHEN a < 0 THEN 0 WHEN a > atan2(1.0::DOUBLE, 1.0::DOUBLE) THEN atan2(1.0::DOUBLE, 1.0::DOUBLE) ELSE a END AS turn FROM tilted),
picked AS (SELECT id, max(slope) AS top, (list(base * 3.14159265359::DOUBLE / 2 + sign * turn ORDER BY slope DESC, i))[1] AS angle FROM sloped GROUP BY id),
dinf AS (SELECT c.*, CASE WHEN q.top > 0 THEN q.angle WHEN q.top IS NOT NULL THEN -1 END AS ang, CASE WHEN q.top IS NOT NULL THEN greatest(q.top, 0) END AS slope FROM cells c LEFT JOIN picked q USING (id))"""
_PI = "3.14159265359::DOUBLE"
_SHARES = f"""{_ANGLE},
marks AS (SELECT k, dr, dc, CASE WHEN k = 1 THEN -q ELSE (k - 2) * q END AS lo, (k - 1) * q AS mid, k * q AS hi FROM (SELECT *, {_PI} / 4 AS q FROM steps)),
given AS (SELECT d.id AS src, d.row + m.dr AS r, d.col + m.dc AS c, m.k, CASE WHEN a > lo AND a < hi THEN CASE WHEN a > mid THEN (hi - a) / (hi - mid) ELSE (a - lo) / (mid - lo) END END AS share
          FROM (SELECT * FROM dinf WHERE ang >= 0) d, marks m, LATERAL (SELECT CASE WHEN m.k = 1 AND d.ang > {_PI} THEN d.ang - 2 * {_PI} ELSE d.ang END AS a) x),
links AS (SELECT g.src, b.id AS dst, g.share, g.k FROM given g JOIN dinf b ON b.row = g.r AND b.col = g.c WHERE g.share >= 1e-5 AND b.ang IS NOT NULL)"""


def _sql(body: str, parts: str) -> str:
    return f"WITH RECURSIVE {parts} {body}"


# --------------------------------------------------------------- local operators


@query(_sql("SELECT row, col, CASE WHEN sca IS NOT NULL THEN CAST(sca >= 100 AND coalesce(slp, -1) >= 0 AS INT) END AS value FROM cells", _CELLS))
def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local.threshold(attribute(spark, sf_dir, "sca"), 100.0, attribute(spark, sf_dir, "slp"))


@query(_sql("SELECT row, col, CASE WHEN slp >= 0 AND sca >= 0 THEN round(slp * slp * sca, 6) END AS value FROM cells", _CELLS))
def slope_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(local.slope_area(attribute(spark, sf_dir, "slp"), attribute(spark, sf_dir, "sca")))


@query(_sql("SELECT row, col, CASE WHEN sca <> 0 THEN round(slp / sca, 6) END AS value FROM cells", _CELLS))
def slope_area_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(local.slope_area_ratio(attribute(spark, sf_dir, "slp"), attribute(spark, sf_dir, "sca")))


@query(_sql("SELECT row, col, CASE WHEN slp > 0 AND sca > 0 THEN round(ln(sca / slp), 6) END AS value FROM cells", _CELLS))
def twi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(local.wetness_index(attribute(spark, sf_dir, "slp"), attribute(spark, sf_dir, "sca")))


@query(_sql("SELECT row, col, CASE WHEN slp >= 0 THEN CAST(sca >= 0.03 * pow(slp * 1000, 1.3) AS INT) END AS value FROM cells", _CELLS))
def length_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = orders(spark, sf_dir).select("row", "col", (F.col("slp") * 1000).alias("value"))
    return local.length_area(length, attribute(spark, sf_dir, "sca"))


@query(
    _sql(
        """, edits AS (SELECT CAST(floor((s_suppkey % 125) + 0.5) AS INT) AS col, CAST(floor((s_suppkey % 12) + 0.25) AS INT) AS row, arg_max(s_nationkey, s_suppkey) AS v FROM supplier GROUP BY 1, 2)
        SELECT c.row, c.col, CAST(coalesce(e.v, c.height) AS SMALLINT) AS value FROM cells c LEFT JOIN edits e ON e.row = c.row AND e.col = c.col""",
        _CELLS,
    )
)
def edit_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = meta_of(spark, sf_dir)
    edits = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").alias("line"), (F.col("s_suppkey") % COLS + 0.5).alias("x"), (F.lit(0.0) - F.col("s_suppkey") % 12 - 0.25).alias("y"), F.col("s_nationkey").alias("value")
    )
    return local.edit_raster(attribute(spark, sf_dir, "height"), edits, meta)


@query(
    _sql(
        f""", fed AS (SELECT DISTINCT a.row + s.dr AS row, a.col + s.dc AS col FROM d8 a JOIN steps s ON s.k = a.p)
        SELECT d.row, d.col, CASE WHEN (d.id // {COLS} // 20 = 1 AND d.col < 25) OR d.p IS NOT NULL OR f.row IS NOT NULL THEN 7 END AS value
        FROM (SELECT c.id, c.row, c.col, d.p FROM cells c LEFT JOIN d8 d USING (id)) d LEFT JOIN fed f ON f.row = d.row AND f.col = d.col""",
        _D8,
    )
)
def set_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, meta = d8(spark, sf_dir)
    gage = region_of(p).select("row", "col", F.when(F.col("value") == 5, 1).alias("value"))
    return local.set_region(p, gage, 7)


@query(_sql("SELECT src // 125 AS row, CAST(src % 125 AS INT) AS col, k, round(share, 6) AS share FROM given WHERE share >= 1e-5", _SHARES).replace("src // 125 AS row", "CAST(src // 125 AS INT) AS row"))
def split_proportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    ang, meta = dinf(spark, sf_dir)
    parts = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), local.split_proportion(F.col("value"), k).alias("share")) for k in range(1, 9))))
    return rounded(ang.where("value >= 0").select("row", "col", parts.alias("s")).select("row", "col", "s.k", "s.share").where("share is not null"), "share")


@query("SELECT s_suppkey AS id, CAST(floor((1000.0 - s_suppkey * 3.25) / 20.0) AS INT) AS row, CAST(floor((s_suppkey * 7.5 + 15.0 - 10.0) / 30.0) AS INT) AS col FROM supplier")
def geo_to_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = G.GridMeta(100, 100, 30.0, 20.0, 10.0, 1000.0)
    row, col = G.cell_of(F.col("s_suppkey") * 7.5 + 15.0, F.col("s_suppkey") * 3.25, meta)
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), row.alias("row"), col.alias("col"))


@query(_sql("SELECT row, col, 10.0 + 15.0 + col * 30.0 AS x, 1000.0 - 10.0 - row * 20.0 AS y FROM cells", _CELLS).replace("10.0 + 15.0 + col * 30.0", "CAST(25.0 + col * 30.0 AS DOUBLE)").replace("1000.0 - 10.0 - row * 20.0", "CAST(990.0 - row * 20.0 AS DOUBLE)"))
def cell_to_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = G.place_of(F.col("row"), F.col("col"), G.GridMeta(100, 100, 30.0, 20.0, 10.0, 1000.0))
    return orders(spark, sf_dir).select("row", "col", x.alias("x"), y.alias("y"))


@query(
    """SELECT CAST(i AS INT) AS row, round(6378137.0 * cos(b) * radians(0.01), 6) AS dx,
       round(sqrt(pow(6378137.0 * sin(b), 2) + pow(6356752.314 * cos(b), 2)) * radians(0.01) * (6356752.314 / 6378137.0) * pow(cos(b) / cos(lat), 2), 6) AS dy
       FROM (SELECT i, lat, atan(6356752.314::DOUBLE / 6378137.0 * tan(lat)) AS b FROM (SELECT i, radians(46.0 - (i + 0.5) * 0.01) AS lat FROM range(0, 200) r(i)))"""
)
def row_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.GridMeta(200, 10, 0.01, 0.01, 5.0, 46.0, True).row_geometry(spark), "dx", "dy")


@query(_sql("SELECT row, col, CASE WHEN abs(height - 5) >= 1e-5 THEN height END AS value FROM cells", _CELLS))
def scan_nodata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("row", "col", G.scanned(F.col("height"), 5.000001).alias("value"))


@query("SELECT CAST(count(*) AS BIGINT) AS cells, CAST(count(*) FILTER (o_custkey % 10 <> 0) AS BIGINT) AS differing FROM orders")
def compare_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = attribute(spark, sf_dir, "weight"), meta_of(spark, sf_dir).constant(spark, 0.0)
    return G.joined(a, b.withColumnRenamed("value", "other")).agg(F.count("*").alias("cells"), F.count_if(F.abs(F.col("value") - F.col("other")) > 1e-12).alias("differing"))


# -------------------------------------------------------------------- directions


@query(_sql("SELECT row, col, CAST(p AS INT) AS p, round(slope, 6) AS slope FROM d8", _D8))
def d8_slope_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(direction.d8_first(attribute(spark, sf_dir, "dem"), meta_of(spark, sf_dir)), "slope")


@query(_sql("SELECT row, col, round(slope, 6) AS value FROM d8", _D8.replace("AS z,\n           CAST(1 *", "AS smooth,\n           CAST(1 *").replace("AS rough", "AS z")))
def d8_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = direction.d8_first(attribute(spark, sf_dir, "rough"), meta_of(spark, sf_dir))
    return rounded(first.select("row", "col", F.col("slope").alias("value")))


@query()
def d8_flats(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = meta_of(spark, sf_dir)
    filled = direction.fill_pits(attribute(spark, sf_dir, "rough"), meta)
    from .tiles import checkpointed

    return direction.d8_direction(checkpointed(filled), meta).select("row", "col", "p")


@query()
def d8_flowdir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(direction.d8_direction(attribute(spark, sf_dir, "rough"), meta_of(spark, sf_dir)), "slope")


@query(_sql("SELECT row, col, round(ang, 6) AS ang, round(slope, 6) AS slope FROM dinf", _ANGLE))
def dinf_flowdir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(direction.dinf_first(attribute(spark, sf_dir, "dem"), meta_of(spark, sf_dir)), "ang", "slope")


@query()
def dinf_flats(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = meta_of(spark, sf_dir)
    filled = direction.fill_pits(attribute(spark, sf_dir, "rough"), meta)
    from .tiles import checkpointed

    return rounded(direction.dinf_direction(checkpointed(filled), meta), "ang", "slope")


@query()
def pit_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return direction.fill_pits(attribute(spark, sf_dir, "rough"), meta_of(spark, sf_dir))


@query()
def pit_remove_four_way_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return direction.fill_pits(attribute(spark, sf_dir, "rough"), meta_of(spark, sf_dir), True, attribute(spark, sf_dir, "mark"))


_VALLEY = f"""{_CELLS}, {_STEPS}, size AS (SELECT max(row) AS rows FROM cells),
near AS (SELECT c.id, sum(CASE WHEN s.k % 2 = 1 THEN 0.1 ELSE 0.05 END * n.z) AS t, sum(CASE WHEN s.k % 2 = 1 THEN 0.1 ELSE 0.05 END) AS w FROM cells c, steps s, cells n WHERE n.row = c.row + s.dr AND n.col = c.col + s.dc GROUP BY c.id),
soft AS (SELECT c.id, c.row, c.col, c.row > 0 AND c.col > 0 AND c.row < rows AND c.col < {COLS - 1} AS inner_cell,
         round(CASE WHEN c.row > 0 AND c.col > 0 AND c.row < rows AND c.col < {COLS - 1} THEN (0.4 * c.z + t) / (0.4 + w) ELSE c.z END, 9) AS v FROM cells c JOIN near USING (id), size),
blocks AS (SELECT a.row AS r, a.col AS c, greatest(a.v, b.v, d.v, e.v) AS top FROM soft a JOIN soft b ON b.row = a.row AND b.col = a.col + 1 JOIN soft d ON d.row = a.row + 1 AND d.col = a.col JOIN soft e ON e.row = a.row + 1 AND e.col = a.col + 1)"""


@query(
    _sql(
        """SELECT s.row, s.col, CAST(s.inner_cell AND NOT EXISTS (SELECT 1 FROM blocks b WHERE b.r IN (s.row - 1, s.row) AND b.c IN (s.col - 1, s.col) AND s.v >= b.top) AS INT) AS value FROM soft s""",
        _VALLEY.replace(", 9) AS v", ", 9) AS v"),
    )
)
def peuker_douglas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return direction.peuker_douglas(attribute(spark, sf_dir, "dem"), meta_of(spark, sf_dir))


# ------------------------------------------------------------------ D8 algebra


@query(_sql("SELECT c.row, c.col, CASE WHEN d.p IS NOT NULL THEN n END AS value FROM cells c JOIN d8 d USING (id) LEFT JOIN (SELECT pos AS id, CAST(count(*) AS DOUBLE) AS n FROM reach GROUP BY pos) USING (id)", _REACH))
def area_d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, meta = d8(spark, sf_dir)
    return flow.area_d8(p, meta, check=False)


@query(
    _sql(
        f""", {_BARE}
        SELECT d.row, d.col, CASE WHEN d.p IS NOT NULL AND NOT u.bare THEN w END AS value
        FROM d8 d LEFT JOIN (SELECT r.pos AS id, CAST(sum(c.weight) AS DOUBLE) AS w, bool_or(b.bare) AS bare FROM reach r JOIN cells c ON c.id = r.id JOIN bare b ON b.id = r.id GROUP BY r.pos) u USING (id)""",
        _REACH,
    )
)
def area_d8_weighted_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, meta = d8(spark, sf_dir)
    return flow.area_d8(p, meta, attribute(spark, sf_dir, "weight"))


@query(
    _sql(
        """, gages AS (SELECT DISTINCT (n_nationkey * 587) % (SELECT count(*) FROM orders) AS id FROM nation),
        up AS (SELECT DISTINCT r.id FROM reach r JOIN gages g ON g.id = r.pos)
        SELECT d.row, d.col, CASE WHEN d.id IN (SELECT id FROM up) THEN n END AS value FROM d8 d LEFT JOIN (SELECT pos AS id, CAST(count(*) AS DOUBLE) AS n FROM reach GROUP BY pos) USING (id)""",
        _REACH,
    )
)
def area_d8_outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, meta = d8(spark, sf_dir)
    return flow.area_d8(p, meta, outlets=gages(spark, sf_dir, meta), check=False)


@query(_sql("SELECT d.row, d.col, v AS value FROM d8 d LEFT JOIN (SELECT r.pos AS id, max(c.sca) AS v FROM reach r JOIN cells c ON c.id = r.id GROUP BY r.pos) USING (id)", _REACH))
def d8_extreme_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, meta = d8(spark, sf_dir)
    return flow.extreme_up(p, attribute(spark, sf_dir, "sca"), meta, check=False)


@query(_sql("SELECT d.row, d.col, coalesce(v, d.rough) AS value FROM (SELECT d8.*, cells.rough FROM d8 JOIN cells USING (id)) d LEFT JOIN (SELECT r.pos AS id, min(c.rough) AS v FROM reach r JOIN cells c ON c.id = r.id GROUP BY r.pos) USING (id)", _REACH))
def flow_dir_cond(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, meta = d8(spark, sf_dir)
    return flow.condition(p, attribute(spark, sf_dir, "rough"), meta)


@query(
    _sql(
        """SELECT d.row, d.col, round(plen, 6) AS plen, round(tlen, 6) AS tlen FROM d8 d
        LEFT JOIN (SELECT r.pos AS id, max(r.len) AS plen, coalesce(sum(e.len) FILTER (r.hops > 0), 0) AS tlen FROM reach r LEFT JOIN edges e ON e.src = r.id GROUP BY r.pos) USING (id)""",
        _REACH,
    )
)
def grid_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, meta = d8(spark, sf_dir)
    return rounded(_nulls(flow.grid_net(p, meta), "plen", "tlen").select("row", "col", "plen", "tlen"), "plen", "tlen")


def _nulls(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.nanvl(n, F.lit(None)) for n in names})


@query()
def grid_net_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, meta = d8(spark, sf_dir)
    return _nulls(flow.grid_net(p, meta, attribute(spark, sf_dir, "sca"), 0.0), "gord").select("row", "col", F.col("gord").cast("int").alias("gord"))


_GAGES = """, gages AS (SELECT max(n_nationkey) AS gage, (n_nationkey * 587) % (SELECT count(*) FROM orders) AS id FROM nation GROUP BY 2),
    first AS (SELECT r.id, arg_min(g.gage, r.hops) AS gage FROM reach r JOIN gages g ON g.id = r.pos GROUP BY r.id)"""


@query(_sql(f"{_GAGES} SELECT d.row, d.col, f.gage AS value FROM d8 d LEFT JOIN first f USING (id)", _REACH))
def gage_watershed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, meta = d8(spark, sf_dir)
    return network.gage_watershed(p, gages(spark, sf_dir, meta), meta)


@query(
    _sql(
        f"""{_GAGES} SELECT n_nationkey AS id, coalesce(f.gage, -1) AS iddown FROM nation
        LEFT JOIN (SELECT a.id AS src, b.id AS dst FROM d8 a JOIN steps s ON s.k = a.p JOIN d8 b ON b.row = a.row + s.dr AND b.col = a.col + s.dc) e ON e.src = (n_nationkey * 587) % (SELECT count(*) FROM orders)
        LEFT JOIN first f ON f.id = e.dst""",
        _REACH,
    )
)
def gage_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, meta = d8(spark, sf_dir)
    return network.gage_links(p, gages(spark, sf_dir, meta), meta)


_STREAM = """, area AS (SELECT pos AS id, count(*) AS n FROM reach GROUP BY pos), stream AS (SELECT id FROM area WHERE n >= 40),
    entry AS (SELECT r.id, min(r.hops) AS hops, arg_min(r.len, r.hops) AS len, arg_min(r.pos, r.hops) AS pos FROM reach r JOIN stream s ON s.id = r.pos GROUP BY r.id)"""


@query(_sql(f"{_STREAM} SELECT d.row, d.col, round(e.len, 6) AS value FROM d8 d LEFT JOIN entry e USING (id)", _REACH))
def d8_hdist(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, stream, meta = streams(spark, sf_dir)
    return rounded(flow.hdist_d8(p, stream, meta))


@query(_sql(f"{_STREAM} SELECT d.row, d.col, round(d.z - t.z, 6) AS value FROM d8 d LEFT JOIN entry e USING (id) LEFT JOIN cells t ON t.id = e.pos", _REACH))
def d8_vdist(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, stream, meta = streams(spark, sf_dir)
    return rounded(flow.vdist_d8(p, attribute(spark, sf_dir, "dem"), stream, meta))


@query(
    _sql(
        f"""{_STREAM} SELECT n_nationkey AS id, CAST(coalesce(e.pos, o.id) // {COLS} AS INT) AS row, CAST(coalesce(e.pos, o.id) % {COLS} AS INT) AS col, CAST(coalesce(e.hops, -1) AS INT) AS dist_moved
        FROM (SELECT n_nationkey, (n_nationkey * 587) % (SELECT count(*) FROM orders) AS id FROM nation) o LEFT JOIN (SELECT * FROM entry WHERE hops <= 20) e USING (id)""",
        _REACH,
    )
)
def move_outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, stream, meta = streams(spark, sf_dir)
    return network.move_outlets(p, stream, gages(spark, sf_dir, meta), meta, 20)


@query(
    _sql(
        f""", area AS (SELECT pos AS id, count(*) AS n FROM reach GROUP BY pos),
        zones AS (SELECT d.id, d.row // 20 * 5 + d.col // 25 AS zone, a.n FROM d8 d JOIN area a USING (id)),
        top AS (SELECT zone, (list(id ORDER BY n DESC, id))[1] AS id, max(n) AS n FROM zones GROUP BY zone),
        final AS (SELECT t.zone, t.id, t.n, arg_max(r.pos, r.hops) AS pos FROM top t JOIN reach r ON r.id = t.id WHERE r.hops <= 10 GROUP BY ALL)
        SELECT CAST(zone AS INT) AS id, CAST(id // {COLS} AS INT) AS row, CAST(id % {COLS} AS INT) AS col, CAST(n AS DOUBLE) AS ad8, CAST(pos // {COLS} AS INT) AS r, CAST(pos % {COLS} AS INT) AS c,
               CAST(pos // {COLS} // 20 * 5 + pos % {COLS} // 25 AS INT) AS id_down FROM final""",
        _REACH,
    )
)
def connect_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, area, _, meta = streams(spark, sf_dir)
    return network.connect_down(p, region_of(p), area, meta, 10)


@query(
    _sql(
        """, steps_on AS (SELECT a.id AS src, b.id AS dst, s.len FROM d8 a JOIN steps s ON s.k = a.p JOIN cells b ON b.row = a.row + s.dr AND b.col = a.col + s.dc),
        far AS (SELECT r.id, r.pos, r.len FROM reach r UNION ALL SELECT r.id, e.dst, r.len + e.len FROM reach r JOIN steps_on e ON e.src = r.pos JOIN d8 t ON t.id = e.dst WHERE t.p IS NULL),
        hit AS (SELECT id, min(len) AS len, arg_min(pos, len) AS pos FROM far WHERE len > 10 GROUP BY id)
        SELECT d.row, d.col, round((d.z - t.z) / h.len, 6) AS value FROM d8 d LEFT JOIN hit h USING (id) LEFT JOIN cells t ON t.id = h.pos""",
        _REACH,
    )
)
def slope_ave_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, meta = d8(spark, sf_dir)
    return rounded(flow.slope_ave_down(p, attribute(spark, sf_dir, "dem"), meta, 10.0))


# --------------------------------------------------------------- D-infinity algebra


def _mass(start: str, move: str = "m.v * l.share", back: bool = False, drop: str = "", final: str = "sum") -> str:
    """Recursive SQL: values that start in cells move along links; what arrives at a cell is put together."""
    src, dst = ("dst", "src") if back else ("src", "dst")
    return f""", mass(t, id, v) AS (
        SELECT 0, id, {start} FROM dinf WHERE ang IS NOT NULL
        UNION ALL SELECT m.t + 1, l.{dst}, {final}({move}) FROM mass m JOIN links l ON l.{src} = m.id JOIN dinf f ON f.id = m.id JOIN dinf g ON g.id = l.{dst} {drop} GROUP BY m.t + 1, l.{dst})"""


_SUMMED = "SELECT d.row, d.col, round(s.v, 6) AS value FROM dinf d LEFT JOIN (SELECT id, sum(v) AS v FROM mass GROUP BY id) s USING (id)"


@query(_sql(_mass("1.0::DOUBLE") + _SUMMED, _SHARES))
def area_dinf(spark: SparkSession, sf_dir: str) -> DataFrame:
    ang, meta = dinf(spark, sf_dir)
    return rounded(flow.area_dinf(ang, meta, check=False))


@query(_sql(_mass("weight::DOUBLE", "m.v * f.decay * l.share") + _SUMMED, _SHARES))
def dinf_decay_accum(spark: SparkSession, sf_dir: str) -> DataFrame:
    ang, meta = dinf(spark, sf_dir)
    return rounded(flow.decay_accum(ang, attribute(spark, sf_dir, "decay"), meta, attribute(spark, sf_dir, "weight"), check=False))


@query(
    _sql(
        _mass("CASE WHEN mark > 0 AND weight > 0 THEN weight::DOUBLE ELSE 0 END", "CASE WHEN f.weight > 0 THEN m.v * f.decay * l.share ELSE 0 END", drop="WHERE g.mark = 0")
        + "SELECT d.row, d.col, CASE WHEN d.ang IS NOT NULL AND d.weight > 0 THEN CASE WHEN d.mark > 0 THEN 1 ELSE round(s.v / d.weight, 9) END END AS value FROM dinf d LEFT JOIN (SELECT id, sum(v) AS v FROM mass GROUP BY id) s USING (id)",
        _SHARES,
    )
)
def dinf_conc_lim_accum(spark: SparkSession, sf_dir: str) -> DataFrame:
    ang, meta = dinf(spark, sf_dir)
    found = flow.conc_lim_accum(ang, attribute(spark, sf_dir, "decay"), attribute(spark, sf_dir, "weight"), attribute(spark, sf_dir, "mark"), meta, check=False)
    return found.select("row", "col", F.round("value", 9).alias("value"))


@query(_sql(_mass("weight::DOUBLE", back=True) + "SELECT d.row, d.col, round(s.v, 6) AS racc FROM dinf d LEFT JOIN (SELECT id, sum(v) AS v FROM mass GROUP BY id) s USING (id)", _SHARES))
def dinf_rev_accum(spark: SparkSession, sf_dir: str) -> DataFrame:
    ang, meta = dinf(spark, sf_dir)
    return rounded(_nulls(flow.rev_accum(ang, attribute(spark, sf_dir, "weight"), meta), "racc").select("row", "col", "racc"), "racc")


@query(_sql(_mass("weight::DOUBLE", "m.v", back=True, final="max") + "SELECT d.row, d.col, s.v AS dmax FROM dinf d LEFT JOIN (SELECT id, max(v) AS v FROM mass GROUP BY id) s USING (id)", _SHARES))
def dinf_rev_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    ang, meta = dinf(spark, sf_dir)
    return _nulls(flow.rev_accum(ang, attribute(spark, sf_dir, "weight"), meta), "dmax").select("row", "col", "dmax")


@query(_sql(_mass("CASE WHEN mark >= 1 THEN 1.0::DOUBLE ELSE 0 END", back=True, drop="WHERE g.mark < 1") + _SUMMED, _SHARES))
def dinf_up_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ang, meta = dinf(spark, sf_dir)
    return rounded(flow.up_dependence(ang, attribute(spark, sf_dir, "mark"), meta))


@query()
def dinf_trans_lim_accum(spark: SparkSession, sf_dir: str) -> DataFrame:
    ang, meta = dinf(spark, sf_dir)
    found = flow.trans_lim_accum(ang, attribute(spark, sf_dir, "weight"), attribute(spark, sf_dir, "height"), meta, attribute(spark, sf_dir, "decay"), check=False)
    return rounded(_nulls(found, "tla", "tdep", "ctpt"), "tla", "tdep", "ctpt")


@query()
def ret_lim_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    ang, meta = dinf(spark, sf_dir)
    found = flow.ret_lim_flow(ang, attribute(spark, sf_dir, "weight"), attribute(spark, sf_dir, "decay"), meta)
    return found.select("row", "col", F.round("value", 4).alias("value"))


@query()
def dinf_avalanche(spark: SparkSession, sf_dir: str) -> DataFrame:
    ang, meta = dinf(spark, sf_dir)
    return rounded(flow.avalanche(ang, attribute(spark, sf_dir, "dem"), attribute(spark, sf_dir, "mark"), meta), "rz", "dm")


_HOP = """links2 AS (SELECT l.src, l.dst, s.len, abs(a.z - b.z) AS drop FROM links l JOIN steps s USING (k) JOIN cells a ON a.id = l.src JOIN cells b ON b.id = l.dst)"""


@query(
    _sql(
        f""", {_HOP}, far(t, id, v) AS (SELECT 0, id, 0.0::DOUBLE FROM dinf WHERE ang IS NOT NULL
        UNION ALL SELECT f.t + 1, l.dst, max(f.v + l.len) FROM far f JOIN links2 l ON l.src = f.id GROUP BY f.t + 1, l.dst)
        SELECT d.row, d.col, round(s.v, 6) AS value FROM dinf d LEFT JOIN (SELECT id, max(v) AS v FROM far GROUP BY id) s USING (id)""",
        _SHARES,
    )
)
def dinf_dist_up_h_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    ang, meta = dinf(spark, sf_dir)
    return rounded(flow.dist_up(ang, attribute(spark, sf_dir, "dem"), meta, "h", "max", check=False))


@query(
    _sql(
        f""", {_HOP}, goal AS (SELECT id FROM dinf WHERE mark >= 1 AND ang IS NOT NULL),
        far(t, id, v) AS (SELECT 0, id, 0.0::DOUBLE FROM goal
        UNION ALL SELECT f.t + 1, l.src, min(f.v + sqrt(l.len * l.len + l.drop * l.drop)) FROM far f JOIN links2 l ON l.dst = f.id WHERE l.src NOT IN (SELECT id FROM goal) GROUP BY f.t + 1, l.src)
        SELECT d.row, d.col, round(s.v, 6) AS value FROM dinf d LEFT JOIN (SELECT id, min(v) AS v FROM far GROUP BY id) s USING (id)""",
        _SHARES,
    )
)
def dinf_dist_down_s_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    ang, meta = dinf(spark, sf_dir)
    return rounded(flow.dist_down(ang, attribute(spark, sf_dir, "dem"), attribute(spark, sf_dir, "mark"), meta, "s", "min", check=False))


def _distances(down: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ang, meta = dinf(spark, sf_dir)
        dem, mark = attribute(spark, sf_dir, "dem"), attribute(spark, sf_dir, "mark")
        found = flow.distances_down(ang, dem, mark, meta) if down else flow.distances_up(ang, dem, meta, check=False)
        rows = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(stat).alias("stat"), F.col(f"{kind}_{stat}").alias("value")) for kind in "hvps" for stat in ("ave", "max", "min"))))
        return rounded(found.select("row", "col", rows.alias("d")).select("row", "col", "d.kind", "d.stat", "d.value"))

    return run


QUERIES["dinf_dist_down"] = _distances(True)
QUERIES["dinf_dist_up"] = _distances(False)


# -------------------------------------------------------------------- networks


@query()
def drop_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, area, _, meta = streams(spark, sf_dir)
    found = network.drop_statistics(p, attribute(spark, sf_dir, "dem"), area, area, _ends(p, meta), meta, network.drop_thresholds(5, 100, 6))
    return rounded(found, "threshold", "drain_density", "mean_first", "mean_high", "sd_first", "sd_high", "t")


def _ends(p: DataFrame, meta: G.GridMeta) -> DataFrame:
    """The cells with a direction in the last row but one, as outlets."""
    return p.where((F.col("row") == meta.nrows - 2) & F.col("value").isNotNull()).select("row", "col", F.col("col").alias("id"))


def _net(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame, G.GridMeta]:
    p, area, stream, meta = streams(spark, sf_dir)
    return network.stream_net(p, attribute(spark, sf_dir, "dem"), area, stream, meta), p, meta


@query()
def stream_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_net(spark, sf_dir)[0]["links"], "length", "drop", "slope", "straightl", "doutend", "doutstart", "doutmid")


@query()
def stream_watershed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _net(spark, sf_dir)[0]["watershed"]


@query()
def catch_outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    net, p, meta = _net(spark, sf_dir)
    return rounded(network.catch_outlets(net["links"], p, meta, 20.0, 1, 100.0), "dist")


# ----------------------------------------------------------------------- zonal

_STAGES = (1.0, 2.0, 4.0, 8.0, 16.0)
_ZONE = "floor(row / 20) * 5 + floor(col / 25)"


def _catchments(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = region_of(orders(spark, sf_dir)).select(F.col("value").alias("id")).distinct()
    return zones.select("id", (F.lit(0.001) * (F.col("id") + 1)).alias("slope"), (F.lit(100.0) + F.col("id")).alias("length"), F.lit(None).cast("double").alias("manning_n"))


def _rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = orders(spark, sf_dir)
    hand = cells.select("row", "col", (F.col("height") * 0.75).alias("value"))
    slope = cells.select("row", "col", F.col("weight").alias("value"))
    return zonal.hydraulic_table(hand, region_of(cells), _catchments(spark, sf_dir), slope, list(_STAGES), meta_of(spark, sf_dir, 30.0, 20.0))


_RATING = f"""{_CELLS}, stages(h) AS (VALUES (1.0), (2.0), (4.0), (8.0), (16.0)),
z AS (SELECT CAST({_ZONE} AS INT) AS id, CAST(height AS DOUBLE) * 0.75 AS hand, weight AS slp FROM cells),
lists AS (SELECT id, 0.001 * (id + 1) AS s, 100.0 + id AS l, 0.05 AS n, count(*) * 600.0 AS total FROM z GROUP BY id),
wet AS (SELECT id, h, count(*) AS cells, sum(600.0 * sqrt(1 + slp * slp)) AS bed, sum((h - hand) * 600.0) AS volume FROM z, stages WHERE hand < h OR abs(hand) < 1e-6 GROUP BY id, h),
rating AS (SELECT a.id, CAST(b.h AS DOUBLE) AS stage, coalesce(w.cells, 0) AS cells, coalesce(w.bed, 0) AS bed, coalesce(w.volume, 0) AS volume, a.s, a.l, a.n, a.total FROM lists a CROSS JOIN stages b LEFT JOIN wet w ON w.id = a.id AND w.h = b.h),
curve AS (SELECT *, CASE WHEN volume > 0 THEN volume / l ELSE 0 END AS section, CASE WHEN volume > 0 THEN bed / l ELSE 0 END AS perimeter, CASE WHEN volume > 0 THEN volume / bed ELSE 0 END AS radius,
          CASE WHEN volume > 0 THEN volume / l * pow(volume / bed, 2.0 / 3.0) * sqrt(s) / n ELSE 0 END AS flow FROM rating)"""


@query(
    _sql(
        "SELECT id, stage, cells, round(CAST(cells * 600.0 AS DOUBLE), 6) AS wet_area, round(CAST(bed AS DOUBLE), 3) AS bed_area, round(CAST(volume AS DOUBLE), 3) AS volume, round(CAST(s AS DOUBLE), 6) AS slope, CAST(l AS DOUBLE) AS length, CAST(total AS DOUBLE) AS catch_area, round(CAST(section AS DOUBLE), 3) AS section, round(CAST(perimeter AS DOUBLE), 3) AS perimeter, round(CAST(radius AS DOUBLE), 6) AS radius, CAST(n AS DOUBLE) AS manning_n, round(CAST(flow AS DOUBLE), 3) AS flow FROM curve",
        _RATING,
    )
)
def catch_hydro_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rating(spark, sf_dir)
    digits = {"wet_area": 6, "bed_area": 3, "volume": 3, "slope": 6, "section": 3, "perimeter": 3, "radius": 6, "flow": 3}
    return r.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in r.columns))


def _forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catchments(spark, sf_dir).select("id", (F.lit(300.0) * (F.col("id") + 1)).alias("flow"))


_STAGE = f"""{_RATING}, asked AS (SELECT id, 300.0 * (id + 1) AS q FROM lists),
bounds AS (SELECT a.id, a.q, max(CASE WHEN c.flow <= a.q THEN c.flow END) AS q1, max(CASE WHEN c.flow <= a.q THEN c.stage END) AS h1, min(CASE WHEN c.flow >= a.q THEN c.flow END) AS q2, min(CASE WHEN c.flow >= a.q THEN c.stage END) AS h2 FROM asked a JOIN curve c USING (id) GROUP BY a.id, a.q),
found AS (SELECT id, CAST(q AS DOUBLE) AS flow, CASE WHEN q1 IS NULL OR q2 IS NULL THEN NULL WHEN q1 = q2 THEN h1 ELSE h1 + (h2 - h1) * (q - q1) / (q2 - q1) END AS stage FROM bounds)"""


@query(_sql("SELECT id, flow, round(CAST(stage AS DOUBLE), 6) AS stage FROM found", _STAGE))
def inun_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(zonal.stage_of_flow(_forecast(spark, sf_dir), _rating(spark, sf_dir)), "stage")


@query(
    _sql(
        f"SELECT c.row, c.col, CASE WHEN f.stage > c.height * 0.75 + 0.001 THEN round(CAST(f.stage - c.height * 0.75 AS DOUBLE), 6) END AS value FROM cells c LEFT JOIN found f ON f.id = CAST({_ZONE} AS INT)",
        _STAGE,
    )
)
def inun_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = orders(spark, sf_dir)
    stages = zonal.stage_of_flow(_forecast(spark, sf_dir), _rating(spark, sf_dir))
    return rounded(zonal.inundation(cells.select("row", "col", (F.col("height") * 0.75).alias("value")), region_of(cells), stages))


@query(
    _sql(
        """SELECT f.id, f.flow, round(CAST(f.stage AS DOUBLE), 6) AS stage, CAST(count(*) FILTER (f.stage - z.hand > 0) * 600.0 AS DOUBLE) AS inun_area, CAST(count(*) * 600.0 AS DOUBLE) AS catch_area,
        round(CAST(count(*) FILTER (f.stage - z.hand > 0) AS DOUBLE) / count(*), 6) AS ratio FROM found f JOIN z USING (id) GROUP BY f.id, f.flow, f.stage""",
        _STAGE,
    )
)
def inun_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = orders(spark, sf_dir)
    stages = zonal.stage_of_flow(_forecast(spark, sf_dir), _rating(spark, sf_dir))
    return rounded(zonal.inundated_area(cells.select("row", "col", (F.col("height") * 0.75).alias("value")), region_of(cells), stages, meta_of(spark, sf_dir, 30.0, 20.0)), "stage", "ratio")


@query(_sql(f"SELECT DISTINCT CAST({_ZONE} AS INT) AS id, 2.708 AS tmin, 2.708 AS tmax, 0.0 AS cmin, 0.25 AS cmax, 30.0 AS phimin, 45.0 AS phimax, 2000.0 AS density FROM cells", _CELLS))
def region_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonal.region_table(region_of(orders(spark, sf_dir)))


# ------------------------------------------------------------------- workflows


def _stability(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    regions = region_of(orders(spark, sf_dir))
    return regions, zonal.region_table(regions)


@query()
def sinmap_si(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, table = _stability(spark, sf_dir)
    return rounded(local.stability_index(attribute(spark, sf_dir, "slp"), attribute(spark, sf_dir, "sca"), regions, table, 0.0009, 0.00135), "si", "sat")


@query()
def wf_stability_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    ang, meta = dinf(spark, sf_dir)
    regions, table = _stability(spark, sf_dir)
    return rounded(workflows.stability(attribute(spark, sf_dir, "slp"), ang, regions, table, meta, 0.0009, 0.00135), "si", "sat")


@query()
def wf_peuker_douglas_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, area, _, meta = streams(spark, sf_dir)
    return workflows.valley_stream(attribute(spark, sf_dir, "dem"), p, meta, outlets=_ends(p, meta), area=area, drop=(2, 50, 5))


@query()
def wf_slope_area_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, meta = d8(spark, sf_dir)
    return workflows.slope_area_stream(attribute(spark, sf_dir, "slp"), attribute(spark, sf_dir, "sca"), p, meta, 20.0)


@query()
def wf_drop_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, area, _, meta = streams(spark, sf_dir)
    return workflows.drop_stream(p, attribute(spark, sf_dir, "dem"), area, area, _ends(p, meta), meta, 5, 100, 5)


@query()
def wf_conc_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    ang, meta = dinf(spark, sf_dir)
    return rounded(workflows.conc_limited(ang, attribute(spark, sf_dir, "weight"), attribute(spark, sf_dir, "decay"), attribute(spark, sf_dir, "mark"), meta, check=False))


# ------------------------------------------------------- the same on several tiles


@query(ORACLES["area_d8"])
def area_d8_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """area_d8 on tiles of 32 by 32 cells, so that tiles exchange rims at every scale."""
    p, meta = d8(spark, sf_dir)
    return flow.area_d8(p, meta, check=False, size=32)


@query(ORACLES["area_dinf"])
def area_dinf_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    ang, meta = dinf(spark, sf_dir)
    return rounded(flow.area_dinf(ang, meta, check=False, size=32))


@query()
def pit_remove_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return direction.fill_pits(attribute(spark, sf_dir, "rough"), meta_of(spark, sf_dir), size=32)


# ------------------------------------------- on cells of 30 by 20, some of them NULL


def _oblong(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, G.GridMeta]:
    key, price = F.col("o_orderkey"), F.floor("o_totalprice")
    gaps = spark.read.parquet(f"{sf_dir}/orders.parquet").where(price % 50 == 0).select(F.floor(key / float(COLS)).cast("int").alias("row"), F.pmod(key, F.lit(COLS)).cast("int").alias("col"), F.lit(True).alias("gap"))
    dem = attribute(spark, sf_dir, "dem").join(gaps, ["row", "col"], "left")
    return dem.select("row", "col", F.when(F.col("gap").isNull(), F.col("value")).alias("value")), meta_of(spark, sf_dir, 30.0, 20.0)


@query()
def d8_slope_dir_oblong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(direction.d8_first(*_oblong(spark, sf_dir)), "slope")


@query()
def grid_net_oblong(spark: SparkSession, sf_dir: str) -> DataFrame:
    dem, meta = _oblong(spark, sf_dir)
    p = direction.d8_first(dem, meta).select("row", "col", F.col("p").alias("value"))
    return rounded(_nulls(flow.grid_net(p, meta), "plen", "tlen").select("row", "col", "plen", "tlen"), "plen", "tlen")


@query()
def dinf_flowdir_oblong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(direction.dinf_first(*_oblong(spark, sf_dir)), "ang", "slope")


@query()
def area_dinf_oblong(spark: SparkSession, sf_dir: str) -> DataFrame:
    dem, meta = _oblong(spark, sf_dir)
    ang = direction.dinf_first(dem, meta).select("row", "col", F.col("ang").alias("value"))
    return flow.area_dinf(ang, meta, check=False).select("row", "col", F.round("value", 5).alias("value"))


ORACLES |= oracles.oblong(_D8, _REACH, _ANGLE, _SHARES)
ORACLES |= oracles.terrain(_CELLS, _STEPS, _D8, _REACH, _ANGLE, _SHARES, _VALLEY)
ORACLES["pit_remove_tiled"] = ORACLES["pit_remove"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cells of the valley are streams, with at least 40 cells draining through."""
    p, meta = d8(spark, sf_dir)
    return local.threshold(flow.area_d8(p, meta, check=False), 40)

"""Text tables around the operators: their schemas, readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.grid import GridMeta, place_of
from ..operators.network import numbered
from ..plans.tiles import checkpointed
from .geotiff import save

# Column names and types of the text tables.
REGIONS = "id int, tmin double, tmax double, cmin double, cmax double, phimin double, phimax double, density double"
CATCHMENTS = "id int, slope double, length double, manning_n double"
STAGES = "stage double"
FORECAST = "id int, flow double"
EDITS = "x double, y double, value int"
RATING = "id int, stage double, cells long, wet_area double, bed_area double, volume double, slope double, length double, catch_area double, section double, perimeter double, radius double, manning_n double, flow double"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A comma separated table with a header line; columns go by position."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_edits(spark: SparkSession, path: str) -> DataFrame:
    """Raster edits with the number of their line, by which later ones win."""
    return read(spark, path, EDITS).coalesce(1).withColumn("line", F.monotonically_increasing_id())


def write(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header)


# Headings of the written tables.
RATING_HEADINGS = ("Id", "Stage_m", "Number of Cells", "ReachWetArea_m2", "ReachBedArea_m2", "ReachVolume_m3", "ReachSlope", "ReachLength_m", "CatchArea_m2", "CrossSectionalArea_m2", "WetPerimeter_m", "HydRadius_m", "Manning_n", "Flow_m3s")
INUNDATION_HEADINGS = ("id", "flow", "depth", "InunArea_m2", "CatchArea_m2", "InunRatio")
DROP_HEADING = "Threshold, DrainDen, NoFirstOrd,NoHighOrd, MeanDFirstOrd, MeanDHighOrd, StdDevFirstOrd, StdDevHighOrd, T"
NET_FIELDS = ("LINKNO", "DSLINKNO", "USLINKNO1", "USLINKNO2", "DSNODEID", "strmOrder", "Length", "Magnitude", "DSContArea", "strmDrop", "Slope", "StraightL", "USContArea", "WSNO", "DOUTEND", "DOUTSTART", "DOUTMID")


def write_network(links: DataFrame, points: DataFrame, meta: GridMeta, tree: str | None, coord: str | None) -> None:
    """The tree (link, first and last point, dslink, us1, us2, order, node, magnitude) and the coordinates (x, y, distance to the outlet, height, area), with a leading tab."""
    numbered_points = checkpointed(numbered(points, [F.col("link"), F.desc("hops")], "at"))
    if coord:
        x, y = place_of(F.col("row"), F.col("col"), meta)
        line = F.format_string("\t%f\t%f\t%f\t%f\t%f", x, y, F.col("d"), F.col("z").cast("double"), F.col("a").cast("double") * (meta.dx * meta.dy))
        numbered_points.repartitionByRange("at").sortWithinPartitions("at").select(line).write.mode("overwrite").text(coord)
    if tree:
        spans = numbered_points.groupBy("link").agg(F.min("at").alias("first"), F.max("at").alias("last"))
        columns = ["link", "first", "last", "dslink", "us1", "us2", "strmorder", "dsnode", "magnitude"]
        rows = links.join(spans, "link").repartitionByRange("link").sortWithinPartitions("link")
        rows.select(F.concat(*(x for c in columns for x in (F.lit("\t"), F.col(c).cast("string"))))).write.mode("overwrite").text(tree)


def net_layer(links: DataFrame, points: DataFrame, meta: GridMeta) -> DataFrame:
    """The links as lines (coords, from the end upstream) with the seventeen fields of a stream layer."""
    x, y = place_of(F.col("row"), F.col("col"), meta)
    lines = points.select("link", "hops", x.alias("x"), y.alias("y")).groupBy("link").agg(F.sort_array(F.collect_list(F.struct("hops", "x", "y"))).alias("at"))
    lines = lines.select("link", F.transform("at", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("coords"))
    lines = lines.withColumn("coords", F.when(F.size("coords") == 1, F.concat("coords", "coords")).otherwise(F.col("coords")))
    columns = ("link", "dslink", "us1", "us2", "dsnode", "strmorder", "length", "magnitude", "dscontarea", "drop", "slope", "straightl", "uscontarea", "link", "doutend", "doutstart", "doutmid")
    return links.join(lines, "link").select(*(F.col(c).alias(n) for c, n in zip(columns, NET_FIELDS)), "coords")


def write_drops(drops: DataFrame, path: str, high: float) -> None:
    """The drop table, one row for each threshold, and the optimum: the first with |t| under 2, else the largest tried."""
    rows = drops.orderBy("threshold").collect()  # one row for each threshold asked
    optimum = next((r["threshold"] for r in rows if r["t"] is not None and abs(r["t"]) < 2), high)
    line = "%f, %e, %d, %d, %f, %f, %f, %f, %f\n"
    names = ("threshold", "drain_density", "n_first", "n_high", "mean_first", "mean_high", "sd_first", "sd_high", "t")
    text = "".join(line % tuple(float("nan") if r[n] is None else r[n] for n in names) for r in rows)
    save(drops.sparkSession, path, f"{DROP_HEADING}\n{text}Optimum Threshold Value: {optimum:f}\n".encode())


def read_optimum(spark: SparkSession, path: str) -> float:
    """The optimum threshold of a drop table."""
    found = spark.read.text(path).where(F.col("value").startswith("Optimum Threshold Value:")).first()
    if found is None:
        raise ValueError(f"{path} names no optimum threshold")
    return float(found["value"].partition(":")[2])


def read_control(spark: SparkSession, path: str) -> dict[str, str]:
    """key=value lines; what follows # is a comment."""
    lines = (r["value"].partition("#")[0] for r in spark.read.text(path, wholetext=False).collect())
    return {k.strip().lower(): v.strip() for k, sep, v in (x.partition("=") for x in lines) if sep}


def name_add(path: str, suffix: str) -> str:
    """path with suffix before its extension: dem.tif and fel give demfel.tif, and with tree.dat demtree.dat."""
    folder, slash, name = path.rpartition("/")
    stem, dot, ext = name.rpartition(".")
    if not dot:
        return f"{folder}{slash}{name}{suffix}"
    return f"{folder}{slash}{stem}{suffix}" + ("" if "." in suffix else f".{ext}")

"""Zonal statistics and rating curves: joins and aggregates over cell tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.grid import GridMeta

#: A catchment list up to this many rows is sent to all tasks.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most that many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hydraulic_table(hand: DataFrame, catch: DataFrame, catchments: DataFrame, slope: DataFrame, stages: list[float], meta: GridMeta, default_n: float = 0.05) -> DataFrame:
    """Wet cells, areas and volume of every catchment (id, slope, length, manning_n) and stage, and the rating curve.

    Cells are put into the interval between two stages in which they get wet, and the
    statistics are summed up over the stages: one row per cell, not one per cell and stage.
    """
    stages = sorted(set(float(h) for h in stages))
    cell = float(meta.dx * meta.dy)
    first = F.lit(None).cast("int")
    for i in range(len(stages) - 1, -1, -1):
        first = F.when((F.col("hand") < stages[i]) | (F.abs("hand") < 1e-6), i).otherwise(first)
    cells = (
        hand.select("row", "col", F.col("value").alias("hand"))
        .join(catch.select("row", "col", F.col("value").alias("id")), ["row", "col"])
        .join(slope.select("row", "col", F.col("value").alias("slp")), ["row", "col"])
        .where("hand is not null and id is not null")
        .withColumn("first", first)
    )
    known = small(catchments.select(F.col("id"), F.col("slope").alias("s"), F.col("length").alias("l"), F.coalesce("manning_n", F.lit(default_n)).alias("n")))
    bed = F.lit(cell) * F.sqrt(1 + F.coalesce(F.col("slp"), F.lit(0.0)) * F.coalesce(F.col("slp"), F.lit(0.0)))
    parts = cells.groupBy("id", "first").agg(F.count("*").alias("cells"), F.sum(bed).alias("bed"), F.sum(F.col("hand") * cell).alias("heights"))
    steps = F.explode(F.arrays_zip(F.lit(list(range(len(stages)))).alias("i"), F.lit(stages).alias("stage")))
    base = known.withColumn("x", steps).select("id", "s", "l", "n", F.col("x.i").alias("i"), F.col("x.stage").alias("stage"))
    parts = parts.select(F.col("id"), F.col("first"), "cells", "bed", "heights")
    wet = base.join(parts.where("first is not null"), "id", "left").where("first is null or first <= i").groupBy("id", "s", "l", "n", "stage").agg(F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"), F.coalesce(F.sum("bed"), F.lit(0.0)).alias("bed"), F.coalesce(F.sum("heights"), F.lit(0.0)).alias("heights"))
    wet = base.select("id", "s", "l", "n", "stage").join(wet.select("id", "stage", "cells", "bed", "heights"), ["id", "stage"], "left").na.fill({"cells": 0, "bed": 0.0, "heights": 0.0})
    total = parts.groupBy("id").agg((F.sum("cells") * cell).alias("catch_area"))
    surface, volume = F.col("cells") * cell, F.col("stage") * F.col("cells") * cell - F.col("heights")
    out = wet.join(total, "id", "left").withColumns({"surface": surface, "volume": volume})
    ok = (F.col("volume") > 0) & (F.col("l") > 0) & (F.col("bed") > 0)
    section, perimeter = F.col("volume") / F.col("l"), F.col("bed") / F.col("l")
    radius = F.when(ok, section / perimeter).otherwise(0.0)
    flow = F.when(ok, section * F.pow(section / perimeter, F.lit(2.0 / 3.0)) * F.sqrt("s") / F.col("n")).otherwise(0.0)
    return out.select(
        "id", "stage", "cells", F.col("surface").alias("wet_area"), F.col("bed").alias("bed_area"), "volume", F.col("s").alias("slope"), F.col("l").alias("length"), F.coalesce("catch_area", F.lit(0.0)).alias("catch_area"),
        F.when(ok, section).otherwise(0.0).alias("section"), F.when(ok, perimeter).otherwise(0.0).alias("perimeter"), radius.alias("radius"), F.col("n").alias("manning_n"), flow.alias("flow"),
    )


def stage_of_flow(forecast: DataFrame, table: DataFrame, compat: bool = False) -> DataFrame:
    """id, flow and stage of every forecast (id, flow), between the rows of table (id, stage, flow) that bracket it; NULL outside.

    A tabulated flow gives its stage; with compat it gives NULL, as where both brackets are one row.
    """
    rows = table.select("id", F.col("stage").alias("h"), F.col("flow").alias("q"))
    both = forecast.join(rows, "id", "left")
    q = F.col("flow")
    found = both.groupBy("id", "flow").agg(
        F.max(F.when(F.col("q") <= q, F.struct("q", "h"))).alias("lo"),
        F.min(F.when(F.col("q") >= q, F.struct("q", "h"))).alias("hi"),
    )
    same = F.col("lo.q") == F.col("hi.q")
    between = F.col("lo.h") + (F.col("hi.h") - F.col("lo.h")) * (q - F.col("lo.q")) / (F.col("hi.q") - F.col("lo.q"))
    return found.select("id", "flow", F.when(F.col("lo").isNull() | F.col("hi").isNull(), None).when(same, F.lit(None) if compat else F.col("lo.h")).otherwise(between).alias("stage"))


def inundation(hand: DataFrame, catch: DataFrame, stages: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Depth of water over each cell: stage of its catchment (id, stage) less hand, where over 1 mm (and mask is not NULL)."""
    df = hand.select("row", "col", F.col("value").alias("hand")).join(catch.select("row", "col", F.col("value").alias("id")), ["row", "col"])
    if mask is not None:
        df = df.join(mask.where("value is not null").select("row", "col"), ["row", "col"], "left_semi")
    df = df.join(small(stages.where("stage is not null").select("id", "stage")), "id", "left")
    return df.select("row", "col", F.when(F.col("stage") > F.col("hand") + 0.001, F.col("stage") - F.col("hand")).alias("value"))


def inundated_area(hand: DataFrame, catch: DataFrame, stages: DataFrame, meta: GridMeta) -> DataFrame:
    """id, flow, stage, inun_area, catch_area and ratio of every forecast catchment (id, flow, stage)."""
    cell = float(meta.dx * meta.dy)
    cells = hand.select("row", "col", F.col("value").alias("hand")).join(catch.select("row", "col", F.col("value").alias("id")), ["row", "col"]).where("hand is not null and id is not null")
    sums = cells.join(small(stages.select("id", "stage")), "id").groupBy("id").agg((F.sum(F.when(F.col("stage") - F.col("hand") > 0, 1).otherwise(0)) * cell).alias("inun_area"), (F.count("*") * cell).alias("catch_area"))
    out = stages.join(sums, "id", "left")
    return out.select("id", "flow", "stage", F.coalesce("inun_area", F.lit(0.0)).alias("inun_area"), F.coalesce("catch_area", F.lit(0.0)).alias("catch_area"), F.when(F.col("catch_area") > 0, F.col("inun_area") / F.col("catch_area")).otherwise(0.0).alias("ratio"))


def region_table(regions: DataFrame, defaults: dict[str, float] | None = None) -> DataFrame:
    """Calibration row of every distinct region of a grid, in order."""
    # The calibration a region has unless it is given another.
    values = {"tmin": 2.708, "tmax": 2.708, "cmin": 0.0, "cmax": 0.25, "phimin": 30.0, "phimax": 45.0, "density": 2000.0} | (defaults or {})
    ids = regions.where("value is not null").select(F.col("value").cast("int").alias("id")).distinct()
    return ids.select("id", *(F.lit(float(v)).alias(k) for k, v in values.items())).orderBy("id")


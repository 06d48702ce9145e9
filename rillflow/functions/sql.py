"""SQL surface: scalar functions and table functions for spark.sql."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .grid import GridMeta


def register(spark: SparkSession) -> None:
    """Registers flow_share(angle, k, dx, dy), wetness(area, slope) and d8_step(k, dx, dy) as SQL expressions that Catalyst inlines."""
    pi = "3.14159265359D"
    marks = f"array(0D, atan2(dy, dx), {pi} / 2, {pi} - atan2(dy, dx), {pi}, {pi} + atan2(dy, dx), {pi} * 1.5D, 2 * {pi} - atan2(dy, dx), 2 * {pi})"
    turned = f"CASE WHEN k = 1 AND angle > {pi} THEN angle - 2 * {pi} ELSE angle END"
    low = f"CASE WHEN k = 1 THEN -atan2(dy, dx) ELSE element_at({marks}, greatest(k - 1, 1)) END"
    mid, high = f"element_at({marks}, k)", f"element_at({marks}, k + 1)"
    share = f"CASE WHEN angle >= 0 AND ({turned}) > ({low}) AND ({turned}) < {high} THEN CASE WHEN ({turned}) > {mid} THEN ({high} - ({turned})) / ({high} - {mid}) ELSE (({turned}) - ({low})) / ({mid} - ({low})) END END"
    for name, args, kind, body in (
        ("flow_share", "angle DOUBLE, k INT, dx DOUBLE, dy DOUBLE", "DOUBLE", share),
        ("wetness", "area DOUBLE, slope DOUBLE", "DOUBLE", "CASE WHEN area > 0 AND slope > 0 THEN ln(area / slope) END"),
        ("d8_step", "k INT, dx DOUBLE, dy DOUBLE", "DOUBLE", "CASE WHEN k IN (1, 5) THEN dx WHEN k IN (3, 7) THEN dy WHEN k IN (2, 4, 6, 8) THEN sqrt(dx * dx + dy * dy) END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")


def register_tables(spark: SparkSession, meta: GridMeta, **grids: str) -> None:
    """Makes temporary views of operators over views of cells: dem gives <dem>_fel (filled), and of it <dem>_p and <dem>_ang."""
    from ..operators import direction
    from ..plans.tiles import checkpointed

    for name, view in grids.items():
        cells = spark.table(view)
        filled = checkpointed(direction.fill_pits(cells, meta))
        filled.createOrReplaceTempView(f"{name}_fel")
        direction.d8_direction(filled, meta).createOrReplaceTempView(f"{name}_p")
        direction.dinf_direction(filled, meta).createOrReplaceTempView(f"{name}_ang")

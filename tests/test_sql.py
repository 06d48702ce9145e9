"""Functions and views for SQL, and the registry itself."""

import math

import numpy as np

from rillflow.functions import sql
from rillflow.functions.grid import GridMeta
from rillflow.operators import flow
from rillflow.plans import registry


def test_functions(spark):
    sql.register(spark)
    for angle in (0.0, 0.3, math.pi / 4, 2.0, 4.0, 6.2):
        for k in range(1, 9):
            want = float(flow.shares(np.array([angle]), k, np.array([30.0]), np.array([20.0]))[0])
            got = spark.sql(f"SELECT flow_share({angle}D, {k}, 30D, 20D)").first()[0]
            assert abs((got or 0.0) - want) < 1e-4
    assert spark.sql("SELECT wetness(0D, 1D), d8_step(2, 3D, 4D)").first()[:] == (None, 5.0)


def test_views(spark):
    spark.createDataFrame([(r, c, float(10 - r)) for r in range(4) for c in range(4)], "row int, col int, value double").createOrReplaceTempView("cells")
    sql.register_tables(spark, GridMeta(4, 4), dem="cells")
    assert [r[0] for r in spark.sql("SELECT DISTINCT p FROM dem_p WHERE p IS NOT NULL").collect()] == [7]
    assert spark.sql("SELECT count(*) FROM dem_fel").first()[0] == 16


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)

"""Terrain, hydrology and table analytics declared on PySpark DataFrames."""

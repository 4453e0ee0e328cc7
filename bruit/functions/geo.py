"""Places: bounding boxes, grid cells, regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bruit.params import Params


def bbox(df: DataFrame, p: Params) -> DataFrame:
    return df.where(F.col("lon").between(p.west, p.east) & F.col("lat").between(p.south, p.north))


def wkt(lon: Column, lat: Column) -> Column:
    return F.format_string("POINT(%.6f %.6f)", lon, lat)


def with_cell(df: DataFrame, p: Params) -> DataFrame:
    """Adds the grid cell (x, y), counted from -180, -90."""
    x = F.floor((F.col("lon") + F.lit(180.0)) / F.lit(p.cell)).cast("long")
    y = F.floor((F.col("lat") + F.lit(90.0)) / F.lit(p.cell)).cast("long")
    return df.withColumns({"x": x, "y": y})


def region(cells: DataFrame, p: Params) -> DataFrame:
    """All cells (rx, ry) within reach of each cell (x, y), clipped to the grid."""
    nx, ny, r = round(360 / p.cell), round(180 / p.cell), p.reach_cells
    span = lambda c, n: F.sequence(F.greatest(F.col(c) - r, F.lit(0)), F.least(F.col(c) + r, F.lit(n - 1)))
    out = cells.select("x", "y").distinct().withColumn("rx", F.explode(span("x", nx)))
    return out.withColumn("ry", F.explode(span("y", ny)))

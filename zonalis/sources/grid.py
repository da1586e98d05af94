"""The reduced sphere grid as DataFrames.

Row i (1 at the north pole, 2n at the south pole) has nlon(i) = 3 (2 min(i, 2n - i + 1) - 1) cells of equal width. Everything
else follows from n by closed forms, so tables are generated where they are used and nothing is looked up or joined:
``spark.range`` deals out rows, and cells are exploded within them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions import geometry as G


def check_rows(n: int) -> int:
    if n < 1:
        raise ValueError("a grid has at least one row in each hemisphere")
    return n


def rows_for_cells(cells: int) -> int:
    """n of a grid of so many cells; an error if there is none."""
    n = int((cells / 6) ** 0.5 + 0.5)
    if n < 1 or 6 * n * n != cells:
        raise ValueError(f"{cells} is not the cell count of a grid")
    return n


def totals(n: int) -> dict[str, int]:
    """Numbers of cells, zonal faces and meridional interfaces."""
    return {"cells": 6 * n * n, "zonal_faces": 6 * n * n + 2 * n, "interfaces": 12 * n * n - 12 * n + 3}


def latitude_rows(spark: SparkSession, n: int) -> DataFrame:
    """One row a latitude: (i, nlon, dlon, lat, cells_above, faces_above)."""
    i = F.col("i")
    rows = spark.range(1, 2 * check_rows(n) + 1).select(F.col("id").cast("long").alias("i"))
    return rows.select(
        "i", G.nlon(i, n).alias("nlon"), G.dlon(i, n).alias("dlon"), G.row_latitude(i, n).alias("lat"), G.cells_above(i, n).alias("cells_above"), (G.cells_above(i, n) + i - 1).alias("faces_above")
    )


def _spread(rows: DataFrame, last: Column, name: str) -> DataFrame:
    return rows.withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), last)))


def cells(spark: SparkSession, n: int) -> DataFrame:
    """(cell_id, i, j, nlon, dlon, lat, lon, area): centres and areas in degrees; areas by one formula at all latitudes."""
    i, j = F.col("i"), F.col("j")
    rows = spark.range(1, 2 * check_rows(n) + 1).select(F.col("id").cast("long").alias("i"))
    return _spread(rows, G.nlon(i, n), "j").select(
        G.cell_id(i, j, n).alias("cell_id"), "i", "j", G.nlon(i, n).alias("nlon"), G.dlon(i, n).alias("dlon"), G.row_latitude(i, n).alias("lat"), G.cell_longitude(i, j, n).alias("lon"), G.cell_area(i, n).alias("area")
    )


def corners(cells: DataFrame, n: int) -> DataFrame:
    """Cells with their north, south, west and east edges."""
    i, j = F.col("i"), F.col("j")
    return cells.withColumns({"north": G.north_edge(i, n), "south": G.north_edge(i + 1, n), "west": (j - 1) * G.dlon(i, n), "east": j * G.dlon(i, n)})


def zonal_faces(spark: SparkSession, n: int) -> DataFrame:
    """(i, f, lat, lon) with f = 0 .. nlon: the west face of the first cell, then every east face."""
    i = F.col("i")
    rows = spark.range(1, 2 * check_rows(n) + 1).select(F.col("id").cast("long").alias("i"))
    return _spread(rows, G.nlon(i, n) + 1, "k").select("i", (F.col("k") - 1).alias("f"), G.row_latitude(i, n).alias("lat"), ((F.col("k") - 1) * G.dlon(i, n)).alias("lon"))


def interfaces(spark: SparkSession, n: int) -> DataFrame:
    """(i, j, l, a_id, b_id, lat, lon_mid, length): cell (i, j) over cell (i + 1, l), wherever their longitudes overlap.

    The overlap is an interval join in effect; integer arithmetic gives its bounds, so it is a projection.
    """
    i, j, k = F.col("i"), F.col("j"), F.col("l")
    rows = spark.range(1, 2 * check_rows(n)).select(F.col("id").cast("long").alias("i"))
    each = _spread(rows, G.nlon(i, n), "j").withColumn("l", F.explode(F.sequence(*G.south_bounds(i, j, n))))
    west, east = F.greatest((j - 1) * G.dlon(i, n), (k - 1) * G.dlon(i + 1, n)), F.least(j * G.dlon(i, n), k * G.dlon(i + 1, n))
    lat = G.north_edge(i + 1, n)
    return each.select("i", "j", "l", G.cell_id(i, j, n).alias("a_id"), G.cell_id(i + 1, k, n).alias("b_id"), lat.alias("lat"), (west + (east - west) / 2).alias("lon_mid"), ((east - west) * F.cos(F.radians(lat))).alias("length"))


def edges(spark: SparkSession, n: int) -> DataFrame:
    """Undirected adjacency of the cells: (a, b) with a < b, ring neighbours and neighbours across rows."""
    ring = cells(spark, n).filter("nlon > 1").select(F.col("cell_id").alias("a"), G.cell_id(F.col("i"), F.col("j") % F.col("nlon") + 1, n).alias("b"))
    across = interfaces(spark, n).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return ring.unionByName(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def spiral(spark: SparkSession, points: int) -> DataFrame:
    """(k, x, y) of a Fibonacci spiral: radius sqrt(k - 1/2), angle 2 pi k / golden ratio."""
    k = F.col("id").cast("long")
    angle = 2 * F.pi() * k / F.lit((1 + 5**0.5) / 2)
    return spark.range(1, points + 1).select(k.alias("k"), (F.sqrt(k - 0.5) * F.cos(angle)).alias("x"), (F.sqrt(k - 0.5) * F.sin(angle)).alias("y"))

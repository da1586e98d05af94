"""Polygons on the sphere as seen from one side: clipped at the horizon and projected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions.geometry import cartesian


def clipped_polygons(polygons: DataFrame, lat0: float, lon0: float, corners: str = "corners", name: str = "polygon") -> DataFrame:
    """Adds the near part of each polygon (an array of (lat, lon)) as an array of (x, y) of the orthographic projection.

    Corners behind the horizon go; where an edge crosses it, the point of the edge's great circle on the horizon comes in. What lies behind has
    an empty array, null polygons stay null. Each step is a column of its own, so nothing is worked out twice.
    """
    p0, l0 = F.radians(F.lit(lat0)), F.radians(F.lit(lon0))

    def seen(c: Column) -> Column:
        x, y, z = cartesian(c["lat"], c["lon"])
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"), (F.cos(p0) * F.cos(l0) * x + F.cos(p0) * F.sin(l0) * y + F.sin(p0) * z).alias("d"))

    def edge(a: Column, k: Column) -> Column:
        b = F.get(F.col("_at"), (k + 1) % F.size("_at"))
        return F.struct(a.alias("a"), b.alias("b"), (a["d"] / F.nullif(a["d"] - b["d"], F.lit(0.0))).alias("t"))

    def crossing(e: Column) -> Column:
        return F.struct(e["a"].alias("a"), e["b"].alias("b"), *((e["a"][c] + e["t"] * (e["b"][c] - e["a"][c])).alias(c) for c in "xyz"))

    def plane(v: Column, size: Column) -> Column:
        x, y = F.cos(l0) * v["y"] - F.sin(l0) * v["x"], F.cos(p0) * v["z"] - F.sin(p0) * (F.cos(l0) * v["x"] + F.sin(l0) * v["y"])
        return F.struct((x / size).alias("x"), (y / size).alias("y"))

    def points(e: Column) -> Column:
        a, b = e["a"]["d"] >= 0, e["b"]["d"] >= 0
        size = F.sqrt(e["x"] * e["x"] + e["y"] * e["y"] + e["z"] * e["z"])
        return F.array(F.when(a, plane(e["a"], F.lit(1.0))), F.when(a != b, plane(e, size)))

    out = polygons.withColumn("_at", F.transform(corners, seen)).withColumn("_edges", F.transform(F.transform("_at", edge), crossing))
    return out.withColumn(name, F.filter(F.flatten(F.transform("_edges", points)), lambda p: p.isNotNull())).drop("_at", "_edges")


def polygon_area(polygon: str) -> Column:
    """Area of a column of arrays of (x, y), positive if they run clockwise."""
    after = lambda k: F.get(F.col(polygon), (k + 1) % F.size(polygon))
    cross = F.transform(polygon, lambda p, k: after(k)["x"] * p["y"] - p["x"] * after(k)["y"])
    return F.aggregate(cross, F.lit(0.0), lambda a, c: a + c) / 2

"""The nearest points of the spiral for many places: their time, and places of all kinds side by side."""

import math
import time

from pyspark.sql import functions as F

from zonalis.functions import spiral


def test_a_place_costs_microseconds(spark):
    points, places = 5000, 100_000
    r, angle = F.sqrt(F.lit(points) * (F.col("id") + 0.5) / places), F.col("id") * 1.2345
    df = spark.range(0, places, 1, 1).select((r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"))
    near = df.select(spiral.nearest_on_spiral(F.col("x"), F.col("y"), points).alias("k"))
    began = time.perf_counter()
    rows, known, least, most = near.agg(F.count("*"), F.count("k"), F.min("k"), F.max("k")).first()
    assert time.perf_counter() - began < 20  # a task of 0.2 ms a place; with the basis in each candidate it was above 0.6 ms
    assert (rows, known, least, most) == (places, places, 1, points)


def test_places_of_all_kinds_in_a_batch(spark):
    points, inf, nan = 300, float("inf"), float("nan")
    places = [(None, 1.0), (0.0, 0.0), (1.0, None), (nan, 0.0), (17.0, 3.0), (17.33, 0.0), (inf, -inf), (-5.65, 0.0), (-5.66, 0.0), (3.0, -4.0), (None, None), (0.0, -17.3)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "i int, x double, y double").coalesce(1)

    def away(x, y, k):
        a, r = 2 * math.pi * k / spiral.GOLDEN, math.sqrt(k - 0.5)
        return (r * math.cos(a) - x) ** 2 + (r * math.sin(a) - y) ** 2

    def nearest(x, y):
        if x is None or y is None or not x * x + y * y <= points:
            return None
        return min(range(1, points + 1), key=lambda k: away(x, y, k))

    got = {r.i: r.k for r in df.select("i", spiral.nearest_on_spiral(F.col("x"), F.col("y"), points).alias("k")).collect()}
    assert got == {i: nearest(*p) for i, p in enumerate(places)}
    assert [r[0] for r in df.filter("i = 1").select(spiral.nearest_on_spiral(F.col("x"), F.col("y"), 0)).collect()] == [None]
    assert df.filter("i < 0").select(spiral.nearest_on_spiral(F.col("x"), F.col("y"), points)).collect() == []

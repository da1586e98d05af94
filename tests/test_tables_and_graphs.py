"""Stored tables with keys, the nearest point of the spiral and graphs, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from zonalis.functions import spiral
from zonalis.operators import graph
from zonalis.sources import tables
from zonalis.sources.scratch import new_path

ROWS = "k string, day long, x double, note string"


def stand(spark, path):
    return {(r.k, r.day): (r.x, r.note, r.version) for r in tables.current(spark, path, ("k", "day")).collect()}


def test_only_changes_are_added(spark):
    path, keys = new_path(spark, "log"), ("k", "day")
    add = lambda rows: tables.append_changed(spark, path, spark.createDataFrame(rows, ROWS), keys)
    first = [("a", 1, 0.5, None), ("b", 1, None, "n"), (None, None, 2.0, "null keys")]
    assert add(first) == 3 and add(first) == 0 and add(first[:1]) == 0
    assert add([*first, ("a", 2, 1.0, "new"), ("b", 1, 7.0, "n")]) == 2
    assert stand(spark, path) == {("a", 1): (0.5, None, 1), ("b", 1): (7.0, "n", 2), (None, None): (2.0, "null keys", 1), ("a", 2): (1.0, "new", 2)}
    assert spark.read.parquet(path).count() == 5
    assert add([("a", 1, 0.1, "x"), ("a", 1, 0.9, "y"), ("a", 1, 0.9, "z")]) == 1
    assert stand(spark, path)[("a", 1)][:2] == (0.9, "z")
    assert add([("a", 1, 0.5, None)]) == 1 and stand(spark, path)[("a", 1)][:2] == (0.5, None)  # back to what it was


def test_an_empty_table_and_a_failed_run(spark):
    path = new_path(spark, "log")
    none = spark.createDataFrame([], ROWS)
    assert tables.append_changed(spark, path, none, ("k", "day")) == 0 and tables.current(spark, path, ("k", "day")).count() == 0
    one = spark.createDataFrame([("a", 1, 0.5, None)], ROWS)
    with pytest.raises(Exception, match="broken"):
        tables.append_changed(spark, path, one.withColumn("x", F.raise_error(F.lit("broken")).cast("double")), ("k", "day"))
    assert tables.current(spark, path, ("k", "day")).count() == 0
    assert tables.append_changed(spark, path, one, ("k", "day")) == 1
    with pytest.raises(ValueError, match="version"):
        tables.append_changed(spark, path, one.withColumn("version", F.lit(1)), ("k", "day"))


@pytest.mark.parametrize("points", [1, 2, 12, 63, 64, 65, 300, 5000, 100_003])
def test_nearest_of_all_spiral_points(spark, points):
    import numpy as np

    r = random.Random(points)
    places = [(math.sqrt(points * u) * math.cos(a), math.sqrt(points * u) * math.sin(a)) for u, a in ((r.random() if k % 4 else 1 - 1e-9 - r.random() * 1e-3, r.uniform(-7, 7)) for k in range(1500))]
    places += [(0.0, 0.0), (math.sqrt(points) * 0.999, 0.0), (0.0, -math.sqrt(points) * 0.999)]
    df = spark.createDataFrame(places, "x double, y double")
    got = df.select("x", "y", spiral.nearest_on_spiral(F.col("x"), F.col("y"), points).alias("k")).collect()
    k = np.arange(1, points + 1)
    px, py = np.sqrt(k - 0.5) * np.cos(2 * math.pi * k / spiral.GOLDEN), np.sqrt(k - 0.5) * np.sin(2 * math.pi * k / spiral.GOLDEN)
    for row in got:
        d = (px - row.x) ** 2 + (py - row.y) ** 2
        assert d[row.k - 1] <= d.min() + 1e-9


def test_no_point_is_nearest(spark):
    df = spark.createDataFrame([(None, 1.0), (9.0, 9.0), (float("nan"), 0.0)], "x double, y double")
    assert [r[0] for r in df.select(spiral.nearest_on_spiral(F.col("x"), F.col("y"), 16)).collect()] == [None, None, None]


def plain_parts(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a in root and b in root:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, "a long, b long")


@pytest.mark.parametrize("kind", ["chain", "star", "random", "cycle", "none"])
def test_connected_parts(spark, kind):
    r = random.Random(2)
    nodes = list(range(0, 240))
    pairs = {
        "chain": [(k, k + 1) for k in range(239) if k % 80 != 79], "star": [(7, k) for k in range(0, 240, 2)] + [(k, k) for k in range(5)], "random": [(r.randrange(300), r.randrange(300)) for _ in range(150)],
        "cycle": [(k, (k + 1) % 240) for k in range(240)], "none": [],
    }[kind]
    table = spark.createDataFrame([(n,) for n in nodes] + [(3,)], "cell_id long")
    got = {x.cell_id: x.part for x in graph.connected_parts(table, pairs_of(spark, pairs + pairs[:3])).collect()}
    assert got == plain_parts(nodes, pairs)


def test_one_sided_and_isolated(spark):
    table = spark.createDataFrame([(1, [2, 3, 3]), (2, [1]), (3, []), (4, None), (5, [5])], "cell_id long, near array<long>")
    pairs = graph.entries(table)
    assert {tuple(x) for x in pairs.collect()} == {(1, 2), (1, 3), (2, 1), (5, 5)}
    assert [tuple(x) for x in graph.one_sided(pairs).collect()] == [(1, 3)]
    assert [x.cell_id for x in graph.isolated(table, pairs).collect()] == [4]

"""As-of joins and exact sums against plain loops."""

import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from zonalis.operators import exact, timeline


def plain_brackets(points, marks):
    known = {}
    for k, t, v in marks:
        if t is not None and v is not None:
            line = known.setdefault(k, {})
            line[t] = max(v, line.get(t, v))
    out = []
    for name, k, t in points:
        line = known.get(k, {}) if t is not None else {}
        before, behind = [x for x in line if x <= t] if line else [], [x for x in line if x > t] if line else []
        a, b = max(before, default=None), min(behind, default=None)
        out.append((name, k, t, a, line.get(a), b, line.get(b)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "share", "marks_share"), [(0, 0.0, 0.3), (1, 0.8, 0.3), (2, 1.0, 0.01), (3, 0.5, 0.0)])
def test_brackets(spark, seed, share, marks_share):
    r = random.Random(seed)
    key = lambda: "hot" if r.random() < share else r.choice(["a", "b", None, "c"])
    time = lambda: r.choice([None, r.randrange(300), r.randrange(300)])
    points = [(f"p{k // 2}", key(), time()) for k in range(600)]
    marks = [(key(), time(), r.choice([None, 1.5 * k, float(k % 3)])) for k in range(int(600 * marks_share))]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "17")  # a key's line is cut into several parts
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = timeline.bracketed(spark.createDataFrame(points, "name string, k string, t long"), spark.createDataFrame(marks, "k string, t long, value double"), ("k",))
        assert got.columns == ["k", "t", "name", "t0", "v0", "t1", "v1"]
        rows = [(x.name, x.k, x.t, x.t0, x.v0, x.t1, x.v1) for x in got.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(rows, key=str) == plain_brackets(points, marks)


def test_brackets_without_keys_or_rows(spark):
    points, marks = spark.createDataFrame([(5,), (7,)], "t long"), spark.createDataFrame([(6, 1.0)], "t long, value double")
    got = timeline.bracketed(points, marks, ()).orderBy("t").collect()
    assert [tuple(x) for x in got] == [(5, None, None, 6, 1.0), (7, 6, 1.0, None, None)]
    assert timeline.bracketed(points.limit(0), marks, ()).count() == 0
    assert [x.t0 for x in timeline.bracketed(points, marks.limit(0), ()).collect()] == [None, None]


def test_lines_between_marks(spark):
    row = spark.createDataFrame([(5, 5, 1.0, 9, 3.0), (7, 5, 1.0, 9, 3.0), (7, 5, 1.0, None, None)], "t long, t0 long, v0 double, t1 long, v1 double")
    values = [r[0] for r in row.select(timeline.interpolated(*(F.col(c) for c in row.columns))).collect()]
    assert values == [1.0, 2.0, None]


def some_doubles(seed, count):
    r = random.Random(seed)
    kinds = [
        lambda: r.uniform(-1, 1), lambda: r.uniform(-1, 1) * 10 ** r.randint(-320, 300), lambda: float(r.randrange(-5, 5)), lambda: math.ldexp(1.0, r.randint(-1074, 1000)), lambda: math.nextafter(math.ldexp(1.0, r.randint(-900, 900)), 0.0),
        lambda: math.nextafter(math.ldexp(1.0, r.randint(-900, 900)), math.inf), lambda: r.choice([5e-324, -5e-324, 0.0, -0.0]), lambda: -1e300, lambda: 1e300,
    ]
    return [r.choice(kinds)() for _ in range(count)]


def bits(x):
    return struct.pack("d", x)


@pytest.mark.parametrize("seed", range(4))
def test_sums_are_the_nearest_double_in_any_order(spark, seed):
    rows = [(k % 3, x) for k, x in enumerate(some_doubles(seed, 400))]
    want = {g: sum((Fraction(x) for k, x in rows if k == g), Fraction(0)) for g in range(3)}
    df = spark.createDataFrame(rows + [(7, None), (7, None), (1, None)], "g int, x double")
    for parts in (1, 5):
        got = {r.g: r.total for r in exact.exact_sum(df.orderBy(F.rand(parts)).repartition(parts), ("g",), "x").collect()}
        assert got.pop(7) == 0.0
        assert {g: bits(x) for g, x in got.items()} == {g: bits(float(f)) for g, f in want.items()}


def test_sums_of_what_is_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, nan), (1, 1.0), (2, inf), (2, -inf), (3, inf), (3, 5.0), (4, 1.7e308), (4, 1.7e308), (5, -1.7e308), (5, -1.7e308)], "g int, x double")
    got = {r.g: r.total for r in exact.exact_sum(df, ("g",), "x").collect()}
    assert math.isnan(got[1]) and math.isnan(got[2]) and got[3] == inf and got[4] == inf and got[5] == -inf
    assert exact.exact_sum(df.limit(0), ("g",), "x").count() == 0
    assert exact.exact_sum(df.filter("g = 4").withColumn("x", F.lit(0.1)), (), "x").first()[0] == 0.2


def test_units(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.25), ("b", 0.1), ("c", float("inf")), ("d", None)], "g string, x double")
    assert {r.g: r.units for r in exact.exact_units(df, ("g",), "x", -2).collect()} == {"a": "3", "b": None, "c": None, "d": "0"}

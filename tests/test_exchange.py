"""Fields between grids, files, times and tables, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.operators import overlap as O
from zonalis.operators import remap as R
from zonalis.sources import grid, text
from zonalis.sources.scratch import new_path

CELL = "cell_id long, north double, south double, west double, east double"


def plain_overlaps(a, b):
    """Area of each pair by comparing all, with longitudes taken modulo 360."""
    out = {}
    for i, n1, s1, w1, e1 in a:
        for k, n2, s2, w2, e2 in b:
            n, s = min(n1, n2), max(s1, s2)
            if n <= s or n1 <= s1 or n2 <= s2:
                continue
            width = sum(max(0.0, min(e1, e2 + t) - max(w1, w2 + t)) for t in (-720, -360, 0, 360, 720))
            if width > 1e-9:
                out[i, k] = width * (np.sin(np.radians(n)) - np.sin(np.radians(s))) * 180 / np.pi
    return out


def some_cells(seed, count):
    r, out = random.Random(seed), []
    for k in range(count):
        south, west = r.uniform(-90, 89), r.choice([r.uniform(-360, 360), 0.0, 350.0, -10.0])
        out.append((k, min(90.0, south + r.choice([0.5, 5, 60, 180])), south, west, west + r.choice([0.1, 3, 90, 360])))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_of_any_rectangles(spark, seed):
    a, b = some_cells(seed, 40), some_cells(100 + seed, 90)
    got = {(r.src, r.dst): r.area for r in O.overlaps(spark.createDataFrame(a, CELL), spark.createDataFrame(b, CELL)).collect()}
    want = plain_overlaps(a, b)
    assert {k for k, v in want.items() if v > 1e-6} <= set(got)
    for k in set(got) | set(want):
        assert got.get(k, 0.0) == pytest.approx(want.get(k, 0.0), abs=1e-7)


def test_overlaps_leave_out_what_is_no_cell(spark):
    good = [(1, 10.0, 0.0, 0.0, 10.0)]
    bad = [(2, 0.0, 10.0, 0.0, 10.0), (3, 5.0, 5.0, 0.0, 1.0), (4, None, 0.0, 0.0, 1.0), (5, 10.0, 0.0, 7.0, 7.0)]
    a, empty = spark.createDataFrame(good + bad, CELL), spark.createDataFrame([], CELL)
    assert [(r.src, r.dst) for r in O.overlaps(a, a).collect()] == [(1, 1)]
    assert O.overlaps(empty, empty).count() == 0 and O.overlaps(a, empty).count() == 0


@pytest.mark.parametrize(("n", "m"), [(3, 5), (5, 3), (4, 4)])
def test_links_between_reduced_grids_keep_mass(spark, n, m):
    here, there = (grid.corners(grid.cells(spark, k), k) for k in (n, m))
    shares = O.conservative_links(here, there)
    full = shares.groupBy("dst").agg(F.sum("w").alias("w")).filter(F.abs(F.col("w") - 1) > 1e-12)
    assert full.count() == 0
    field = here.select(F.lit("t").alias("tracer"), "cell_id", (F.col("cell_id") % 7).cast("double").alias("q"))
    moved = R.remap(field, R.weighted_links(shares, F.col("dst_area"), "frac"), "frac")
    before = here.join(field, "cell_id").agg(F.sum(F.col("q") * F.col("area"))).first()[0]
    after = there.join(moved, "cell_id").agg(F.sum(F.col("q") * F.col("area"))).first()[0]
    assert after == pytest.approx(before, rel=1e-12)


def test_masked_cells_take_no_part(spark):
    cells = grid.corners(grid.cells(spark, 2), 2).withColumn("mask", (F.col("cell_id") % 2).cast("int"))
    links = O.conservative_links(cells, cells)
    assert {(r.src, r.dst) for r in links.collect()} == {(k, k) for k in range(1, 25, 2)}


def test_grid_files_come_back(spark):
    cells = grid.corners(grid.cells(spark, 3), 3).withColumn("mask", (F.col("cell_id") % 3 > 0).cast("int"))
    path = text.write_grid(cells, new_path(spark, "grid"))
    spark.createDataFrame([("# made by a test",), ("",)], "value string").write.mode("append").text(path)
    names = ["cell_id", "mask", "lat", "lon", "north", "south", "west", "east"]
    read = {r[0]: r[1:] for r in text.read_grid(spark, path).select(names).collect()}
    for r in cells.select(names).collect():
        assert read[r[0]] == pytest.approx(tuple(r[1:]), abs=1e-13)
    assert len(read) == 54


# Files


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16])
def test_places_in_files_are_those_of_the_tables(spark, n):
    from pyspark.sql import Window

    from zonalis.functions import geometry as G

    i = F.col("i")
    cells = grid.cells(spark, n).select("i", "j", *(c.alias(k) for c, k in zip(G.cell_place(F.col("cell_id"), n), "xy", strict=True)))
    assert cells.filter("i <> x or j <> y").count() == 0
    place = F.row_number().over(Window.orderBy("i", "f")) - 1
    faces = grid.zonal_faces(spark, n).withColumn("place", place.cast("long"))
    assert faces.select("i", "f", *(c.alias(k) for c, k in zip(G.face_place(F.col("place"), n), "xy", strict=True))).filter("i <> x or f <> y").count() == 0
    place = F.row_number().over(Window.orderBy("i", "lon_mid")) - 1
    inter = grid.interfaces(spark, n).withColumn("place", place.cast("long"))
    found = inter.select(i, "j", "l", *(c.alias(k) for c, k in zip(G.interface_place(F.col("place"), n), "xyz", strict=True)))
    assert found.filter("i <> x or j <> y or l <> z").count() == 0
    assert found.count() == grid.totals(n)["interfaces"]


def test_lines_are_numbered_over_splits_comments_and_parts(spark, tmp_path):
    n = 5
    lines = [f"{k / 8:23.16f} {0.0:23.16f} {0.0:23.16f}" for k in range(150)]
    (tmp_path / "ratio_1_202401010000.dat").write_text("# first\n" + "\n".join(lines[:70]) + "\n\n # more\n" + "\n".join(lines[70:]) + "\n")
    folder = tmp_path / "ratio_22_202401010000.dat"
    folder.mkdir()
    for part, (a, b) in enumerate([(0, 1), (1, 90), (90, 150)]):
        (folder / f"part-{part:08d}").write_text("\n".join(lines[a:b]) + "\n")
    (tmp_path / "ratio_1_202401020000.dat").write_text("\n".join(lines + ["9 9 9"]) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        read = text.scan_positions(spark, str(tmp_path), "ratio", n)
        rows = read.collect()
        assert spark.read.text(f"{tmp_path}/*.dat").rdd.getNumPartitions() > 10
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    places = {k + 1: (r.i, r.j) for k, r in enumerate(grid.cells(spark, n).orderBy("cell_id").collect())}
    for tracer, stamp, extra in (("1", 202401010000, 0), ("22", 202401010000, 0), ("1", 202401020000, 1)):
        mine = sorted((r.line, r.i, r.j, r.value) for r in rows if (r.tracer, r.stamp) == (tracer, stamp))
        assert mine[:150] == [(k, *places[k + 1], k / 8) for k in range(150)]
        assert mine[150:] == [(150, None, None, 9.0)] * extra
    only = text.scan_positions(spark, str(tmp_path), "ratio", n, stamp="202401020000")
    assert only.count() == 151


def _named(spark, count, name="ratio_1_202401010000.dat"):
    return spark.range(count).select(F.lit(name).alias("name"), F.col("id").alias("place"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))


def test_sink_writes_files_and_parts_in_order(spark, tmp_path):
    from zonalis.sources import sink

    base = tmp_path / "out"
    both = _named(spark, 25).unionByName(_named(spark, 7, "u_202401010000.dat")).orderBy(F.rand(1))
    sink.write_named(both, f"file://{base}", lines_per_file=10)
    assert sorted(p.name for p in base.iterdir()) == ["ratio_1_202401010000.dat", "u_202401010000.dat"]
    assert (base / "u_202401010000.dat").read_text().splitlines() == [f"line {k}" for k in range(7)]
    parts = sorted((base / "ratio_1_202401010000.dat").iterdir())
    assert [p.name for p in parts] == [f"part-{k:08d}" for k in range(3)]
    assert "".join(p.read_text() for p in parts).splitlines() == [f"line {k}" for k in range(25)]
    with pytest.raises(Exception, match="there already"):
        sink.write_named(_named(spark, 3), f"file://{base}")
    assert len(list((base / "ratio_1_202401010000.dat").iterdir())) == 3
    sink.write_named(_named(spark, 3), f"file://{base}", mode="overwrite")
    assert (base / "ratio_1_202401010000.dat").read_text() == "line 0\nline 1\nline 2\n"
    assert sorted(p.name for p in base.iterdir()) == ["ratio_1_202401010000.dat", "u_202401010000.dat"]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    from zonalis.sources import sink

    base = tmp_path / "out"
    base.mkdir()
    good = _named(spark, 50).unionByName(_named(spark, 50, "v_202401010000.dat"))
    bad = good.withColumn("line", F.when((F.col("place") == 40) & F.col("name").startswith("v"), F.raise_error(F.lit("broken"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="broken"):
        sink.write_named(bad, str(base))
    assert list(base.iterdir()) == []


def test_commit_takes_only_what_successful_tasks_told(tmp_path):
    from zonalis.sources.sink import FieldWriter

    writer = FieldWriter(str(tmp_path / "out"), False)
    row = {"name": "u_1.dat", "part": 0, "line": "kept"}
    lost = writer.write(iter([row | {"line": "of a lost attempt"}]))
    told = writer.write(iter([row]))
    assert lost.found and list((tmp_path / "out").iterdir()) == [tmp_path / "out" / writer.staging.rsplit("/", 1)[1]]
    writer.commit([told, None])
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["u_1.dat"] and (tmp_path / "out/u_1.dat").read_text() == "kept\n"
    again = FieldWriter(str(tmp_path / "out"), True)
    with pytest.raises(ValueError, match="two tasks"):
        again.commit([again.write(iter([row])), again.write(iter([row]))])


# Projections and vectors


def near_side(lat, lon, lat0, lon0):
    a, b, c = np.radians(lat), np.radians(lat0), np.radians(lon - lon0)
    return np.sin(b) * np.sin(a) + np.cos(b) * np.cos(a) * np.cos(c)


def test_polygons_are_clipped_at_the_horizon(spark):
    from zonalis.operators import polygons

    square = lambda lat, lon, s=20.0: [(lat + s, lon - s), (lat + s, lon + s), (lat - s, lon + s), (lat - s, lon - s)]
    shapes = {1: square(0, 0), 2: square(0, 180), 3: square(0, 90), 4: square(0, 80), 5: [(89.0, 0.0), (89.0, 120.0), (89.0, 240.0)], 6: None}
    df = spark.createDataFrame([(k, v) for k, v in shapes.items()], "id int, corners array<struct<lat: double, lon: double>>")
    got = {r.id: (r.polygon, r.area) for r in polygons.clipped_polygons(df, 0.0, 0.0).withColumn("area", polygons.polygon_area("polygon")).collect()}
    assert got[6][0] is None and got[2][0] == []
    assert np.allclose([(p.x, p.y) for p in got[1][0]], [(np.cos(np.radians(a)) * np.sin(np.radians(b)), np.sin(np.radians(a))) for a, b in shapes[1]])
    assert got[1][1] > 0 and len(got[3][0]) == 4 and len(got[4][0]) == 4 and len(got[5][0]) in (3, 4)
    for k in (3, 4, 5):
        on_rim = [p for p in got[k][0] if abs(p.x**2 + p.y**2 - 1) < 1e-12]
        inside = [p for p in got[k][0] if p.x**2 + p.y**2 < 1 - 1e-12]
        assert len(on_rim) >= 2 - (k == 5) and len(inside) == sum(near_side(a, b, 0, 0) > 1e-12 for a, b in shapes[k])


def test_maps(spark):
    from zonalis.functions import geometry as G

    df = spark.createDataFrame([(0.0, 0.0), (0.0, 270.0), (80.0, 270.0), (-80.0, 0.0), (69.9, 5.0)], "lat double, lon double")
    lat, lon = F.col("lat"), F.col("lon")
    rows = df.select(*(c.alias(k) for k, c in zip("abcdef", (*G.miller(lat, lon), *G.polar(lat, lon), *G.polar(lat, lon, -1)), strict=True))).collect()
    assert tuple(rows[0])[:2] == pytest.approx((0, 0), abs=1e-12) and rows[1].a == pytest.approx(-np.pi / 2)
    r = 2 * np.tan(np.radians(5))
    assert (rows[2].c, rows[2].d) == pytest.approx((0, -r), abs=1e-12) and (rows[3].e, rows[3].f) == pytest.approx((r, 0), abs=1e-12)
    assert rows[2].e is None and rows[4].c is None and rows[4].e is None


def test_vectors_turn_with_their_points(spark):
    from zonalis.functions import geometry as G

    r = random.Random(4)
    rows = [(r.uniform(-1, 1), r.uniform(-1, 1), r.uniform(-89, 89), r.uniform(0, 360)) for _ in range(200)]
    df = spark.createDataFrame(rows, "u double, v double, lat double, lon double")
    u, v, lat, lon = (F.col(c) for c in df.columns)
    small = 1e-6
    # a short step along the vector, turned, is a short step along the turned vector
    stepped = G.rotated(lat + v * small, lon + u * small / F.cos(F.radians(lat)), 30.0, 60.0)
    here, turned = G.rotated(lat, lon, 30.0, 60.0), G.rotated_vector(u, v, lat, lon, 30.0, 60.0)
    out = df.select(*(c.alias(k) for k, c in zip("abcdef", (*here, *stepped, *turned), strict=True)), "u", "v").collect()
    for x in out:
        east = ((x.d - x.b + 180) % 360 - 180) * np.cos(np.radians(x.a)) / small
        assert (x.e, x.f) == pytest.approx((east, (x.c - x.a) / small), abs=2e-4)
        assert x.e**2 + x.f**2 == pytest.approx(x.u**2 + x.v**2)


def test_pairs_of_wind_files(spark, tmp_path):
    lines = lambda values, lon: "".join(f"{q} {k}.5 {lon}\n" for k, q in enumerate(values))
    (tmp_path / "u_202401010000.dat").write_text("# u\n" + lines([1.0, -9999.0, 3.0], 7))
    (tmp_path / "v_202401010000.dat").write_text(lines([4.0, 5.0, 6.0], 7))
    rows = sorted(tuple(r) for r in text.paired_winds(spark, str(tmp_path)).drop("stamp").collect())
    assert rows == [(0, 1.0, 4.0, 0.5, 7.0), (1, None, 5.0, 1.5, 7.0), (2, 3.0, 6.0, 2.5, 7.0)]
    for broken in (lines([4.0, 5.0, 6.0], 8), lines([4.0, 5.0], 7), lines([4.0] * 4, 7)):
        (tmp_path / "v_202401010000.dat").write_text(broken)
        with pytest.raises(Exception, match="different points"):
            text.paired_winds(spark, str(tmp_path)).collect()

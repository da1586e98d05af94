"""Invariants of grid and transport: counts, neighbours, closure, conservation, and the stored accuracy figures."""

import math

import pytest
from pyspark.sql import functions as F

from zonalis.functions import clock, fields
from zonalis.functions import geometry as G
from zonalis.jobs.simulate import RunConfig, initial_field, run, simulate, sweep
from zonalis.operators import diagnostics as D
from zonalis.operators import partition as P
from zonalis.operators import remap as R
from zonalis.operators import transport as T
from zonalis.sources import grid, text
from zonalis.sources.scratch import Scratch


def nlon(i, n):
    return 3 * (2 * min(i, 2 * n - i + 1) - 1)


def neighbours(n):
    """Pairs of cells whose longitudes overlap, by comparing all pairs of two rows."""
    for i in range(1, 2 * n):
        a, b = nlon(i, n), nlon(i + 1, n)
        for j in range(1, a + 1):
            for k in range(1, b + 1):
                if max((j - 1) * b, (k - 1) * a) < min(j * b, k * a):
                    yield i, j, k


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_counts_and_neighbours(spark, n):
    t = grid.totals(n)
    cells = grid.cells(spark, n).collect()
    assert [c.cell_id for c in sorted(cells, key=lambda c: (c.i, c.j))] == list(range(1, t["cells"] + 1))
    assert grid.zonal_faces(spark, n).count() == t["zonal_faces"]
    pairs = {(r.i, r.j, r.l) for r in grid.interfaces(spark, n).collect()}
    assert pairs == set(neighbours(n)) and len(pairs) == t["interfaces"]
    assert math.isclose(sum(c.area for c in cells), 4 * math.pi * (180 / math.pi) ** 2, rel_tol=1e-12)


def test_size_from_cells():
    assert grid.rows_for_cells(6 * 80 * 80) == 80
    with pytest.raises(ValueError):
        grid.rows_for_cells(100)


def test_prefix_counts(spark):
    for r in grid.latitude_rows(spark, 4).withColumn("k", G.interfaces_above(F.col("i"), 4)).collect():
        assert r.cells_above == sum(nlon(i, 4) for i in range(1, r.i))
        assert r.k == sum(1 for i, _, _ in neighbours(4) if i < r.i)


def test_limiter(spark):
    rows = spark.createDataFrame([(0.0, 1.0, 4.0), (4.0, 1.0, 0.0), (0.0, 2.0, 1.0), (1.0, 1.0, 2.0), (0.0, 1.0, 2.0)], "a double, b double, c double")
    got = [r.s for r in rows.select(T.limited_slope(F.col("a"), F.col("b"), F.col("c")).alias("s")).collect()]
    assert got == [2.0, -2.0, 0.0, 0.0, 1.0]


def test_courant_number_of_the_stored_run(spark):
    """n = 80, 20 minutes, deformational winds at the start: 0.95605."""
    u, v = T.corrected_winds(*T.analytic_winds(spark, 80, fields.wind("deformation"), 0.0), 80)
    assert round(T.courant_number(u, v, 80, 1200.0).first().courant, 5) == 0.95605


def test_corrected_winds_have_no_divergence(spark):
    u, v = T.corrected_winds(*T.analytic_winds(spark, 10, fields.wind("deformation"), 4800.0), 10)
    assert T.divergence(u, v, 10).agg(F.max(F.abs("residual"))).first()[0] < 1e-13


@pytest.mark.parametrize("splitting", ["zonal-first", "alternate", "symmetric"])
def test_mass_is_kept(spark, splitting):
    field = initial_field(spark, 6, "gaussian", "band")
    last = simulate(spark, field, RunConfig(n=6, steps=2, dt=12000.0, splitting=splitting))
    before = {r.tracer: r.mass for r in D.mass(field, 6).collect()}
    for r in D.mass(last, 6).collect():
        assert math.isclose(r.mass, before[r.tracer], rel_tol=1e-12)


def test_uniform_field_stays_uniform(spark):
    last = simulate(spark, initial_field(spark, 5, "uniform"), RunConfig(n=5, steps=2, courant=0.9))
    assert last.agg(F.max(F.abs(F.col("q") - 1))).first()[0] < 1e-12


def test_result_does_not_depend_on_partitions(spark):
    config = RunConfig(n=5, steps=1, dt=12000.0)
    field = initial_field(spark, 5, "gaussian")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = simulate(spark, field, config)
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        r = D.compare_runs(one, simulate(spark, field, config)).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert (r.cells, r.missing, r.different) == (150, 0, 0)


def test_steps_are_numbered(spark):
    assert [k for k, _ in run(spark, initial_field(spark, 2, "wave"), RunConfig(n=2, steps=2, dt=10000.0, wind="rotation"))] == [0, 1, 2]


def test_config():
    c = RunConfig.parse("n = 8 ! rows\nsteps=3\n\n! nothing\ndt = 600\nsplitting = alternate\nlimited = false")
    assert (c.n, c.steps, c.dt, c.splitting, c.limited) == (8, 3, 600.0, "alternate", False)
    for bad in ("n=8\nsteps=1", "n=8\nsteps=1\ndt=1\ncolour=red", "n=0\nsteps=1\ndt=1", "n=8\nsteps=1\ndt=1\nwind=none"):
        with pytest.raises(ValueError):
            RunConfig.parse(bad)


def test_periods_and_emission():
    assert [clock.period_minutes(t) for t in ("30", "0130", "010000")] == [30, 90, 1440]
    assert [k for k in range(6) if clock.emits(k, 600, 1200, 5)] == [0, 2, 4, 5]


def test_text_round_trip(spark):
    field = initial_field(spark, 3, "gaussian", "wave").withColumn("q", F.when(F.col("cell_id") != 7, F.col("q")))
    back = text.read_field(spark, text.write_field(field, 3, Scratch(spark)), 3)
    joined = field.alias("a").join(back.alias("b"), ["tracer", "cell_id"])
    assert joined.count() == 2 * 54 and text.checked_size(back) == 3
    assert joined.filter(~F.col("a.q").eqNullSafe(F.col("b.q")) & (F.abs(F.col("a.q") - F.col("b.q")) > 1e-15)).count() == 0
    lines = spark.createDataFrame([("# no",), ("",), (" 1.5 2.0  3.0",)], "value string")
    assert [tuple(r) for r in text.numbers(lines).collect()] == [(1.5, 2.0, 3.0)]


@pytest.mark.parametrize("parts", [1, 3, 6, 24, 54, 30])
def test_partitions_cover_the_sphere(spark, parts):
    got = grid.cells(spark, 6).select(P.part_id(F.col("i"), F.col("j"), 6, parts).alias("p")).groupBy("p").count().collect()
    assert sorted(r.p for r in got) == list(range(parts)) and sum(r["count"] for r in got) == 216
    if parts > 1:
        pairs = {(r.part, r.other) for r in P.adjacency(spark, 6, parts).collect()}
        assert {p for pair in pairs for p in pair} == set(range(parts))


def test_remap_weights(spark):
    sums = R.overlap_links(spark, 3).groupBy("dst").agg(F.sum("w").alias("w")).collect()
    assert len(sums) == 6 * 36 and all(math.isclose(r.w, 1.0, rel_tol=1e-12) for r in sums)


def test_points_fall_into_their_cells(spark):
    n = 4
    inside = R.bin_points(grid.cells(spark, n).select(F.col("cell_id").alias("own"), "lat", "lon"), n)
    assert inside.filter("own <> cell_id").count() == 0
    poles = spark.createDataFrame([(90.0, 0.0), (-90.0, 359.9), (0.5, 360.0), (0.5, -1.0)], "lat double, lon double")
    assert [(r.i, r.j) for r in R.bin_points(poles, n).collect()] == [(1, 1), (8, 3), (4, 1), (4, 21)]


def test_spiral_and_models(spark):
    assert grid.spiral(spark, 10).count() == 10
    r = spark.range(1).select(*(c.alias(k) for k, c in G.cell_count_models(F.lit(1.5)).items())).first()
    assert (r.regular, r.cubed) == (28800.0, 21600.0)


def test_unknown_names():
    for f in (fields.case, fields.wind):
        with pytest.raises(ValueError):
            f("nothing")


def test_sweep_converges(spark):
    """One solid turn by a quarter of the sphere moves the field; finer grids and shorter steps err less per step."""
    rows = sweep(spark, "gaussian", [RunConfig(n=4, steps=1, dt=3000.0), RunConfig(n=8, steps=1, dt=1500.0)]).orderBy("n").collect()
    assert [r.n for r in rows] == [4, 8] and rows[1].l2 < rows[0].l2


def test_measures_of_zero_fields(spark):
    pairs = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 0.0, 0.1), ("b", 1, 0.5, 0.25)], "tracer string, cell_id long, q0 double, q double")
    norms = {r.tracer: r for r in D.error_norms(pairs, F.lit(1.0)).collect()}
    assert norms["a"].l2 is None and norms["a"].l_inf is None and norms["a"].quadratic == pytest.approx(0.01)
    assert norms["b"].l2 == pytest.approx(0.5) and norms["b"].l_inf == pytest.approx(0.5)
    mixed = {r.tracer: r for r in D.mixing(pairs, F.lit(1.0)).collect()}
    far = [math.hypot(0.1 / 0.9, (0.892 - y) / 0.792) for y in (0.0, 0.1)]
    assert mixed["a"].real_mixing == 0 and mixed["a"].unmixing == 0 and mixed["a"].overshooting == pytest.approx(sum(far) / 2)
    times = spark.createDataFrame([(1, 0, 0.0), (2, 0, 1.0)], "procs int, proc int, seconds double")
    assert {r.procs: r.speedup for r in D.timing_stats(times).collect()} == {1: None, 2: 0.0}


@pytest.mark.parametrize("normalise", ["frac", "destarea", "none"])
def test_remap_of_partial_cover(spark, normalise):
    """Two sources cover 1/2 and 1/4 of a destination of area 8: the mean of the covered part, however weights are normalised."""
    links = spark.createDataFrame([(1, 9, 0.5), (2, 9, 0.25)], "src long, dst long, w double")
    field = spark.createDataFrame([("a", 1, 0.3), ("a", 2, 0.9), ("a", 3, 0.7)], "tracer string, cell_id long, q double")
    made = R.weighted_links(links, F.lit(8.0), normalise)
    weights = {r.src: r.w for r in made.collect()}
    assert weights[1] == pytest.approx({"frac": 2 / 3, "destarea": 0.5, "none": 4.0}[normalise])
    (got,) = R.remap(field, made, normalise).collect()
    assert (got.tracer, got.cell_id) == ("a", 9) and got.q == pytest.approx(0.5)
    with pytest.raises(ValueError):
        R.remap(field, made, "other")


def test_stored_files_by_name(spark, tmp_path):
    for name, line in (("ratio_1_202401010000", "0.5 10 20"), ("ratio_2_202401020030", "# note\n\n0.25 30 40"), ("u_202401010000", "0.1 0 0")):
        (tmp_path / f"{name}.dat").write_text(line + "\n")
    base = f"file://{tmp_path}"
    got = {(r.tracer, r.stamp, r.value, r.lat, r.lon) for r in text.read_stored(spark, base, "ratio").collect()}
    assert got == {("1", 202401010000, 0.5, 10.0, 20.0), ("2", 202401020030, 0.25, 30.0, 40.0)}
    assert [(r.tracer, r.stamp) for r in text.read_stored(spark, base, "u").collect()] == [(None, 202401010000)]
    assert text.read_stored(spark, base, "ratio", tracer="2").count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        text.read_stored(spark, base, "v").count()
    with pytest.raises(ValueError):
        text.data_path(base, "w")

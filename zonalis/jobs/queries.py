"""Registered queries of the grid operators. Fields come from ``events``: binned onto a grid whose size follows their number."""

from __future__ import annotations

from math import floor, sqrt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonalis.functions import clock, fields
from zonalis.functions import geometry as G
from zonalis.jobs.oracle import sql
from zonalis.operators import diagnostics as D
from zonalis.operators import partition as P
from zonalis.operators import remap as R
from zonalis.operators import transport as T
from zonalis.sources import grid
from zonalis.sources.scratch import Scratch, new_path

#: Parts of the registered partition queries.
PARTS = 24


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_size(spark: SparkSession, sf_dir: str) -> int:
    """n for the events of a scale: about 24 events a cell."""
    return max(4, floor(sqrt(_read(spark, sf_dir, "events").count()) / 12))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tracer, event_id, ratio, lat, lon): events as points of the sphere; exact arithmetic, inside both ranges."""
    e = F.col("event_id")
    return _read(spark, sf_dir, "events").select(
        F.col("event_type").alias("tracer"), "event_id", "ts", (F.col("value") / (F.col("value") + 50)).alias("ratio"),
        (F.lit(90.0) - F.lit(180.0) * (e * 7919 % 10007 + 0.5) / 10007).alias("lat"), (F.lit(360.0) * (e * 104729 % 10009 + 0.5) / 10009).alias("lon"),
    )


def event_field(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(tracer, cell_id, i, j, q) of all cells, written once: every stencil reads it several times."""
    means = R.cell_means(observations(spark, sf_dir), n, F.col("ratio"))
    return Scratch(spark).table(R.full_field(spark, Scratch(spark).table(means, "means"), n), "field")


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names})


def time_step(n: int) -> float:
    """Seconds: 20 minutes at n = 80, in proportion elsewhere."""
    return 96000.0 / n


def first_winds(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """Corrected winds at the middle of the first step, written once."""
    u, v = T.corrected_winds(*T.analytic_winds(spark, n, fields.wind("deformation"), time_step(n) / 2), n)
    scratch = Scratch(spark)
    return scratch.table(u, "u"), scratch.table(v, "v")


# Grid


def grid_cells(spark, sf_dir):
    return rounded(grid.cells(spark, grid_size(spark, sf_dir)), "dlon", "lat", "lon", "area")


def prefix_counts(spark, sf_dir):
    n = grid_size(spark, sf_dir)
    rows = grid.latitude_rows(spark, n).withColumn("interfaces_above", G.interfaces_above(F.col("i"), n))
    return rounded(rows, "dlon", "lat")


def cell_area_closure(spark, sf_dir):
    n = grid_size(spark, sf_dir)
    i = F.col("i")
    return rounded(grid.cells(spark, n).agg(F.count("*").alias("cells"), F.sum(G.cell_area_steradian(i, n)).alias("steradian"), F.sum("area").alias("square_degrees"), F.sum(G.cell_area_midpoint(i, n)).alias("midpoint")), "steradian", "square_degrees", "midpoint", digits=6)


def cell_corners(spark, sf_dir):
    n = grid_size(spark, sf_dir)
    means = R.cell_means(observations(spark, sf_dir), n, F.col("ratio"))
    cells = grid.corners(grid.cells(spark, n), n).join(means, "cell_id").select("tracer", "cell_id", "q", "north", "south", "west", "east")
    return rounded(cells, "q", "north", "south", "west", "east")


def interfaces(spark, sf_dir):
    return rounded(grid.interfaces(spark, grid_size(spark, sf_dir)), "lat", "lon_mid", "length")


def zonal_faces(spark, sf_dir):
    return rounded(grid.zonal_faces(spark, grid_size(spark, sf_dir)), "lat", "lon")


def north_neighbours(spark, sf_dir):
    n = grid_size(spark, sf_dir)
    i, j = F.col("i"), F.col("j")
    low, high = G.north_bounds(i, j, n)
    return grid.cells(spark, n).filter("i > 1").select("cell_id", G.cell_id(i - 1, low, n).alias("first_id"), G.cell_id(i - 1, high, n).alias("last_id"), (high - low + 1).alias("neighbours"))


def neighbour_reflexivity(spark, sf_dir):
    """Pairs seen from the north and not from the south, and the other way round: none."""
    n = grid_size(spark, sf_dir)
    i, j = F.col("i"), F.col("j")
    down = grid.interfaces(spark, n).select("a_id", "b_id")
    up = grid.cells(spark, n).filter("i > 1").select(F.explode(F.sequence(*G.north_bounds(i, j, n))).alias("k"), "i", "cell_id").select(G.cell_id(F.col("i") - 1, F.col("k"), n).alias("a_id"), F.col("cell_id").alias("b_id"))
    both = down.select("a_id", "b_id", F.lit(1).alias("d"), F.lit(0).alias("u")).unionByName(up.select("a_id", "b_id", F.lit(0).alias("d"), F.lit(1).alias("u")))
    return both.groupBy("a_id", "b_id").agg(F.sum("d").alias("d"), F.sum("u").alias("u")).agg(F.count("*").alias("pairs"), F.count_if(F.col("d") != F.col("u")).alias("one_sided"))


def isolated_cells(spark, sf_dir):
    n = grid_size(spark, sf_dir)
    k = grid.interfaces(spark, n)
    ends = k.select(F.explode(F.array("a_id", "b_id")).alias("cell_id"))
    return grid.cells(spark, n).join(ends, "cell_id", "left_anti").agg(F.count("*").alias("isolated"))


def adjacency_degree(spark, sf_dir):
    k = grid.edges(spark, grid_size(spark, sf_dir))
    each = k.select(F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("far")), F.struct(F.col("b").alias("own"), F.col("a").alias("far")))).alias("e"))
    return each.groupBy("e.own").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("cells"))


def sector_cells(spark, sf_dir):
    n = grid_size(spark, sf_dir)
    i, j = F.col("i"), F.col("j")
    return grid.cells(spark, n).select("cell_id", G.sector(i, j, n).alias("sector"), G.sector_column(i, j, n).alias("column"), G.is_middle(i, j, n).alias("middle"))


def sector_replicate(spark, sf_dir):
    n = grid_size(spark, sf_dir)
    one = grid.cells(spark, n).filter(G.sector(F.col("i"), F.col("j"), n) == 0).select("i", "j")
    return P.replicated(one, n).select(G.cell_id(F.col("i"), F.col("j"), n).alias("cell_id"), "sector")


# Points and fields


def bin_events(spark, sf_dir):
    return R.bin_points(observations(spark, sf_dir), grid_size(spark, sf_dir)).select("event_id", "i", "j", "cell_id")


def tracer_mass(spark, sf_dir):
    n = grid_size(spark, sf_dir)
    means = R.bin_points(observations(spark, sf_dir), n).groupBy("tracer", "cell_id", "i").agg(F.round(F.avg("ratio"), 9).alias("q"))
    return rounded(D.mass(means, n), "mass", digits=6)


def mass_by_row(spark, sf_dir):
    n = grid_size(spark, sf_dir)
    means = R.bin_points(observations(spark, sf_dir), n).groupBy("tracer", "cell_id", "i").agg(F.round(F.avg("ratio"), 9).alias("q"))
    return rounded(D.mass(means, n, "i"), "mass", digits=6)


def equator_band(spark, sf_dir):
    """The northern row next to the equator: 0 < lat < dlat."""
    n = grid_size(spark, sf_dir)
    lat = G.row_latitude(F.col("i"), n)
    return event_field(spark, sf_dir, n).filter((lat > 0) & (lat < G.dlat(n))).select("tracer", "j", "q")


def peak_ratio(spark, sf_dir):
    n = grid_size(spark, sf_dir)
    return D.peak(R.cell_means(observations(spark, sf_dir), n, F.col("ratio")))


def _around(kind):
    def query(spark, sf_dir):
        n = grid_size(spark, sf_dir)
        field = event_field(spark, sf_dir, n)
        if kind == "slope":
            return rounded(T.zonal_slopes(field).select("tracer", "cell_id", "slope"), "slope", digits=10)
        if kind == "gradient":
            return rounded(T.zonal_gradients(field, n).select("tracer", "cell_id", "gradient"), "gradient")
        return rounded(T.meridional_slopes(field, n).select("tracer", "cell_id", "slope"), "slope", digits=10)

    return query


def limiter_cases(spark, sf_dir):
    """The limiter on three consecutive values of each user's events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    each = _read(spark, sf_dir, "events").select("event_id", "value", F.lag("value").over(w).alias("a"), F.lead("value").over(w).alias("b")).filter("a is not null and b is not null")
    return rounded(each.select("event_id", T.limited_slope(F.col("a"), F.col("value"), F.col("b")).alias("slope")), "slope")


def _stepped(part, limited=True):
    def query(spark, sf_dir):
        n = grid_size(spark, sf_dir)
        u, v = first_winds(spark, n)
        out = T.step(event_field(spark, sf_dir, n), u, v, n, time_step(n), part, limited, Scratch(spark).table)
        return rounded(rounded(out.select("tracer", "cell_id", "q", "mass"), "mass", digits=7), "q", digits=10)

    return query


def size_check(spark, sf_dir):
    """Rows of each tracer's field, of faces and interfaces, against the closed forms."""
    n = grid_size(spark, sf_dir)
    t = grid.totals(n)
    counts = event_field(spark, sf_dir, n).groupBy(F.col("tracer").alias("name")).agg(F.count("*").alias("found")).withColumn("expected", F.lit(t["cells"]).cast("long"))
    for name, table, key in (("zonal faces", grid.zonal_faces(spark, n), "zonal_faces"), ("interfaces", grid.interfaces(spark, n), "interfaces")):
        counts = counts.unionByName(table.agg(F.count("*").alias("found")).select(F.lit(name).alias("name"), "found", F.lit(t[key]).cast("long").alias("expected")))
    return counts.withColumn("complete", F.col("found") == F.col("expected"))


def cell_predicates(spark, sf_dir):
    """Poles, rows next to the equator, and how many cells lie below each row's cells."""
    n = grid_size(spark, sf_dir)
    i, j = F.col("i"), F.col("j")
    low, high = G.south_bounds(i, j, n)
    return grid.cells(spark, n).select("cell_id", (i == 1).alias("north_pole"), (i == 2 * n).alias("south_pole"), (i == n).alias("above_equator"), (i == n + 1).alias("below_equator"), F.when(i < 2 * n, high - low + 1).otherwise(F.lit(0)).cast("long").alias("below"))


def point_lookup(spark, sf_dir):
    """The field's value at each event: its cell is computed, then joined on the cell."""
    n = grid_size(spark, sf_dir)
    placed = R.bin_points(observations(spark, sf_dir), n).select("event_id", "tracer", "cell_id")
    return placed.join(event_field(spark, sf_dir, n).select("tracer", "cell_id", "q"), ["tracer", "cell_id"]).select("event_id", "cell_id", "q")


def scatter_pairs(spark, sf_dir):
    """Two tracers of each cell side by side, labelled by which two: the points of a mixing diagram."""
    n = grid_size(spark, sf_dir)
    means = Scratch(spark).table(R.cell_means(observations(spark, sf_dir), n, F.col("ratio")), "means")
    out = None
    for a, b in (("click", "view"), ("signup", "purchase")):
        x, y = (means.filter(F.col("tracer") == t).select("cell_id", F.col("q").alias(c)) for t, c in ((a, "x"), (b, "y")))
        pair = x.join(y, "cell_id").select(F.lit(f"{a}/{b}").alias("pair"), "cell_id", "x", "y")
        out = pair if out is None else out.unionByName(pair)
    return out


def spiral_points(spark, sf_dir):
    """A Fibonacci spiral with a point for each event."""
    return rounded(grid.spiral(spark, _read(spark, sf_dir, "events").count()), "x", "y", digits=5)


def grid_models(spark, sf_dir):
    """Cells of other grids whose cells are as wide at the equator as a grid for the events of each user and kind, a cell for 24."""
    sizes = _read(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("tracer")).agg(F.count("*").alias("events"))
    width = F.lit(120.0) / (2 * F.ceil(F.sqrt("events") / 12) - 1)
    return rounded(sizes.select("user_id", "tracer", *(c.cast("double").alias(k) for k, c in G.cell_count_models(width).items())), "reduced", "regular", "cubed", "mapped_sphere", "spectral_element", digits=4)


# Winds


def wind_symmetry(spark, sf_dir):
    """The largest departure of the first winds from mirror symmetry: v is even, and u less the mean stream is odd."""
    n = grid_size(spark, sf_dir)
    u, v = T.analytic_winds(spark, n, fields.wind("deformation"), time_step(n) / 2)
    mean = F.lit(2 * fields.PI / fields.PERIOD * 180 / fields.PI) * F.cos(F.radians(G.row_latitude(F.col("i"), n)))
    ring = u.select(F.lit("u").alias("kind"), F.least("i", 2 * n + 1 - F.col("i")).alias("row"), F.round("j").alias("at"), (F.col("u") - mean).alias("x"))
    line = v.select(F.lit("v").alias("kind"), F.least("i", 2 * n - F.col("i")).alias("row"), F.round(F.col("lon_mid") * 1e6).cast("long").alias("at"), F.when(F.col("i") == n, 0.0).otherwise(F.when(F.col("i") < n, F.col("v")).otherwise(-F.col("v"))).alias("x"))
    pairs = ring.unionByName(line).groupBy("kind", "row", "at").agg(F.abs(F.sum("x")).alias("d"), F.count("*").alias("k"))
    return pairs.groupBy("kind").agg(F.sum("k").alias("winds"), F.count_if(F.col("d") > 1e-12).alias("asymmetric"))


def _winds(name):
    def query(spark, sf_dir):
        n = grid_size(spark, sf_dir)
        u, v = T.analytic_winds(spark, n, fields.wind(name), time_step(n) / 2)
        both = u.select(F.lit("u").alias("kind"), "cell_id", F.lit(0).cast("long").alias("other_id"), F.col("u").alias("wind")).unionByName(v.select(F.lit("v").alias("kind"), F.col("a_id").alias("cell_id"), F.col("b_id").alias("other_id"), F.col("v").alias("wind")))
        return both.withColumn("wind", F.round(F.col("wind") * 1e6, 6) + F.lit(0.0))

    return query


def wind_row_divergence(spark, sf_dir):
    n = grid_size(spark, sf_dir)
    _, v = T.analytic_winds(spark, n, fields.wind("deformation"), time_step(n) / 2)
    return rounded(T.row_divergence(v.withColumn("v", -F.col("v"))), "divergence")


def wind_corrected(spark, sf_dir):
    u, _ = first_winds(spark, grid_size(spark, sf_dir))
    return u.select("cell_id", (F.round(F.col("u") * 1e3, 7) + F.lit(0.0)).alias("u"))


def divergence_violations(spark, sf_dir):
    n = grid_size(spark, sf_dir)
    return T.divergence(*first_winds(spark, n), n).agg(F.count("*").alias("cells"), F.count_if(F.abs("residual") > 1e-13).alias("violations"))


def centre_winds(spark, sf_dir):
    n = grid_size(spark, sf_dir)
    out = T.centre_winds(*first_winds(spark, n))
    return out.select("cell_id", (F.round(F.col("u") * 1e3, 7) + F.lit(0.0)).alias("u"), (F.round(F.col("v") * 1e3, 7) + F.lit(0.0)).alias("v"))


def cfl(spark, sf_dir):
    n = grid_size(spark, sf_dir)
    return rounded(T.courant_number(*first_winds(spark, n), n, time_step(n)), "courant", digits=7)


def timestep_from_cfl(spark, sf_dir):
    n = grid_size(spark, sf_dir)
    return rounded(T.largest_step(*first_winds(spark, n), n, 0.95), "dt", digits=4)


def wind_interp_time(spark, sf_dir):
    """Daily mean values of each event type, read as winds at the times of all events: between the days before and after."""
    events = _read(spark, sf_dir, "events")
    t = F.unix_timestamp("ts")
    winds = events.groupBy((F.floor(t / 86400) * 86400).alias("ts"), F.col("event_type").alias("key")).agg(F.round(F.avg("value"), 6).alias("value"))
    return rounded(T.interpolated_winds(winds, events.select(t.alias("t")).distinct(), 86400), "value", digits=6)


# Analytic cases


def _case(name):
    def query(spark, sf_dir):
        """The case at the places of all events."""
        at = observations(spark, sf_dir).select("event_id", fields.case(name)(F.col("lat"), F.col("lon")).cast("double").alias("q"))
        return rounded(at, "q")

    return query


def snail_exact(spark, sf_dir):
    return rounded(observations(spark, sf_dir).select("event_id", fields.snail_ratio(F.col("lat"), F.col("lon"), 86400.0).alias("q")), "q", digits=6)


def great_circles(spark, sf_dir):
    """How many events of each kind lie within so many tens of degrees of the first centre."""
    far = F.degrees(G.great_circle(F.col("lat"), F.col("lon"), F.lit(0.0), F.lit(150.0)))
    return observations(spark, sf_dir).groupBy("tracer", F.floor(far / 10).alias("ring")).agg(F.count("*").alias("events"))


def rotated_points(spark, sf_dir):
    lat, lon = G.rotated(F.col("lat"), F.col("lon"), 30.0, 60.0)
    x, y, near = G.orthographic(F.col("lat"), F.col("lon"), 45.0, 90.0)
    return rounded(observations(spark, sf_dir).select("event_id", lat.alias("lat"), lon.alias("lon"), x.alias("x"), y.alias("y"), near.alias("near")), "lat", "lon", "x", "y", digits=6)


# Diagnostics


def _two_runs(spark, sf_dir) -> tuple[DataFrame, int]:
    """The tracers ``click`` and ``view`` as the first and last field of one run."""
    n = grid_size(spark, sf_dir)
    field = event_field(spark, sf_dir, n)
    first = field.filter("tracer = 'click'").withColumn("tracer", F.lit("run"))
    return D.paired(first, field.filter("tracer = 'view'").withColumn("tracer", F.lit("run"))), n


def error_norms(spark, sf_dir):
    pairs, n = _two_runs(spark, sf_dir)
    return rounded(D.error_norms(pairs, G.cell_area_steradian(F.col("i"), n)), "l2", "l_inf", "quadratic")


def legacy_norms(spark, sf_dir):
    pairs, n = _two_runs(spark, sf_dir)
    return rounded(D.error_norms(pairs, G.cell_area_midpoint(F.col("i"), n) / (4 * F.pi())), "l2", "l_inf", "quadratic")


def filaments(spark, sf_dir):
    pairs, n = _two_runs(spark, sf_dir)
    return rounded(D.filaments(pairs, G.cell_area_steradian(F.col("i"), n)), "threshold", "preserved", digits=6)


def mixing(spark, sf_dir):
    n = grid_size(spark, sf_dir)
    field = event_field(spark, sf_dir, n).select("tracer", "i", F.col("q").alias("q0"), F.round(fields.correlated(F.col("q")) + 0.05 * F.sin(F.col("cell_id")), 9).alias("q"))
    return rounded(D.mixing(field, G.cell_area_steradian(F.col("i"), n)), "real_mixing", "unmixing", "overshooting", digits=7)


def bounds(spark, sf_dir):
    """Bounds of the mean values on a scale that some leave; cells without an event are not set."""
    n = grid_size(spark, sf_dir)
    means = R.cell_means(observations(spark, sf_dir).join(_read(spark, sf_dir, "events").select("event_id", "value"), "event_id"), n, F.col("value") / 100 - 0.05)
    return D.bounds(R.full_field(spark, Scratch(spark).table(means, "means"), n, None), n)


def symmetry(spark, sf_dir):
    n = grid_size(spark, sf_dir)
    return rounded(D.asymmetry(event_field(spark, sf_dir, n), n), "asymmetry")


def run_compare(spark, sf_dir):
    """The filled field against the observed cells, with six digits."""
    n = grid_size(spark, sf_dir)
    means = R.cell_means(observations(spark, sf_dir), n, F.col("ratio"))
    return rounded(D.compare_runs(event_field(spark, sf_dir, n), means.withColumn("q", F.round("q", 6))), "largest")


def convergence_fit(spark, sf_dir):
    """Spread of the events' values over the width of their bins: the fit's points come from grids of several sizes."""
    n = grid_size(spark, sf_dir)
    each = observations(spark, sf_dir).withColumn("m", F.explode(F.array(*(F.lit(k) for k in (1, 2, 4)))))
    lat = F.floor((90 - F.col("lat")) / (F.lit(90.0 / n) * F.col("m")))
    points = each.groupBy("tracer", "m", lat.alias("band")).agg(F.round(F.avg("ratio"), 9).alias("q")).groupBy("tracer", "m").agg(F.stddev_samp("q").alias("error"))
    points = points.withColumn("resolution", F.lit(90.0 / n) * F.col("m"))
    return rounded(D.convergence(points, "resolution", "error", "tracer"), "slope", "intercept", "mse", digits=6)


def timing_stats(spark, sf_dir):
    items = _read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 8 + 1).alias("procs"), (F.col("l_orderkey") % (F.col("l_suppkey") % 8 + 1)).alias("proc"), F.col("l_quantity").cast("double").alias("seconds"))
    per = items.groupBy("procs", "proc").agg(F.sum("seconds").alias("seconds"))
    return rounded(D.timing_stats(per), "slowest", "fastest", "mean", "speedup", digits=6)


# Partitions and remapping


def partition_ids(spark, sf_dir):
    n = grid_size(spark, sf_dir)
    return grid.cells(spark, n).select("cell_id", P.part_id(F.col("i"), F.col("j"), n, PARTS).alias("part"))


def partition_adjacency(spark, sf_dir):
    return P.adjacency(spark, grid_size(spark, sf_dir), PARTS)


def halo_counts(spark, sf_dir):
    return P.halo_counts(spark, grid_size(spark, sf_dir), PARTS)


def edge_cut(spark, sf_dir):
    return P.edge_cut(spark, grid_size(spark, sf_dir), PARTS)


def remap_frac(spark, sf_dir):
    n = grid_size(spark, sf_dir)
    return rounded(R.remap(event_field(spark, sf_dir, n), R.overlap_links(spark, n), "frac"), "q")


def _remap_partial(normalise):
    def query(spark, sf_dir):
        """From the cells that have an event onto a grid twice as fine: destinations that are covered in part."""
        n = grid_size(spark, sf_dir)
        seen = Scratch(spark).table(R.bin_points(observations(spark, sf_dir), n).select(F.col("cell_id").alias("src")).filter("src % 3 <> 0").distinct(), "seen")
        shares = R.overlap_links(spark, n).join(seen, "src").join(grid.cells(spark, 2 * n).select(F.col("cell_id").alias("dst"), "area"), "dst")
        return rounded(R.remap(event_field(spark, sf_dir, n), R.weighted_links(shares, F.col("area"), normalise), normalise), "q")

    return query


def isentrope(spark, sf_dir):
    """Lines of an order as levels of a column: pressure from the line number, temperature and wind from its amounts."""
    k = F.col("l_linenumber")
    levels = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", k).agg(F.max("l_quantity").cast("double").alias("u"))
    levels = levels.select("l_orderkey", (1050.0 - 100.0 * k).alias("pressure"), (280.0 + F.col("u") / 10).alias("temperature"), "u")
    return rounded(R.on_isentrope(levels, 300.0, ("u", "temperature"), ("l_orderkey",)), "u", "temperature", digits=6)


# Time


def run_times(spark, sf_dir):
    """Twelve-digit times of the events and back, and the step of a run since January that each falls in."""
    ts = F.col("ts")
    stamp = clock.stamp(ts)
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return _read(spark, sf_dir, "events").select("event_id", stamp.alias("stamp"), clock.steps_between(start, ts, 1200).alias("step"), clock.unix_minutes(clock.parse_stamp(stamp)).alias("minutes"))


def emissions(spark, sf_dir):
    """Values by tumbling windows of the output period (six hours): what a run writes at the end of each."""
    w = F.window("ts", "6 hours")
    out = _read(spark, sf_dir, "events").groupBy(w, F.col("event_type").alias("tracer")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("tracer", F.unix_timestamp(F.col("window.end")).alias("emitted"), "events", F.round("total", 2).alias("total"))


def text_round_trip(spark, sf_dir):
    """The field as fixed-width text, read again and placed by its coordinates."""
    from zonalis.sources import text

    n = grid_size(spark, sf_dir)
    path = text.write_field(event_field(spark, sf_dir, n), n, Scratch(spark))
    return text.read_field(spark, path, n).select("tracer", "cell_id", "q")


def corner_round_trip(spark, sf_dir):
    """The observed cells as lines of a value and eight corner coordinates, read again."""
    from zonalis.sources import text

    n = grid_size(spark, sf_dir)
    cells = R.bin_points(observations(spark, sf_dir), n).groupBy("tracer", "i", "j").agg(F.round(F.avg("ratio"), 9).alias("q"))
    path = text.write_corners(cells, n, new_path(spark, "corners"))
    return rounded(text.read_corners(spark, path, n), "q", "north", "south", "west", "east")


def neighbour_means(spark, sf_dir):
    """The mean of the field over each cell's neighbours, which are read from a stored adjacency table."""
    from zonalis.sources import text

    n = grid_size(spark, sf_dir)
    near = text.read_graph(spark, text.write_graph(grid.edges(spark, n), new_path(spark, "graph")))
    far = near.select(F.col("cell_id").alias("own"), F.explode("near").alias("cell_id"))
    means = far.join(event_field(spark, sf_dir, n), "cell_id").groupBy("tracer", F.col("own").alias("cell_id")).agg(F.count("*").alias("neighbours"), F.avg("q").alias("q"))
    return rounded(means, "q", digits=12)


def interface_jumps(spark, sf_dir):
    """For each interface row the field's difference across it, as a mean weighted by length."""
    n = grid_size(spark, sf_dir)
    field = event_field(spark, sf_dir, n).select("tracer", "cell_id", "q")
    above, below = (field.select("tracer", F.col("cell_id").alias(f"{c}_id"), F.col("q").alias(c)) for c in "ab")
    jumps = grid.interfaces(spark, n).join(above, "a_id").join(below, ["tracer", "b_id"])
    return rounded(jumps.groupBy("tracer", "i").agg((F.sum(F.col("length") * F.abs(F.col("a") - F.col("b"))) / F.sum("length")).alias("jump")), "jump", digits=8)


def sector_totals(spark, sf_dir):
    """Mass of each tracer in the three sectors, and in the cells in the middle of them."""
    n = grid_size(spark, sf_dir)
    i, j = F.col("i"), F.col("j")
    each = event_field(spark, sf_dir, n).select("tracer", G.sector(i, j, n).alias("sector"), G.is_middle(i, j, n).alias("middle"), (G.cell_area(i, n) * F.col("q")).alias("m"))
    return rounded(each.groupBy("tracer", "sector").agg(F.sum("m").alias("mass"), F.sum(F.when(F.col("middle"), F.col("m")).otherwise(0.0)).alias("middle_mass")), "mass", "middle_mass", digits=6)


def stored_errors(spark, sf_dir):
    """Two stored runs, compared file by file: the daily means of each tracer, and the same to three digits, some of them moved.

    The second run's files have comments and blank lines.
    """
    from zonalis.sources import text

    n = grid_size(spark, sf_dir)
    stamp = clock.stamp(F.date_trunc("day", "ts"))
    daily = R.bin_points(observations(spark, sf_dir), n).groupBy("tracer", stamp.alias("stamp"), "i", "j").agg(F.round(F.avg("ratio"), 9).alias("value"))
    daily = daily.select("tracer", "stamp", "i", "j", "value", G.row_latitude(F.col("i"), n).alias("lat"), G.cell_longitude(F.col("i"), F.col("j"), n).alias("lon"))
    daily = Scratch(spark).table(daily, "daily")
    moved = daily.filter("(i + j) % 11 <> 0").withColumn("value", F.round("value", 3)).withColumn("lon", F.when(F.col("j") % 7 == 0, F.col("lon") + 1e-6).otherwise(F.col("lon")))
    keys, types = ("tracer", "stamp"), "tracer string, stamp long"
    one, two = new_path(spark, "run-1"), new_path(spark, "run-2")
    text.write_lines(daily.drop("i", "j"), one, *keys)
    text.write_lines(moved.drop("i", "j"), two, *keys)
    notes = moved.select(*keys).distinct().select(*keys, F.explode(F.array(F.concat(F.lit("# day "), F.col("stamp").cast("string")), F.lit("  "))).alias("value"))
    notes.write.mode("append").partitionBy(*keys).text(two)
    return rounded(D.stored_errors(text.read_lines(spark, one, types), text.read_lines(spark, two, types), n, *keys), "mse", digits=12)


def wind_files(spark, sf_dir):
    """Winds of the first two days, written at all faces, read for both times, at the hours of the first day's events.

    Zonal winds are the events' mean ratio of the row, meridional ones its difference to the row below.
    """
    from zonalis.sources import text

    n = grid_size(spark, sf_dir)
    day = F.floor(F.unix_timestamp("ts") / 86400)
    events = R.bin_points(observations(spark, sf_dir), n).select(day.alias("day"), "ts", "i", "ratio")
    first = events.agg(F.min("day")).first()[0]
    means = events.filter(F.col("day").isin(first, first + 1)).groupBy((F.col("day") * 86400).alias("stamp"), "i").agg(F.round(F.avg("ratio"), 9).alias("q"))
    days = means.select("stamp").distinct()
    rows = grid.latitude_rows(spark, n).select("i", F.explode(F.array(*(F.lit(int((first + k) * 86400)) for k in (0, 1)))).alias("stamp"))
    rows = Scratch(spark).table(rows.join(days, "stamp", "left_semi").join(means, ["i", "stamp"], "left").select("i", "stamp", F.coalesce("q", F.lit(0.0)).alias("q")), "rows")
    u = grid.zonal_faces(spark, n).join(rows, "i").select("stamp", "i", "f", F.col("q").alias("u"))
    below = rows.select("stamp", (F.col("i") - 1).alias("i"), F.col("q").alias("q_below"))
    v = grid.interfaces(spark, n).join(rows, "i").join(below, ["i", "stamp"]).select("stamp", "i", "j", "l", (F.col("q") - F.col("q_below")).alias("v"))
    read = text.read_winds(spark, text.write_winds(u, v, n, new_path(spark, "winds")), n)
    hours = events.filter(F.col("day") == first).select((F.floor(F.unix_timestamp("ts") / 3600) * 3600).alias("t")).distinct()
    at = T.interpolated_winds(read.select(F.col("stamp").alias("ts"), F.struct("kind", "cell_id", "other").alias("key"), "value"), hours, 86400)
    return rounded(at.select("t", "key.*", "value"), "value", digits=12)


def simulate_short(spark, sf_dir):
    """Three steps of the events' field; mass of each tracer before and after."""
    from zonalis.jobs.simulate import RunConfig, simulate

    n = grid_size(spark, sf_dir)
    field = event_field(spark, sf_dir, n)
    last = simulate(spark, field, RunConfig(n=n, dt=time_step(n), steps=3, wind="deformation"))
    first = D.mass(field, n).withColumnRenamed("mass", "mass0")
    return first.join(D.mass(last, n), "tracer")


QUERIES = {
    "grid_cells": grid_cells, "prefix_counts": prefix_counts, "cell_area_closure": cell_area_closure, "cell_corners": cell_corners, "interfaces": interfaces,
    "zonal_faces": zonal_faces, "north_neighbours": north_neighbours, "neighbour_reflexivity": neighbour_reflexivity, "isolated_cells": isolated_cells,
    "adjacency_degree": adjacency_degree, "sector_cells": sector_cells, "sector_replicate": sector_replicate,
    "bin_events": bin_events, "tracer_mass": tracer_mass, "mass_by_row": mass_by_row, "equator_band": equator_band, "peak_ratio": peak_ratio,
    "size_check": size_check, "cell_predicates": cell_predicates, "point_lookup": point_lookup, "scatter_pairs": scatter_pairs, "spiral_points": spiral_points,
    "grid_models": grid_models, "wind_symmetry": wind_symmetry,
    "zonal_slope": _around("slope"), "zonal_gradient": _around("gradient"), "merid_slope": _around("merid"), "limiter_cases": limiter_cases,
    "zonal_step": _stepped("zonal"), "merid_step": _stepped("meridional"), "full_step": _stepped("zonal-first"), "unlimited_step": _stepped("zonal-first", False),
    "alternate_step": _stepped("meridional-first"), "symmetric_step": _stepped("symmetric"),
    "winds_deformation": _winds("deformation"), "winds_divergent": _winds("divergent"), "winds_rotation": _winds("rotation"), "winds_snail": _winds("snail"),
    "wind_row_divergence": wind_row_divergence, "wind_corrected": wind_corrected, "divergence_violations": divergence_violations, "centre_winds": centre_winds,
    "cfl": cfl, "timestep_from_cfl": timestep_from_cfl, "wind_interp_time": wind_interp_time,
    **{f"case_{k}": _case(k) for k in ("gaussian", "cosine", "correlated", "slotted", "band", "wave")}, "snail_exact": snail_exact,
    "great_circles": great_circles, "rotated_points": rotated_points,
    "error_norms": error_norms, "legacy_norms": legacy_norms, "filaments": filaments, "mixing": mixing, "bounds": bounds, "symmetry": symmetry,
    "run_compare": run_compare, "convergence_fit": convergence_fit, "timing_stats": timing_stats,
    "partition_ids": partition_ids, "partition_adjacency": partition_adjacency, "halo_counts": halo_counts, "edge_cut": edge_cut, "remap_frac": remap_frac, "isentrope": isentrope,
    **{f"remap_partial_{k}": _remap_partial(k) for k in R.NORMALISED}, "neighbour_means": neighbour_means, "interface_jumps": interface_jumps, "sector_totals": sector_totals,
    "corner_round_trip": corner_round_trip, "stored_errors": stored_errors, "wind_files": wind_files,
    "run_times": run_times, "emissions": emissions, "text_round_trip": text_round_trip, "simulate_short": simulate_short,
}


def queries() -> dict:
    from zonalis.jobs import bound_queries, exchange_queries

    return QUERIES | exchange_queries.QUERIES | bound_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    from zonalis.jobs import bound_queries, exchange_queries
    from zonalis.jobs.oracle_queries import FINALS

    return {k: sql(q) for k, q in (FINALS | exchange_queries.FINALS | bound_queries.FINALS).items()}

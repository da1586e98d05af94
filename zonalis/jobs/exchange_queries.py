"""Registered queries of the operators that move fields between grids, files, times and tables, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonalis.functions import clock, spiral
from zonalis.functions import geometry as G
from zonalis.jobs import queries as Q
from zonalis.jobs.oracle import rnd, sql
from zonalis.jobs.oracle_queries import FINALS as _SQL
from zonalis.operators import diagnostics as D
from zonalis.operators import exact, graph, polygons, timeline
from zonalis.operators import overlap as O
from zonalis.operators import remap as R
from zonalis.sources import grid, sink, tables, text
from zonalis.sources.scratch import Scratch, new_path

# Remapping between unrelated grids


def _regular_cells(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """Cells of a regular grid that begins at 20 degrees west, in rows from the north."""
    k = F.col("id")
    r, c = F.floor(k / columns), k % columns
    north, west = F.lit(90.0) - r * F.lit(180.0 / rows), c * F.lit(360.0 / columns) - 20.0
    cells = spark.range(rows * columns).select((k + 1).alias("cell_id"), F.lit(1).alias("mask"), north.alias("north"), (north - F.lit(180.0 / rows)).alias("south"), west.alias("west"), (west + F.lit(360.0 / columns)).alias("east"))
    return cells.withColumns({"lat": (F.col("north") + F.col("south")) / 2, "lon": (F.col("west") + F.col("east")) / 2})


def _grid_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The field, and both grids as read from files: this one, masked where no event is, and a regular one of 3n - 1 rows."""
    n = Q.grid_size(spark, sf_dir)
    seen = R.bin_points(Q.observations(spark, sf_dir), n).select("cell_id", F.lit(1).alias("mask")).distinct()
    cells = grid.corners(grid.cells(spark, n), n).join(seen, "cell_id", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    here = text.write_grid(cells, new_path(spark, "grid"))
    there = text.write_grid(_regular_cells(spark, 3 * n - 1, 5 * n + 2), new_path(spark, "grid"))
    return Q.event_field(spark, sf_dir, n), text.read_grid(spark, here), text.read_grid(spark, there)


def remap_unrelated(spark, sf_dir):
    """The field on a regular grid, from the cells that an event is in; ``covered`` is the share of a cell that those cover."""
    field, here, there = _grid_files(spark, sf_dir)
    shares = Scratch(spark).table(O.conservative_links(here, there), "links")
    links = R.weighted_links(shares, F.col("dst_area"), "frac")
    covered = shares.groupBy(F.col("dst").alias("cell_id")).agg(F.sum("w").alias("covered"))
    return Q.rounded(R.remap(field, links, "frac").join(covered, "cell_id").select("tracer", "cell_id", "q", "covered"), "q", "covered", digits=11)


def remap_mass(spark, sf_dir):
    """Mass of each tracer before and after it was remapped onto the regular grid, and whether it is the same to 1e-12."""
    field, here, there = _grid_files(spark, sf_dir)
    shares = Scratch(spark).table(O.conservative_links(here, there), "links")
    area = O.spherical_area(F.col("north"), F.col("south"), F.col("east") - F.col("west"))
    before = field.join(here.filter("mask <> 0").select("cell_id", area.alias("area")), "cell_id").groupBy("tracer").agg(F.sum(F.col("q") * F.col("area")).alias("before"))
    moved = R.remap(field, R.weighted_links(shares, F.col("dst_area"), "frac"), "frac")
    cover = shares.groupBy(F.col("dst").alias("cell_id")).agg(F.sum(F.col("w") * F.col("dst_area")).alias("area"))
    after = moved.join(cover, "cell_id").groupBy("tracer").agg(F.sum(F.col("q") * F.col("area")).alias("after"))
    both = before.join(after, "tracer").withColumn("kept", F.abs(F.col("after") - F.col("before")) <= 1e-12 * F.col("before"))
    return Q.rounded(both.select("tracer", "before", "after", "kept"), "before", "after", digits=6)


_OVERLAPS = """WITH reg AS (SELECT r * (5 * n + 2) + c + 1 AS dst, 90::DOUBLE - r * (180::DOUBLE / (3 * n - 1)) AS dnorth, 90::DOUBLE - (r + 1) * (180::DOUBLE / (3 * n - 1)) AS dsouth,
    c * (360::DOUBLE / (5 * n + 2)) - 20 AS dwest, (c + 1) * (360::DOUBLE / (5 * n + 2)) - 20 AS deast FROM (SELECT n, r, unnest(range(0, 5 * n + 2)) AS c FROM (SELECT n, unnest(range(0, 3 * n - 1)) AS r FROM p))),
  turned AS (SELECT *, 0 AS turn FROM reg UNION ALL SELECT * REPLACE (dwest + 360 AS dwest, deast + 360 AS deast), 1 FROM reg WHERE dwest < 0),
  ovl AS (SELECT c.cell_id AS src, d.dst, sum((least(c.j * c.dlon, d.deast) - greatest((c.j - 1) * c.dlon, d.dwest)) * (sin(radians(least(c.north, d.dnorth))) - sin(radians(greatest(c.south, d.dsouth)))) * 180 / pi()) AS area
    FROM cells c JOIN turned d ON c.north > d.dsouth + 1e-11 AND c.south < d.dnorth - 1e-11 AND (c.j - 1) * c.dlon < d.deast - 1e-11 AND c.j * c.dlon > d.dwest + 1e-11 WHERE c.cell_id IN (SELECT cell_id FROM binned) GROUP BY ALL),
  dsts AS (SELECT dst, any_value((deast - dwest) * (sin(radians(dnorth)) - sin(radians(dsouth))) * 180 / pi()) AS dst_area FROM reg GROUP BY dst),
  cover AS (SELECT dst, sum(area) AS area FROM ovl GROUP BY dst)
"""

# Files under resolved names


def _weekly(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """(tracer number, stamp, cell_id, i, j, q) of all cells, the mean ratio of each week; and (tracer, number)."""
    n = Q.grid_size(spark, sf_dir)
    stamp = clock.stamp(F.date_trunc("week", "ts"))
    means = R.bin_points(Q.observations(spark, sf_dir), n).groupBy("tracer", stamp.alias("stamp"), "cell_id").agg(F.round(F.avg("ratio"), 9).alias("q"))
    means = Scratch(spark).table(means, "means")
    known = means.agg(F.sort_array(F.collect_set("tracer")).alias("all"))
    number = F.array_position("all", F.col("tracer")).alias("number")
    each = means.select("tracer", "stamp").distinct().join(F.broadcast(known)).select("tracer", "stamp", number)
    rows = each.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(2 * n).cast("long"))))
    cells = rows.withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), G.nlon(F.col("i"), n)))).withColumn("cell_id", G.cell_id(F.col("i"), F.col("j"), n))
    field = cells.join(means, ["tracer", "stamp", "cell_id"], "left")
    return field.select(F.col("number").alias("tracer"), "stamp", "cell_id", "i", "j", "q"), n


def _ratio_lines(field: DataFrame, lat, lon) -> DataFrame:
    return sink.stored_lines(field.select("tracer", "stamp", (F.col("cell_id") - 1).alias("place"), F.col("q").alias("value"), lat.alias("lat"), lon.alias("lon")), "ratio")


def stored_fields(spark, sf_dir):
    """Weekly means of each tracer, written as ``ratio_<k>_<stamp>.dat``, and what is read of all files by coordinates."""
    field, n = _weekly(spark, sf_dir)
    i, j = F.col("i"), F.col("j")
    base = sink.write_named(_ratio_lines(field, G.row_latitude(i, n), G.cell_longitude(i, j, n)), new_path(spark, "stored"))
    read = text.read_stored(spark, base, "ratio").withColumn("i", G.point_row(F.col("lat"), n))
    read = read.withColumn("cell_id", G.cell_id(F.col("i"), G.point_column(F.col("i"), F.col("lon"), n), n))
    return read.select(F.col("tracer").cast("long").alias("tracer"), "stamp", "cell_id", F.nullif("value", F.lit(D.UNDEFINED)).alias("q"))


def positional_fields(spark, sf_dir):
    """The same, written with the coordinates of other places and in parts of 100 lines: cells are told by the place in the file."""
    field, n = _weekly(spark, sf_dir)
    base = sink.write_named(_ratio_lines(field, F.col("cell_id") % 90 * F.lit(1.0), F.lit(7.0)), new_path(spark, "stored"), lines_per_file=100)
    read = text.scan_positions(spark, base, "ratio", n)
    return read.select(F.col("tracer").cast("long").alias("tracer"), "stamp", G.cell_id(F.col("i"), F.col("j"), n).alias("cell_id"), F.col("value").alias("q"))


def file_order(spark, sf_dir):
    """Of each file the lines, the places in it whose line has the coordinates of another cell, and a sum of place times value."""
    field, n = _weekly(spark, sf_dir)
    i, j = F.col("i"), F.col("j")
    base = sink.write_named(_ratio_lines(field, G.row_latitude(i, n), G.cell_longitude(i, j, n)), new_path(spark, "stored"))
    lines = spark.read.text(text.data_path(base, "ratio")).withColumn("name", F.regexp_extract(F.col("_metadata.file_path"), r"/(ratio_[^/]*\.dat)", 1))
    read = text.numbers(text.line_numbers(lines)).withColumn("i", G.point_row(F.col("lat"), n))
    cell = G.cell_id(F.col("i"), G.point_column(F.col("i"), F.col("lon"), n), n)
    known = F.when(F.col("value") != D.UNDEFINED, F.col("value")).otherwise(0.0)
    return Q.rounded(read.groupBy("name").agg(F.count("*").alias("lines"), F.count_if(cell != F.col("line") + 1).alias("misplaced"), F.sum(F.col("line") * known).alias("moment")), "moment", digits=5)


def positional_winds(spark, sf_dir):
    """Winds of the field's first tracers at all faces and interfaces, written as ``u_<stamp>.dat`` and ``v_<stamp>.dat`` and read by place.

    The zonal wind of a face is the ratio of clicks of the cell west of it (east of the first); the meridional one of an interface is the difference of views.
    """
    n = Q.grid_size(spark, sf_dir)
    field = Q.event_field(spark, sf_dir, n)
    i, f = F.col("i"), F.col("f")
    stamp = F.lit(202401010000).cast("long").alias("stamp")
    click = field.filter("tracer = 'click'").select("i", F.col("j").alias("f"), "q")
    faces = grid.zonal_faces(spark, n).withColumn("at", F.greatest(f, F.lit(1)))
    u = faces.join(click.withColumnRenamed("f", "at"), ["i", "at"]).select(stamp, (G.cells_above(i, n) + i - 1 + f).alias("place"), F.col("q").alias("value"), "lat", "lon")
    view = field.filter("tracer = 'view'")
    above, below = (view.select(F.col("cell_id").alias(f"{c}_id"), F.col("q").alias(c)) for c in "ab")
    order = Window.partitionBy("i").orderBy("lon_mid")
    v = grid.interfaces(spark, n).withColumn("place", G.interfaces_above(i, n) + F.row_number().over(order) - 1).join(above, "a_id").join(below, "b_id")
    v = v.select(stamp, F.col("place").cast("long").alias("place"), F.round(F.col("a") - F.col("b"), 9).alias("value"), "lat", F.col("lon_mid").alias("lon"))
    base = sink.write_named(sink.stored_lines(u, "u").unionByName(sink.stored_lines(v, "v")), new_path(spark, "stored"), lines_per_file=1000)
    read = [text.scan_positions(spark, base, k, n).select(F.lit(k).alias("kind"), "stamp", "i", "j", "l", "value") for k in "uv"]
    return read[0].unionByName(read[1])


# Times and sums


def _asof(kind: str, keys: tuple[str, ...]):
    def query(spark, sf_dir):
        """Values at the times of all events, on the lines between the values of events of one kind, which come at uneven times."""
        events = Q._read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
        marks = events.filter(F.col("event_type") == kind).select(*keys, "t", "value")
        at = timeline.bracketed(events.select("event_id", *keys, "t"), marks, keys)
        value = timeline.interpolated(*(F.col(c) for c in ("t", "t0", "v0", "t1", "v1")))
        return Q.rounded(at.select("event_id", "t0", "t1", value.alias("value")), "value", digits=8)

    return query


def exact_ratios(spark, sf_dir):
    """Exact sums of the ratios of each kind, in units of 2^-66: all digits of them."""
    points = Q.observations(spark, sf_dir)
    return exact.exact_units(points, ("tracer",), "ratio", -66)


def exact_mass(spark, sf_dir):
    """Mass of each tracer by exact sums, and whether the cells dealt out anew give the same to the last bit."""
    n = Q.grid_size(spark, sf_dir)
    field = Q.event_field(spark, sf_dir, n).select("tracer", "cell_id", (G.cell_area(F.col("i"), n) * F.col("q")).alias("m"))
    one = exact.exact_sum(field, ("tracer",), "m", "mass")
    two = exact.exact_sum(field.repartition(7, "cell_id").sortWithinPartitions(F.xxhash64("cell_id")), ("tracer",), "m", "again")
    return Q.rounded(one.join(two, "tracer").select("tracer", (F.col("mass") == F.col("again")).alias("same"), "mass"), "mass", digits=8)


# Stored tables, the spiral, graphs


def error_log(spark, sf_dir):
    """Errors of stored files in a table with keys: first those of some days, then of all, then of all again.

    ``version`` is the run that a row came with; ``stored`` is how many rows all three runs have written.
    """
    keys = ("tracer", "stamp")
    rows = Scratch(spark).table(Q.stored_errors(spark, sf_dir), "errors")
    path = new_path(spark, "errors")
    for part in (rows.filter(F.floor(F.col("stamp") / 10000) % 3 > 0), rows, rows):
        tables.append_changed(spark, path, part, keys)
    stored = spark.read.parquet(path).groupBy("tracer").agg(F.count("*").alias("stored"))
    return tables.current(spark, path, keys).join(stored, "tracer")


def spiral_nearest(spark, sf_dir):
    """Events and their mean ratio by the nearest point of a spiral on the disc that has a point for 24 events."""
    points = max(12, Q._read(spark, sf_dir, "events").count() // 24)
    r, angle = F.sqrt(F.lit(points) * (90 - F.col("lat")) / 180), F.radians("lon")
    placed = Q.observations(spark, sf_dir).select("ratio", (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"))
    near = placed.select("ratio", spiral.nearest_on_spiral(F.col("x"), F.col("y"), points).alias("k"))
    return Q.rounded(near.groupBy("k").agg(F.count("*").alias("events"), F.avg("ratio").alias("ratio")), "ratio")


def _graph_file(spark: SparkSession, edges: DataFrame) -> DataFrame:
    return text.read_graph(spark, text.write_graph(edges, new_path(spark, "graph")))


def damaged_graph(spark, sf_dir):
    """The stored adjacency after each error event has struck one entry off its cell's list: what is left, what stands on one side only, and whether nothing names the cell."""
    n = Q.grid_size(spark, sf_dir)
    whole = _graph_file(spark, grid.edges(spark, n))
    strikes = R.bin_points(Q.observations(spark, sf_dir).filter("tracer = 'error'"), n).join(whole, "cell_id")
    struck = strikes.select(F.col("cell_id").alias("a"), F.get("near", (F.col("event_id") % F.size("near")).cast("int")).alias("b")).distinct()
    left = Scratch(spark).table(graph.entries(whole).join(struck, ["a", "b"], "left_anti"), "left")
    lonely = graph.isolated(whole, left).withColumn("isolated", F.lit(True))
    counts = left.groupBy(F.col("a").alias("cell_id")).agg(F.count("*").alias("neighbours"))
    single = graph.one_sided(left).groupBy(F.col("a").alias("cell_id")).agg(F.count("*").alias("one_sided"))
    zero = F.lit(0).cast("long")
    out = whole.select("cell_id").join(counts, "cell_id", "left").join(single, "cell_id", "left").join(lonely, "cell_id", "left")
    return out.select("cell_id", F.coalesce("neighbours", zero).alias("neighbours"), F.coalesce("one_sided", zero).alias("one_sided"), F.coalesce("isolated", F.lit(False)).alias("isolated"))


def observed_parts(spark, sf_dir):
    """Cells with seven clicks or more, and the connected part of such cells that each lies in, by the stored adjacency."""
    n = Q.grid_size(spark, sf_dir)
    clicks = R.bin_points(Q.observations(spark, sf_dir).filter("tracer = 'click'"), n).groupBy("cell_id").agg(F.count("*").alias("clicks")).filter("clicks >= 7")
    return graph.connected_parts(clicks, graph.entries(_graph_file(spark, grid.edges(spark, n))))


# Projections and vectors

#: Where the registered query looks at the sphere from: no corner of a cell lies on its horizon.
VIEW = (40.1, 12.3)


def clipped_cells(spark, sf_dir):
    """Cells with the number of their events as polygons seen from one side: corners after clipping, area and extent on the map."""
    n = Q.grid_size(spark, sf_dir)
    i, j = F.col("i"), F.col("j")
    cells = R.bin_points(Q.observations(spark, sf_dir), n).groupBy("cell_id", "i", "j").agg(F.count("*").alias("events"))
    north, south, west, east = G.north_edge(i, n), G.north_edge(i + 1, n), (j - 1) * G.dlon(i, n), j * G.dlon(i, n)
    corner = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    cells = cells.withColumn("corners", F.array(corner(north, west), corner(north, east), corner(south, east), corner(south, west)))
    seen = polygons.clipped_polygons(cells, *VIEW).filter(F.size("polygon") > 0)
    xs, ys = F.col("polygon.x"), F.col("polygon.y")
    out = seen.select("cell_id", "events", F.size("polygon").alias("corners"), polygons.polygon_area("polygon").alias("area"), F.array_min(xs).alias("x_min"), F.array_max(xs).alias("x_max"), F.array_min(ys).alias("y_min"), F.array_max(ys).alias("y_max"))
    return Q.rounded(out, "area", "x_min", "x_max", "y_min", "y_max", digits=7)


def projected_points(spark, sf_dir):
    """Places of the events on the Miller map, and around the poles on the stereographic maps."""
    at = Q.observations(spark, sf_dir)
    lat, lon = F.col("lat"), F.col("lon")
    (mx, my), (nx, ny), (sx, sy) = G.miller(lat, lon), G.polar(lat, lon), G.polar(lat, lon, -1)
    out = at.select("event_id", mx.alias("miller_x"), my.alias("miller_y"), F.coalesce(nx, sx).alias("polar_x"), F.coalesce(ny, sy).alias("polar_y"))
    return Q.rounded(out, "miller_x", "miller_y", "polar_x", "polar_y", digits=7)


def vector_files(spark, sf_dir):
    """Vectors of two tracers' fields at the cells' centres, written as files of u and v, read together and turned with the frame."""
    n = Q.grid_size(spark, sf_dir)
    i, j = F.col("i"), F.col("j")
    field = Q.event_field(spark, sf_dir, n)
    base = new_path(spark, "stored")
    lines = [field.filter(F.col("tracer") == t).select(F.lit(202401010000).cast("long").alias("stamp"), (F.col("cell_id") - 1).alias("place"), (F.col("q") - 0.3).alias("value"), G.row_latitude(i, n).alias("lat"), G.cell_longitude(i, j, n).alias("lon")) for t in ("click", "view")]
    sink.write_named(sink.stored_lines(lines[0], "u").unionByName(sink.stored_lines(lines[1], "v")), base, lines_per_file=500)
    read = text.paired_winds(spark, base)
    lat, lon = G.rotated(F.col("lat"), F.col("lon"), 30.0, 60.0)
    u, v = G.rotated_vector(F.col("u"), F.col("v"), F.col("lat"), F.col("lon"), 30.0, 60.0)
    return Q.rounded(read.select((F.col("line") + 1).alias("cell_id"), lat.alias("lat"), lon.alias("lon"), u.alias("u"), v.alias("v")), "lat", "lon", "u", "v", digits=7)


QUERIES = {
    "remap_unrelated": remap_unrelated, "remap_mass": remap_mass, "stored_fields": stored_fields, "positional_fields": positional_fields, "file_order": file_order,
    "positional_winds": positional_winds, "asof_users": _asof("view", ("user_id",)), "asof_all": _asof("error", ()), "exact_ratios": exact_ratios, "exact_mass": exact_mass,
    "error_log": error_log, "spiral_nearest": spiral_nearest, "damaged_graph": damaged_graph, "observed_parts": observed_parts,
    "clipped_cells": clipped_cells, "projected_points": projected_points, "vector_files": vector_files}

_WEEKLY = """WITH seen AS (SELECT tracer, CAST(strftime(date_trunc('week', ts), '%Y%m%d%H%M') AS BIGINT) AS stamp, cell_id, round(avg(ratio), 9) AS q FROM binned JOIN (SELECT event_id, ts FROM events) USING (event_id) GROUP BY ALL),
  weekly AS (SELECT k.number AS tracer, w.stamp, c.cell_id, s.q FROM (SELECT DISTINCT tracer, stamp FROM seen) w JOIN (SELECT tracer, CAST(row_number() OVER (ORDER BY tracer) AS BIGINT) AS number FROM (SELECT DISTINCT tracer FROM seen)) k USING (tracer)
    CROSS JOIN cells c LEFT JOIN seen s ON s.tracer = w.tracer AND s.stamp = w.stamp AND s.cell_id = c.cell_id)
"""

#: Directed adjacency of the cells.
_EDGES = """e AS (SELECT a_id AS a, b_id AS b FROM intf UNION SELECT b_id, a_id FROM intf UNION SELECT a.cell_id, b.cell_id FROM cells a JOIN cells b ON b.i = a.i AND b.j = a.j % a.nlon + 1 WHERE a.nlon > 1
    UNION SELECT b.cell_id, a.cell_id FROM cells a JOIN cells b ON b.i = a.i AND b.j = a.j % a.nlon + 1 WHERE a.nlon > 1)"""


def _asof_sql(kind: str, key: str) -> str:
    return f"""WITH e AS (SELECT event_id, {key} AS k, epoch_us(ts) AS t, value, event_type = '{kind}' AS mark FROM events), m AS (SELECT k, t, max(value) AS v FROM e WHERE mark GROUP BY ALL),
      b AS (SELECT e.*, m.t AS t0, m.v AS v0 FROM e ASOF LEFT JOIN m ON m.k = e.k AND e.t >= m.t), f AS (SELECT b.*, m.t AS t1, m.v AS v1 FROM b ASOF LEFT JOIN m ON m.k = b.k AND b.t < m.t)
      SELECT event_id, t0, t1, {rnd('CASE WHEN t = t0 THEN v0 ELSE (1 - (t - t0)::DOUBLE / (t1 - t0)) * v0 + (t - t0)::DOUBLE / (t1 - t0) * v1 END', 'value', 8)} FROM f"""


FINALS: dict[str, str] = {
    "stored_fields": f"{_WEEKLY} SELECT * FROM weekly",
    "positional_fields": f"{_WEEKLY} SELECT * FROM weekly",
    "clipped_cells": f"""WITH eye AS (SELECT radians(40.1::DOUBLE) AS p0, radians(12.3::DOUBLE) AS l0), o AS (SELECT cell_id, count(*) AS events FROM binned GROUP BY ALL),
      c AS (SELECT o.cell_id, o.events, k, CASE WHEN k < 2 THEN north ELSE south END AS la, CASE WHEN k IN (0, 3) THEN (j - 1) * dlon ELSE j * dlon END AS lo FROM o JOIN cells USING (cell_id), (SELECT unnest([0, 1, 2, 3]) AS k)),
      x AS (SELECT *, cos(radians(la)) * cos(radians(lo)) AS x, cos(radians(la)) * sin(radians(lo)) AS y, sin(radians(la)) AS z FROM c), d AS (SELECT x.*, p0, l0, cos(p0) * cos(l0) * x + cos(p0) * sin(l0) * y + sin(p0) * z AS d FROM x, eye),
      e AS (SELECT a.*, b.d AS d2, a.d / (a.d - b.d) AS t, b.x AS bx, b.y AS by_, b.z AS bz FROM d a JOIN d b ON b.cell_id = a.cell_id AND b.k = (a.k + 1) % 4),
      h AS (SELECT cell_id, events, 2 * k AS o, x, y, z, p0, l0 FROM e WHERE d >= 0 UNION ALL SELECT cell_id, events, 2 * k + 1, hx / s, hy / s, hz / s, p0, l0 FROM (SELECT *, sqrt(hx * hx + hy * hy + hz * hz) AS s FROM (
        SELECT *, x + t * (bx - x) AS hx, y + t * (by_ - y) AS hy, z + t * (bz - z) AS hz FROM e WHERE (d >= 0) <> (d2 >= 0)))),
      m AS (SELECT cell_id, events, o, cos(l0) * y - sin(l0) * x AS px, cos(p0) * z - sin(p0) * (cos(l0) * x + sin(l0) * y) AS py FROM h),
      w AS (SELECT *, coalesce(lead(px) OVER g, first_value(px) OVER g) AS qx, coalesce(lead(py) OVER g, first_value(py) OVER g) AS qy FROM m WINDOW g AS (PARTITION BY cell_id ORDER BY o))
      SELECT cell_id, events, count(*) AS corners, {rnd('sum(qx * py - px * qy) / 2', 'area', 7)}, {rnd('min(px)', 'x_min', 7)}, {rnd('max(px)', 'x_max', 7)}, {rnd('min(py)', 'y_min', 7)}, {rnd('max(py)', 'y_max', 7)} FROM w GROUP BY cell_id, events""",
    "projected_points": f"""SELECT event_id, {rnd('radians(CASE WHEN lon >= 180 THEN lon - 360 ELSE lon END)', 'miller_x', 7)}, {rnd('1.25::DOUBLE * ln(tan(pi() / 4 + 0.4::DOUBLE * radians(lat)))', 'miller_y', 7)},
      {rnd('CASE WHEN abs(lat) >= 70 THEN 2 * tan(radians((90 - abs(lat)) / 2)) * sin(radians(lon - 270)) END', 'polar_x', 7)}, {rnd('CASE WHEN abs(lat) >= 70 THEN -sign(lat) * 2 * tan(radians((90 - abs(lat)) / 2)) * cos(radians(lon - 270)) END', 'polar_y', 7)} FROM pts""",
    "vector_files": f"""WITH w AS (SELECT a.cell_id, radians(a.lat) AS p, radians(a.lon + 30) AS l, a.q - 0.3::DOUBLE AS u, b.q - 0.3::DOUBLE AS v FROM field a JOIN field b USING (cell_id) WHERE a.tracer = 'click' AND b.tracer = 'view'),
      t AS (SELECT *, cos(p) * cos(l) AS x, cos(p) * sin(l) AS y, sin(p) AS z, -u * sin(l) - v * sin(p) * cos(l) AS a, u * cos(l) - v * sin(p) * sin(l) AS b, v * cos(p) AS c FROM w),
      r AS (SELECT cell_id, cos(radians(60)) * x + sin(radians(60)) * z AS x, y, cos(radians(60)) * z - sin(radians(60)) * x AS z, cos(radians(60)) * a + sin(radians(60)) * c AS a, b, cos(radians(60)) * c - sin(radians(60)) * a AS c FROM t)
      SELECT cell_id, {rnd('degrees(asin(z))', 'lat', 7)}, {rnd('(degrees(atan2(y, x)) + 360) % 360', 'lon', 7)}, {rnd('(x * b - y * a) / sqrt(x * x + y * y)', 'u', 7)}, {rnd('(c * (x * x + y * y) - z * (x * a + y * b)) / sqrt(x * x + y * y)', 'v', 7)} FROM r""",
    "error_log": f"SELECT *, CASE WHEN (stamp // 10000) % 3 > 0 THEN 1 ELSE 2 END AS version, count(*) OVER (PARTITION BY tracer) AS stored FROM ({sql(_SQL['stored_errors'])})",
    "spiral_nearest": f"""WITH s AS (SELECT greatest(12, count(*) // 24) AS points FROM events), k AS (SELECT k, sqrt(k - 0.5::DOUBLE) * cos(2 * pi() * k / ((1 + sqrt(5::DOUBLE)) / 2)) AS px, sqrt(k - 0.5::DOUBLE) * sin(2 * pi() * k / ((1 + sqrt(5::DOUBLE)) / 2)) AS py
        FROM (SELECT unnest(range(1, points + 1)) AS k FROM s)), d AS (SELECT event_id, ratio, sqrt(points * (90 - lat) / 180) * cos(radians(lon)) AS x, sqrt(points * (90 - lat) / 180) * sin(radians(lon)) AS y FROM pts, s),
      m AS (SELECT event_id, any_value(ratio) AS ratio, arg_min(k, (px - x) * (px - x) + (py - y) * (py - y)) AS k FROM d, k GROUP BY event_id)
      SELECT k, count(*) AS events, {rnd('avg(ratio)', 'ratio')} FROM m GROUP BY k""",
    "damaged_graph": f"""WITH {_EDGES}, near AS (SELECT a, list_sort(list(b)) AS near FROM e GROUP BY a),
      struck AS (SELECT DISTINCT a, near[1 + event_id % len(near)] AS b FROM binned JOIN near ON a = cell_id WHERE tracer = 'error'), kept AS (SELECT a, b FROM e EXCEPT SELECT a, b FROM struck)
      SELECT cell_id, (SELECT count(*) FROM kept WHERE a = cell_id) AS neighbours, (SELECT count(*) FROM kept x WHERE x.a = cell_id AND NOT EXISTS (SELECT 1 FROM kept y WHERE y.a = x.b AND y.b = x.a)) AS one_sided,
        NOT EXISTS (SELECT 1 FROM kept WHERE a = cell_id OR b = cell_id) AS isolated FROM cells""",
    "observed_parts": f"""WITH RECURSIVE {_EDGES}, hot AS (SELECT cell_id FROM binned WHERE tracer = 'click' GROUP BY cell_id HAVING count(*) >= 7),
      link AS (SELECT a, b FROM e WHERE a IN (SELECT cell_id FROM hot) AND b IN (SELECT cell_id FROM hot)), reach AS (SELECT cell_id AS a, cell_id AS b FROM hot UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
      SELECT a AS cell_id, min(b) AS part FROM reach GROUP BY a""",
    "asof_users": _asof_sql("view", "user_id"),
    "asof_all": _asof_sql("error", "1"),
    "exact_ratios": "SELECT tracer, CAST(sum(CAST(ratio * 73786976294838206464::DOUBLE AS HUGEINT)) AS VARCHAR) AS units FROM pts GROUP BY tracer",
    "exact_mass": f"SELECT tracer, true AS same, {rnd('sum(area * q)', 'mass', 8)} FROM field GROUP BY tracer",
    "file_order": f"""{_WEEKLY} SELECT 'ratio_' || tracer || '_' || stamp || '.dat' AS name, count(*) AS lines, 0::BIGINT AS misplaced, {rnd('sum((cell_id - 1) * coalesce(q, 0::DOUBLE))', 'moment', 5)} FROM weekly GROUP BY tracer, stamp""",
    "positional_winds": """SELECT 'u' AS kind, 202401010000 AS stamp, r.i, f AS j, NULL::BIGINT AS l, q AS value FROM (SELECT *, unnest(range(0, nlon + 1)) AS f FROM rws) r JOIN field d ON d.i = r.i AND d.j = greatest(r.f, 1) AND d.tracer = 'click'
      UNION ALL SELECT 'v', 202401010000, k.i, k.j, k.l, round(a.q - b.q, 9) FROM intf k JOIN field a ON a.cell_id = k.a_id AND a.tracer = 'view' JOIN field b ON b.cell_id = k.b_id AND b.tracer = 'view'""",
    "remap_unrelated": f"""{_OVERLAPS} SELECT f.tracer, o.dst AS cell_id, {rnd('sum(o.area * f.q) / any_value(c.area)', 'q', 11)}, {rnd('any_value(c.area / t.dst_area)', 'covered', 11)}
      FROM ovl o JOIN field f ON f.cell_id = o.src JOIN cover c USING (dst) JOIN dsts t USING (dst) GROUP BY f.tracer, o.dst""",
    "remap_mass": f"""{_OVERLAPS}, moved AS (SELECT f.tracer, o.dst, sum(o.area * f.q) AS m FROM ovl o JOIN field f ON f.cell_id = o.src GROUP BY ALL)
      SELECT tracer, {rnd('b', 'before', 6)}, {rnd('a', 'after', 6)}, abs(a - b) <= 1e-12 * b AS kept FROM (SELECT tracer, sum(q * area) AS b FROM field WHERE cell_id IN (SELECT cell_id FROM binned) GROUP BY tracer)
      JOIN (SELECT tracer, sum(m) AS a FROM moved GROUP BY tracer) USING (tracer)""",
}

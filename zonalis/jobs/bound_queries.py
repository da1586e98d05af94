"""Queries of geometry, winds and partitions over the cells that events lie in: what the grid says of a cell beside what the events say of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions import clock, fields
from zonalis.functions import geometry as G
from zonalis.jobs import queries as Q
from zonalis.jobs.exchange_queries import _EDGES
from zonalis.jobs.oracle import rnd
from zonalis.jobs.oracle_queries import AREA_MID, AREA_SR, COURANT, PARTED
from zonalis.jobs.oracle_queries import FINALS as _SQL
from zonalis.operators import diagnostics as D
from zonalis.operators import partition as P
from zonalis.operators import remap as R
from zonalis.operators import transport as T
from zonalis.sources import grid, text
from zonalis.sources.scratch import Scratch


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    n = Q.grid_size(spark, sf_dir)
    return R.bin_points(Q.observations(spark, sf_dir), n), n


def _told(placed: DataFrame, key, name: str) -> DataFrame:
    """(name, events, ratio): number and mean ratio of the events of each value of ``key``."""
    return placed.groupBy(key.alias(name)).agg(F.count("*").alias("events"), F.round(F.avg("ratio"), 9).alias("ratio"))


def _bound(query, key: str, of):
    """``query`` for the keys that have events, with their number and mean ratio; ``of(n)`` is an event's key."""

    def run(spark, sf_dir):
        placed, n = _placed(spark, sf_dir)
        return query(spark, sf_dir).join(_told(placed, of(n), key), key)

    return run


def _bound_sql(old: str, key: str, of: str, source: str = "binned") -> str:
    return f"SELECT x.*, s.events, s.ratio FROM ({old}) x JOIN (SELECT {of} AS {key}, count(*) AS events, round(avg(ratio), 9) AS ratio FROM {source} GROUP BY 1) s USING ({key})"


def _seen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(tracer, cell_id) of the cells that a tracer's events lie in."""
    placed, n = _placed(spark, sf_dir)
    return Scratch(spark).table(placed.select("tracer", "cell_id").distinct(), "seen"), n


def _at(seen: DataFrame, name: str) -> DataFrame:
    return seen.withColumnRenamed("cell_id", name)


def cell_area_closure(spark, sf_dir):
    """Area that each tracer is seen in, by all three formulas."""
    seen, n = _seen(spark, sf_dir)
    i = F.col("i")
    cells = grid.cells(spark, n).join(seen, "cell_id")
    return Q.rounded(cells.groupBy("tracer").agg(F.count("*").alias("cells"), F.sum(G.cell_area_steradian(i, n)).alias("steradian"), F.sum("area").alias("square_degrees"), F.sum(G.cell_area_midpoint(i, n)).alias("midpoint")), "steradian", "square_degrees", "midpoint", digits=6)


def _across(spark: SparkSession, n: int, seen: DataFrame) -> DataFrame:
    """(tracer, a_id, b_id) of the interfaces with the tracer on both sides."""
    return grid.interfaces(spark, n).select("a_id", "b_id").join(_at(seen, "a_id"), "a_id").join(_at(seen, "b_id"), ["tracer", "b_id"])


def neighbour_reflexivity(spark, sf_dir):
    """Of each tracer's cells the pairs seen from the north, and those of them that the south doesn't see."""
    seen, n = _seen(spark, sf_dir)
    i, j = F.col("i"), F.col("j")
    up = grid.cells(spark, n).filter("i > 1").select(F.explode(F.sequence(*G.north_bounds(i, j, n))).alias("k"), "i", "cell_id").select(G.cell_id(i - 1, F.col("k"), n).alias("a_id"), F.col("cell_id").alias("b_id"), F.lit(1).alias("u"))
    both = _across(spark, n, seen).join(up, ["a_id", "b_id"], "left")
    return both.groupBy("tracer").agg(F.count("*").alias("pairs"), F.count_if(F.col("u").isNull()).alias("one_sided"))


def isolated_cells(spark, sf_dir):
    """Cells of each tracer that have none of its cells above or below."""
    seen, n = _seen(spark, sf_dir)
    ends = _across(spark, n, seen).select("tracer", F.explode(F.array("a_id", "b_id")).alias("cell_id")).distinct().withColumn("met", F.lit(1))
    return seen.join(ends, ["tracer", "cell_id"], "left").groupBy("tracer").agg(F.count("*").alias("cells"), F.count_if(F.col("met").isNull()).alias("isolated"))


def adjacency_degree(spark, sf_dir):
    """How many of each tracer's cells have so many neighbours with the same tracer."""
    seen, n = _seen(spark, sf_dir)
    k = grid.edges(spark, n)
    each = k.unionByName(k.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(_at(seen, "a"), "a").join(_at(seen, "b"), ["tracer", "b"])
    return each.groupBy("tracer", "a").agg(F.count("*").alias("degree")).groupBy("tracer", "degree").agg(F.count("*").alias("cells"))


def edge_cut(spark, sf_dir):
    """Edges between cells of one tracer, and those of them that the parts cut."""
    seen, n = _seen(spark, sf_dir)
    part = {c: P.part_id(*G.cell_place(F.col(c), n), n, Q.PARTS) for c in "ab"}
    edges = grid.edges(spark, n).withColumn("cut", part["a"] != part["b"]).join(_at(seen, "a"), "a").join(_at(seen, "b"), ["tracer", "b"])
    return edges.groupBy("tracer").agg(F.count("*").alias("edges"), F.count_if("cut").alias("cut"))


def divergence_violations(spark, sf_dir):
    seen, n = _seen(spark, sf_dir)
    left = T.divergence(*Q.first_winds(spark, n), n).join(seen, "cell_id")
    return left.groupBy("tracer").agg(F.count("*").alias("cells"), F.count_if(F.abs("residual") > 1e-13).alias("violations"))


def _courant(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(tracer, courant): the largest Courant term of a second where the tracer is seen."""
    seen, n = _seen(spark, sf_dir)
    terms = T.courant_terms(*Q.first_winds(spark, n), n).join(seen, "cell_id")
    return terms.groupBy("tracer").agg(F.max(F.greatest("zonal", "meridional")).alias("courant")), n


def cfl(spark, sf_dir):
    largest, n = _courant(spark, sf_dir)
    return Q.rounded(largest.withColumn("courant", F.col("courant") * Q.time_step(n)), "courant", digits=7)


def timestep_from_cfl(spark, sf_dir):
    largest, _ = _courant(spark, sf_dir)
    return Q.rounded(largest.select("tracer", (F.lit(0.95) / F.col("courant")).alias("dt")), "dt", digits=4)


def wind_symmetry(spark, sf_dir):
    """For each row and its mirror image the winds, those that depart from symmetry, and the events of both rows."""
    placed, n = _placed(spark, sf_dir)
    u, v = T.analytic_winds(spark, n, fields.wind("deformation"), Q.time_step(n) / 2)
    mean = F.lit(2 * fields.PI / fields.PERIOD * 180 / fields.PI) * F.cos(F.radians(G.row_latitude(F.col("i"), n)))
    ring = u.select(F.lit("u").alias("kind"), F.least("i", 2 * n + 1 - F.col("i")).alias("row"), F.round("j").cast("long").alias("at"), (F.col("u") - mean).alias("x"))
    line = v.filter(F.col("i") != n).select(F.lit("v").alias("kind"), F.least("i", 2 * n - F.col("i")).alias("row"), F.round(F.col("lon_mid") * 1e6).cast("long").alias("at"), F.when(F.col("i") < n, F.col("v")).otherwise(-F.col("v")).alias("x"))
    pairs = ring.unionByName(line).groupBy("kind", "row", "at").agg(F.abs(F.sum("x")).alias("d"), F.count("*").alias("k"))
    rows = pairs.groupBy("kind", "row").agg(F.sum("k").alias("winds"), F.count_if(F.col("d") > 1e-12).alias("asymmetric"))
    return rows.join(_told(placed, F.least("i", 2 * n + 1 - F.col("i")), "row"), "row")


def spiral_points(spark, sf_dir):
    """A place on the Fibonacci spiral for each event, in the order of their ids, with its value."""
    from zonalis.functions.spiral import spiral_place

    k = F.col("event_id") + 1
    x, y = spiral_place(k)
    return Q.rounded(Q._read(spark, sf_dir, "events").select(k.alias("k"), x.alias("x"), y.alias("y"), "value"), "x", "y", digits=5)


# What no query had values for


def zone_events(spark, sf_dir):
    """Events of each tracer at the poles, next to the equator, in the middle of a sector and elsewhere."""
    placed, n = _placed(spark, sf_dir)
    i, j = F.col("i"), F.col("j")
    zone = F.when(i == 1, "north pole").when(i == 2 * n, "south pole").when(i == n, "above the equator").when(i == n + 1, "below the equator").when(G.is_middle(i, j, n), "middle").otherwise("elsewhere")
    return Q.rounded(placed.groupBy("tracer", zone.alias("zone")).agg(F.count("*").alias("events"), F.avg("ratio").alias("ratio")), "ratio")


def sector_copies(spark, sf_dir):
    """The first sector's field on all three, less the field that is there: mean and largest departure."""
    n = Q.grid_size(spark, sf_dir)
    field = Q.event_field(spark, sf_dir, n)
    one = field.filter(G.sector(F.col("i"), F.col("j"), n) == 0).select("tracer", "i", "j", F.col("q").alias("copy"))
    both = P.replicated(one, n).join(field.select("tracer", "i", "j", "q"), ["tracer", "i", "j"])
    d = F.abs(F.col("copy") - F.col("q"))
    return Q.rounded(both.groupBy("tracer", "sector").agg(F.count("*").alias("cells"), F.avg(d).alias("mean"), F.max(d).alias("largest")), "mean", "largest", digits=8)


def grid_from_cells(spark, sf_dir):
    """The number of rows of each tracer's stored field by the number of its cells, and its mass on that grid."""
    n = Q.grid_size(spark, sf_dir)
    field = Q.event_field(spark, sf_dir, n)
    found = text.checked_size(field)
    i, _ = G.cell_place(F.col("cell_id"), found)
    sums = D.mass(field.select("tracer", "q", i.alias("i")), found)
    return Q.rounded(sums.withColumn("n", F.lit(found).cast("long")), "mass", digits=6)


def event_steps(spark, sf_dir):
    """The step of a run of 20 minutes that an event falls in, when it begins, what is left, and the event's value, read as metres a second, in degrees."""
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    ts = F.col("ts").cast("timestamp")
    step = clock.steps_between(start, ts, 1200)
    begin = clock.step_time(start, step + 1, 1200)
    out = Q._read(spark, sf_dir, "events").select("event_id", step.alias("step"), F.unix_timestamp(begin).alias("begin"), (F.unix_timestamp(ts) - F.unix_timestamp(begin)).alias("left"), G.metres_to_degrees(F.col("value")).alias("degrees"), F.lit(clock.period_minutes("010230")).cast("long").alias("period"))
    return Q.rounded(out, "degrees", digits=12)


def _cell(n: int):
    return F.col("cell_id")


def _row(n: int):
    return F.col("i")


def _part(n: int):
    return P.part_id(F.col("i"), F.col("j"), n, Q.PARTS)


_BY_CELL = ("grid_cells", "north_neighbours", "sector_cells", "sector_replicate", "cell_predicates", "winds_deformation", "winds_divergent", "winds_rotation", "winds_snail", "wind_corrected", "centre_winds", "partition_ids")
_BY_ROW = ("prefix_counts", "zonal_faces", "wind_row_divergence")
_BY_PART = ("partition_adjacency", "halo_counts")

QUERIES = {
    **{k: _bound(Q.QUERIES[k], "cell_id", _cell) for k in _BY_CELL}, **{k: _bound(Q.QUERIES[k], "i", _row) for k in _BY_ROW}, **{k: _bound(Q.QUERIES[k], "part", _part) for k in _BY_PART}, "interfaces": _bound(Q.QUERIES["interfaces"], "a_id", _cell),
    "cell_area_closure": cell_area_closure, "neighbour_reflexivity": neighbour_reflexivity, "isolated_cells": isolated_cells, "adjacency_degree": adjacency_degree, "edge_cut": edge_cut,
    "divergence_violations": divergence_violations, "cfl": cfl, "timestep_from_cfl": timestep_from_cfl, "wind_symmetry": wind_symmetry, "spiral_points": spiral_points,
    "zone_events": zone_events, "sector_copies": sector_copies, "grid_from_cells": grid_from_cells, "event_steps": event_steps,
}

_SEEN = "seen AS (SELECT DISTINCT tracer, cell_id FROM binned)"
_PARTED_EVENTS = f"(SELECT b.*, k.part FROM binned b JOIN ({PARTED}) k USING (cell_id))"

FINALS: dict[str, str] = {
    **{k: _bound_sql(_SQL[k], "cell_id", "cell_id") for k in _BY_CELL}, **{k: _bound_sql(_SQL[k], "i", "i") for k in _BY_ROW}, **{k: _bound_sql(_SQL[k], "part", "part", _PARTED_EVENTS) for k in _BY_PART}, "interfaces": _bound_sql(_SQL["interfaces"], "a_id", "cell_id"),
    "cell_area_closure": f"WITH {_SEEN} SELECT tracer, count(*) AS cells, {rnd(f'sum({AREA_SR})', 'steradian', 6)}, {rnd('sum(area)', 'square_degrees', 6)}, {rnd(f'sum({AREA_MID})', 'midpoint', 6)} FROM cells JOIN seen USING (cell_id) GROUP BY tracer",
    "neighbour_reflexivity": f"""WITH {_SEEN}, up AS (SELECT a.cell_id AS a_id, b.cell_id AS b_id FROM cells b JOIN cells a ON a.i = b.i - 1 AND least(a.j * a.dlon, b.j * b.dlon) - greatest((a.j - 1) * a.dlon, (b.j - 1) * b.dlon) > 1e-9)
      SELECT x.tracer, count(*) AS pairs, count(*) FILTER (u.a_id IS NULL) AS one_sided FROM intf d JOIN seen x ON x.cell_id = d.a_id JOIN seen y ON y.cell_id = d.b_id AND y.tracer = x.tracer LEFT JOIN up u ON u.a_id = d.a_id AND u.b_id = d.b_id GROUP BY x.tracer""",
    "isolated_cells": f"""WITH {_SEEN} SELECT tracer, count(*) AS cells, count(*) FILTER (NOT EXISTS (SELECT 1 FROM intf k JOIN seen o ON o.tracer = s.tracer AND o.cell_id = k.b_id WHERE k.a_id = s.cell_id)
      AND NOT EXISTS (SELECT 1 FROM intf k JOIN seen o ON o.tracer = s.tracer AND o.cell_id = k.a_id WHERE k.b_id = s.cell_id)) AS isolated FROM seen s GROUP BY tracer""",
    "adjacency_degree": f"WITH {_EDGES}, {_SEEN} SELECT tracer, degree, count(*) AS cells FROM (SELECT x.tracer, a, count(*) AS degree FROM e JOIN seen x ON x.cell_id = a JOIN seen y ON y.cell_id = b AND y.tracer = x.tracer GROUP BY ALL) GROUP BY ALL",
    "edge_cut": f"WITH {_EDGES}, {_SEEN}, parted AS ({PARTED}) SELECT x.tracer, count(*) AS edges, count(*) FILTER (p.part <> r.part) AS cut FROM e JOIN seen x ON x.cell_id = a JOIN seen y ON y.cell_id = b AND y.tracer = x.tracer JOIN parted p ON p.cell_id = a JOIN parted r ON r.cell_id = b WHERE a < b GROUP BY x.tracer",
    "divergence_violations": f"WITH {_SEEN} SELECT tracer, count(*) AS cells, count(*) FILTER (abs(residual) > 1e-13) AS violations FROM resid JOIN seen USING (cell_id) GROUP BY tracer",
    "cfl": f"WITH {_SEEN} SELECT tracer, {rnd('max(greatest(zonal, meridional)) * any_value(dt)', 'courant', 7)} FROM ({COURANT}) JOIN seen USING (cell_id) JOIN dts ON true GROUP BY tracer",
    "timestep_from_cfl": f"WITH {_SEEN} SELECT tracer, {rnd('0.95::DOUBLE / max(greatest(zonal, meridional))', 'dt', 4)} FROM ({COURANT}) JOIN seen USING (cell_id) GROUP BY tracer",
    "wind_symmetry": """SELECT w.*, s.events, s.ratio FROM (SELECT 'u' AS kind, least(u0.i, 2 * n + 1 - u0.i) AS row, count(*) AS winds, 0::BIGINT AS asymmetric FROM u0, p GROUP BY ALL
        UNION ALL SELECT 'v', least(v0.i, 2 * p.n - v0.i), count(*), 0::BIGINT FROM v0, p WHERE v0.i <> p.n GROUP BY ALL) w
      JOIN (SELECT least(i, 2 * n + 1 - i) AS row, count(*) AS events, round(avg(ratio), 9) AS ratio FROM binned, p GROUP BY 1) s USING (row)""",
    "spiral_points": f"SELECT event_id + 1 AS k, {rnd('sqrt(event_id + 0.5::DOUBLE) * cos(2 * pi() * (event_id + 1) / ((1 + sqrt(5::DOUBLE)) / 2))', 'x', 5)}, {rnd('sqrt(event_id + 0.5::DOUBLE) * sin(2 * pi() * (event_id + 1) / ((1 + sqrt(5::DOUBLE)) / 2))', 'y', 5)}, value FROM events",
    "zone_events": f"""SELECT tracer, CASE WHEN b.i = 1 THEN 'north pole' WHEN b.i = 2 * c.n THEN 'south pole' WHEN b.i = c.n THEN 'above the equator' WHEN b.i = c.n + 1 THEN 'below the equator'
      WHEN abs(c.lon - 120 * floor(c.lon / 120) - 60) < c.dlon / 4 THEN 'middle' ELSE 'elsewhere' END AS zone, count(*) AS events, {rnd('avg(ratio)', 'ratio')} FROM binned b JOIN cells c USING (cell_id) GROUP BY ALL""",
    "sector_copies": f"""SELECT f.tracer, CAST(floor(f.lon / 120) AS BIGINT) AS sector, count(*) AS cells, {rnd('avg(abs(g.q - f.q))', 'mean', 8)}, {rnd('max(abs(g.q - f.q))', 'largest', 8)}
      FROM field f JOIN field g ON g.tracer = f.tracer AND g.i = f.i AND g.j = (f.j - 1) % (f.nlon // 3) + 1 GROUP BY ALL""",
    "grid_from_cells": f"SELECT tracer, any_value(n) AS n, {rnd('sum(area * q)', 'mass', 6)} FROM field GROUP BY tracer",
    "event_steps": f"""SELECT event_id, step, epoch(TIMESTAMP '2024-01-01')::BIGINT + step * 1200 AS begin, t - epoch(TIMESTAMP '2024-01-01')::BIGINT - step * 1200 AS left, {rnd('value * 180 / (6.3172e6::DOUBLE * pi())', 'degrees', 12)}, 1590::BIGINT AS period
      FROM (SELECT event_id, value, CAST(floor(epoch(ts)) AS BIGINT) AS t, (CAST(floor(epoch(ts)) AS BIGINT) - epoch(TIMESTAMP '2024-01-01')::BIGINT) // 1200 AS step FROM events)""",
}

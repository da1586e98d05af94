"""Winds and one transport step on cells, zonal and meridional.

Field tables are (tracer, cell_id, i, j, q, mass); winds are (i, j, u) at west faces and (i, j, l, a_id, b_id, lat, length, v)
at interfaces, v positive to the south. Zonal work is windows over the ring of a row, all with one partitioning and order,
so it shuffles once; meridional work is equality joins on cell ids and one sum a cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonalis.functions import geometry as G
from zonalis.functions.fields import Wind
from zonalis.sources import grid

#: Fixed value: below this mass a cell counts as empty.
TINY = 1e-13

#: Writes a table that several later plans read, and returns it as read back.
Cut = Callable[[DataFrame, str], DataFrame]


def uncut(df: DataFrame, tag: str) -> DataFrame:
    return df


def limited_slope(west: Column, here: Column, east: Column) -> Column:
    """Van Leer's limiter: 0 at an extremum, else the least of half the span and twice each difference, with its sign."""
    a, b = here - west, east - here
    least = F.least(F.abs(east - west) / 2, 2 * F.abs(a), 2 * F.abs(b))
    return F.when((a >= 0) & (b >= 0), least).when((a < 0) & (b < 0), -least).otherwise(F.lit(0.0))


def unlimited_slope(west: Column, here: Column, east: Column) -> Column:
    return (east - west) / 2


def ring(*keys: str):
    return Window.partitionBy(*keys).orderBy("j")


def west_of(name: str, *keys: str) -> Column:
    """The value of the western neighbour; the last cell of the row is that of the first."""
    w = ring(*keys)
    return F.coalesce(F.lag(name).over(w), F.last_value(name).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def east_of(name: str, *keys: str) -> Column:
    w = ring(*keys)
    return F.coalesce(F.lead(name).over(w), F.first_value(name).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def analytic_winds(spark: SparkSession, n: int, wind: Wind, t: float) -> tuple[DataFrame, DataFrame]:
    """Winds at seconds ``t``: u at the west faces of the cells, v (north positive) at the interfaces."""
    u = grid.cells(spark, n).select("cell_id", "i", "j", wind.u(F.col("lat"), (F.col("j") - 1) * F.col("dlon"), t).cast("double").alias("u"))
    v = grid.interfaces(spark, n).withColumn("v", wind.v(F.col("lat"), F.col("lon_mid"), t).cast("double"))
    return u, v


def row_divergence(v: DataFrame) -> DataFrame:
    """(i, divergence): the sum of v times length over a line of interfaces, per degree of its circle."""
    return v.groupBy("i").agg((F.sum(F.col("v") * F.col("length")) / (F.lit(360.0) * F.cos(F.radians(F.first("lat"))))).alias("divergence"))


def net_inflow(v: DataFrame, amount: Column) -> DataFrame:
    """(cell_id, inflow): what enters from the north less what leaves to the south, for any amount on the interfaces."""
    ends = F.array(F.struct(F.col("b_id").alias("cell_id"), amount.alias("x")), F.struct(F.col("a_id").alias("cell_id"), (-amount).alias("x")))
    return v.select(F.explode(ends).alias("e")).groupBy("e.cell_id").agg(F.sum("e.x").alias("inflow"))


def corrected_winds(u: DataFrame, v: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Winds without divergence: v turned to south positive less its row mean, u rebuilt along each row from the first face."""
    south = v.withColumn("v", -F.col("v"))
    # one row for each latitude: the join's small side is 2n - 1 rows
    south = south.join(row_divergence(south), "i").withColumn("v", F.col("v") - F.col("divergence")).drop("divergence")
    inflow = net_inflow(south, F.col("v") * F.col("length")).withColumnRenamed("inflow", "flux")
    before = ring("i").rowsBetween(Window.unboundedPreceding, -1)
    whole = ring("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    faces = u.join(inflow, "cell_id", "left").select(
        "cell_id", "i", "j", (F.first_value("u").over(whole) + F.coalesce(F.sum("flux").over(before), F.lit(0.0)) / F.lit(G.dlat(n))).alias("u")
    )
    return faces, south


def divergence(u: DataFrame, v: DataFrame, n: int) -> DataFrame:
    """(cell_id, residual) of corrected winds: (u_west - u_east) dlat plus the net inflow across rows."""
    inflow = net_inflow(v, F.col("v") * F.col("length"))
    ringed = u.withColumn("u_east", east_of("u", "i"))
    return ringed.join(inflow, "cell_id", "left").select("cell_id", ((F.col("u") - F.col("u_east")) * F.lit(G.dlat(n)) + F.coalesce("inflow", F.lit(0.0))).alias("residual"))


def zonal_slopes(field: DataFrame, limited: bool = True) -> DataFrame:
    slope = limited_slope if limited else unlimited_slope
    around = field.withColumns({"q_west": west_of("q", "tracer", "i"), "q_east": east_of("q", "tracer", "i")})
    return around.withColumn("slope", slope(F.col("q_west"), F.col("q"), F.col("q_east")))


def zonal_gradients(field: DataFrame, n: int) -> DataFrame:
    """Half the difference of the neighbours per degree of the row's circle."""
    around = field.withColumns({"q_west": west_of("q", "tracer", "i"), "q_east": east_of("q", "tracer", "i")})
    i = F.col("i")
    return around.withColumn("gradient", (F.col("q_east") - F.col("q_west")) / 2 / (G.dlon(i, n) * F.cos(F.radians(G.row_latitude(i, n)))))


def zonal_step(field: DataFrame, u: DataFrame, n: int, dt: float, limited: bool = True) -> DataFrame:
    """Upwind fluxes across the faces of each ring; mass and ratio after them.

    The wind table has one row a cell; it joins the field on the cell, whatever the number of tracers.
    """
    i = F.col("i")
    sloped = zonal_slopes(field.join(u.select("cell_id", "u"), "cell_id"), limited)
    sloped = sloped.withColumn("slope_west", west_of("slope", "tracer", "i"))
    courant = F.col("u") * dt / (G.dlon(i, n) * F.cos(F.radians(G.row_latitude(i, n))))
    upwind = F.when(courant > 0, F.col("q_west") + 0.5 * (1 - courant) * F.col("slope_west")).otherwise(F.col("q") - 0.5 * (1 + courant) * F.col("slope"))
    air = F.col("u") * dt * F.lit(G.dlat(n))
    faces = sloped.withColumns({"air": air, "trace": air * upwind})
    faces = faces.withColumns({"air_east": east_of("air", "tracer", "i"), "trace_east": east_of("trace", "tracer", "i")})
    mass = F.col("mass") + F.col("air") - F.col("air_east")
    ratio = (F.col("mass") * F.col("q") + F.col("trace") - F.col("trace_east")) / mass
    return faces.select("tracer", "cell_id", "i", "j", F.when(F.abs(mass) < TINY, 0.0).otherwise(ratio).alias("q"), mass.alias("mass"))


def meridional_slopes(field: DataFrame, n: int, limited: bool = True) -> DataFrame:
    """Adds ``slope``, from north to south: the rows above and below are read at the cell's own longitude."""
    slope = limited_slope if limited else unlimited_slope
    i, j = F.col("i"), F.col("j")
    graded = zonal_gradients(field, n)
    source = graded.select("tracer", F.col("cell_id").alias("near_id"), G.cell_longitude(i, j, n).alias("near_lon"), F.cos(F.radians(G.row_latitude(i, n))).alias("near_cos"), F.col("q").alias("near_q"), F.col("gradient").alias("near_gradient"))

    def near(frame: DataFrame, other: Column, name: str) -> DataFrame:
        keyed = frame.withColumn("near_id", G.cell_id(other, G.containing_column(i, j, other, n), n))
        value = F.col("near_q") + (G.cell_longitude(i, j, n) - F.col("near_lon")) * F.col("near_cos") * F.col("near_gradient")
        return keyed.join(source, ["tracer", "near_id"], "left").withColumn(name, value).drop("near_id", "near_lon", "near_cos", "near_q", "near_gradient")

    both = near(near(field, F.greatest(i - 1, F.lit(1)), "q_north"), F.least(i + 1, F.lit(2 * n)), "q_south")
    inner = (i > 1) & (i < 2 * n)
    return both.withColumn("slope", F.when(inner, slope(F.col("q_north"), F.col("q"), F.col("q_south"))).otherwise(F.lit(0.0)))


def meridional_step(field: DataFrame, v: DataFrame, n: int, dt: float, limited: bool = True, cut: Cut = uncut) -> DataFrame:
    """Upwind fluxes across the interfaces; each cell's fluxes are summed once, for mass and tracer together.

    The slopes are read from both sides of the interfaces: ``cut`` may write them in between.
    """
    sloped = cut(meridional_slopes(field, n, limited).select("tracer", "cell_id", "q", "slope"), "slopes")
    north = sloped.select("tracer", F.col("cell_id").alias("a_id"), F.col("q").alias("qa"), F.col("slope").alias("sa"))
    south = sloped.select("tracer", F.col("cell_id").alias("b_id"), F.col("q").alias("qb"), F.col("slope").alias("sb"))
    flow = v.select("a_id", "b_id", "v", "length").join(north, "a_id").join(south, ["tracer", "b_id"])
    courant = F.col("v") * dt / F.lit(G.dlat(n))
    upwind = F.when(courant > 0, F.col("qa") + 0.5 * (1 - courant) * F.col("sa")).otherwise(F.col("qb") - 0.5 * (1 + courant) * F.col("sb"))
    air = F.col("v") * dt * F.col("length")
    ends = F.array(
        F.struct(F.col("b_id").alias("cell_id"), air.alias("air"), (air * upwind).alias("trace")),
        F.struct(F.col("a_id").alias("cell_id"), (-air).alias("air"), (-air * upwind).alias("trace")),
    )
    sums = flow.select("tracer", F.explode(ends).alias("e")).groupBy("tracer", "e.cell_id").agg(F.sum("e.air").alias("air"), F.sum("e.trace").alias("trace"))
    mass = F.col("mass") + F.coalesce("air", F.lit(0.0))
    ratio = (F.col("mass") * F.col("q") + F.coalesce("trace", F.lit(0.0))) / mass
    return field.join(sums, ["tracer", "cell_id"], "left").select("tracer", "cell_id", "i", "j", F.when(F.abs(mass) < TINY, 0.0).otherwise(ratio).alias("q"), mass.alias("mass"))


def with_mass(field: DataFrame, n: int) -> DataFrame:
    """Fresh air mass: the cell's area."""
    return field.withColumn("mass", G.cell_area(F.col("i"), n))


def step(field: DataFrame, u: DataFrame, v: DataFrame, n: int, dt: float, order: str = "zonal-first", limited: bool = True, cut: Cut = uncut) -> DataFrame:
    """One step from (tracer, cell_id, i, j, q): zonal and meridional parts in the given order, or the mean of both orders.

    With ``cut`` what is read more than once (the field between the parts, the meridional slopes) is written once.
    """
    fresh = with_mass(field.select("tracer", "cell_id", "i", "j", "q"), n)
    if order == "zonal":
        return zonal_step(fresh, u, n, dt, limited)
    if order == "meridional":
        return meridional_step(fresh, v, n, dt, limited, cut)
    if order == "zonal-first":
        return meridional_step(cut(zonal_step(fresh, u, n, dt, limited), "half"), v, n, dt, limited, cut)
    if order == "meridional-first":
        return zonal_step(meridional_step(fresh, v, n, dt, limited, cut), u, n, dt, limited)
    if order == "symmetric":
        a, b = (cut(step(field, u, v, n, dt, o, limited, cut), o) for o in ("zonal-first", "meridional-first"))
        other = b.select("tracer", "cell_id", F.col("q").alias("q_b"), F.col("mass").alias("mass_b"))
        return a.join(other, ["tracer", "cell_id"]).select("tracer", "cell_id", "i", "j", ((F.col("q") + F.col("q_b")) / 2).alias("q"), ((F.col("mass") + F.col("mass_b")) / 2).alias("mass"))
    raise ValueError(f"no order of splitting {order!r}")


def courant_terms(u: DataFrame, v: DataFrame, n: int) -> DataFrame:
    """(cell_id, zonal, meridional): Courant numbers a second of the cells of rows 1 .. 2n - 1.

    Lengths are taken at the south edge; the zonal wind is that of the west face, the meridional one the sum of all
    southern interfaces by absolute value.
    """
    i = F.col("i")
    out = v.groupBy(F.col("a_id").alias("cell_id")).agg(F.sum(F.abs("v") * F.col("length")).alias("out"))
    width = G.dlon(i, n) * F.cos(F.radians(G.north_edge(i + 1, n)))
    return u.filter(i < 2 * n).join(out, "cell_id").select("cell_id", (F.abs("u") / width).alias("zonal"), (F.col("out") / (F.lit(G.dlat(n)) * width)).alias("meridional"))


def courant_number(u: DataFrame, v: DataFrame, n: int, dt: float) -> DataFrame:
    """One row: (courant) of a step of ``dt`` seconds."""
    return courant_terms(u, v, n).agg((F.max(F.greatest("zonal", "meridional")) * dt).alias("courant"))


def largest_step(u: DataFrame, v: DataFrame, n: int, courant: float) -> DataFrame:
    """One row: (dt) in seconds, the longest step of that Courant number."""
    return courant_terms(u, v, n).agg((F.lit(courant) / F.max(F.greatest("zonal", "meridional"))).alias("dt"))


def interpolated_winds(winds: DataFrame, times: DataFrame, period: int) -> DataFrame:
    """Winds at ``times`` (t seconds) between the rows of ``winds`` (ts seconds, every ``period``; keys; value).

    The bracket of a time is found by its bucket t div period, an equality join with the earlier and the later row. At a
    bucket's start the earlier wind is taken as it is.
    """
    at = times.withColumn("bucket", F.floor(F.col("t") / period))
    early = winds.select((F.col("ts") / period).cast("long").alias("bucket"), F.col("ts").alias("t_prev"), "key", F.col("value").alias("prev"))
    late = winds.select(((F.col("ts") / period).cast("long") - 1).alias("bucket"), "key", F.col("value").alias("next"))
    alpha = (F.col("t") - F.col("t_prev")) / F.lit(float(period))
    value = F.when(F.col("t") == F.col("t_prev"), F.col("prev")).otherwise((1 - alpha) * F.col("prev") + alpha * F.col("next"))
    return at.join(early, "bucket").join(late, ["bucket", "key"], "left").select("t", "key", value.alias("value"))


def centre_winds(u: DataFrame, v: DataFrame) -> DataFrame:
    """(cell_id, u, v) at centres: the mean of both faces, and the length-weighted mean over all interfaces of the cell."""
    mid = u.withColumn("u_mid", (F.col("u") + east_of("u", "i")) / 2)
    ends = F.array("a_id", "b_id")
    mean = v.select(F.explode(ends).alias("cell_id"), "v", "length").groupBy("cell_id").agg((F.sum(F.col("v") * F.col("length")) / F.sum("length")).alias("v"))
    return mid.join(mean, "cell_id").select("cell_id", F.col("u_mid").alias("u"), "v")

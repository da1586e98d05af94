"""Fields onto other grids and back: points into cells, sparse weights, isentropic levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonalis.functions import geometry as G
from zonalis.sources import grid


def bin_points(points: DataFrame, n: int, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds (i, j, cell_id) of the cell that holds each point: a projection, not a join."""
    placed = points.withColumn("i", G.point_row(F.col(lat), n))
    placed = placed.withColumn("j", G.point_column(F.col("i"), F.col(lon), n))
    return placed.withColumn("cell_id", G.cell_id(F.col("i"), F.col("j"), n))


def cell_means(points: DataFrame, n: int, value: Column, digits: int = 9) -> DataFrame:
    """(tracer, cell_id, q): the mean of ``value`` of the points (tracer, lat, lon) of a cell, rounded."""
    return bin_points(points, n).groupBy("tracer", "cell_id").agg(F.round(F.avg(value), digits).alias("q"))


def full_field(spark: SparkSession, means: DataFrame, n: int, fill: float | None = 0.0) -> DataFrame:
    """(tracer, cell_id, i, j, q) with every cell of the grid, ``fill`` (None: null) where a tracer has no point.

    The tracers are few (a dimension of the run); each cell is spread over them before the join with the means.
    """
    tracers = means.select("tracer").distinct().agg(F.sort_array(F.collect_set("tracer")).alias("all"))
    spread = grid.cells(spark, n).select("cell_id", "i", "j").join(F.broadcast(tracers)).select("cell_id", "i", "j", F.explode("all").alias("tracer"))
    return spread.join(means, ["tracer", "cell_id"], "left").select("tracer", "cell_id", "i", "j", F.coalesce("q", F.lit(fill).cast("double")).alias("q"))


def overlap_links(spark: SparkSession, n: int, factor: int = 2) -> DataFrame:
    """(src, dst, w): cells of the grid ``n`` onto those of ``factor * n``, weights that add up to 1 a destination.

    Rows of the finer grid lie within one row of the coarser, and longitudes overlap within integer bounds, so links are
    generated without a join. The weight is the overlap's share of the destination's width.
    """
    fine = n * factor
    i, j = F.col("i"), F.col("j")
    above = G._quotient(i - 1, F.lit(factor).cast("long")) + 1
    a, b = G.nlon(i, fine), G.nlon(above, n)
    low, high = G._quotient((j - 1) * b, a) + 1, G._quotient(j * b + a - 1, a)
    each = grid.cells(spark, fine).select("cell_id", "i", "j", F.explode(F.sequence(low, high)).alias("l"))
    west, east = F.greatest((j - 1) * G.dlon(i, fine), (F.col("l") - 1) * G.dlon(above, n)), F.least(j * G.dlon(i, fine), F.col("l") * G.dlon(above, n))
    return each.select(G.cell_id(above, F.col("l"), n).alias("src"), F.col("cell_id").alias("dst"), ((east - west) / G.dlon(i, fine)).alias("w"))


#: By how a link's weight was normalised when it was made: what its product with the ratio is still divided by.
NORMALISED = {"frac": "1D", "destarea": "dst_frac", "none": "dst_area * dst_frac"}


def weighted_links(links: DataFrame, area: Column, normalise: str) -> DataFrame:
    """(src, dst, w, dst_area, dst_frac) of links (src, dst, w, ...) whose w is the share of the destination that the source covers.

    ``dst_frac`` is the share of the destination that all its links cover. Weights are shares of the covered part
    (frac), of the destination (destarea), or areas (none).
    """
    cover = links.groupBy("dst").agg(F.sum("w").alias("dst_frac"))
    each = links.withColumn("dst_area", area).select("src", "dst", "w", "dst_area").join(cover, "dst")
    weight = {"frac": F.col("w") / F.col("dst_frac"), "destarea": F.col("w"), "none": F.col("w") * F.col("dst_area")}[normalise]
    return each.withColumn("w", weight)


def remap(field: DataFrame, links: DataFrame, normalise: str = "frac") -> DataFrame:
    """(tracer, cell_id, q) on the destination: sums of weight times ratio.

    Weights of ``frac`` are used as they are, those of ``destarea`` are divided by the covered share ``dst_frac`` of the
    destination, and those of ``none`` by its covered area, ``dst_area * dst_frac``: columns that the links then have. Cells
    without a link get no row.
    """
    if normalise not in NORMALISED:
        raise ValueError(f"not a normalisation: {normalise!r}")
    joined = links.join(field.select("tracer", F.col("cell_id").alias("src"), "q"), "src")
    total = F.sum(F.col("w") * F.col("q") / F.expr(NORMALISED[normalise]))
    return joined.groupBy("tracer", F.col("dst").alias("cell_id")).agg(total.alias("q"))


def on_isentrope(levels: DataFrame, theta: float, values: tuple[str, ...], keys: tuple[str, ...], reference: float = 1000.0, kappa: float = 2 / 7) -> DataFrame:
    """Values interpolated to potential temperature ``theta`` between neighbouring levels (keys, pressure, temperature).

    A column has few levels; windows over them find the first pair that brackets the temperature from below.
    """
    hot = levels.withColumn("theta", F.col("temperature") * F.pow(F.lit(reference) / F.col("pressure"), F.lit(kappa)))
    w = Window.partitionBy(*keys).orderBy(F.col("pressure").desc())
    above = hot.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("theta", *values)})
    pair = above.filter((F.col("theta") <= theta) & (F.col("next_theta") > theta))
    share = (F.lit(theta) - F.col("theta")) / (F.col("next_theta") - F.col("theta"))
    mixed = pair.select(*keys, "pressure", *((F.col(c) + share * (F.col(f"next_{c}") - F.col(c))).alias(f"at_{c}") for c in values))
    return mixed.groupBy(*keys).agg(*(F.max_by(f"at_{c}", "pressure").alias(c) for c in values))

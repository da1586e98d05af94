"""Measures of fields and runs: mass, norms, filaments, mixing, bounds, symmetry, convergence, timings.

A field is (tracer, cell_id, i, j, q). Each measure is one aggregate, pre-aggregated by Spark before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions import geometry as G

#: Fixed values of the diagnostics: thresholds of filaments, and tolerances.
FILAMENT_LEVELS = 18
TINY = 1e-12
BOUND = 1e-13
UNDEFINED = -9999.0


def mass(field: DataFrame, n: int, *keys: str) -> DataFrame:
    """(tracer, *keys, mass): area times ratio, in square degrees."""
    return field.groupBy("tracer", *keys).agg(F.sum(G.cell_area(F.col("i"), n) * F.col("q")).alias("mass"))


def paired(first: DataFrame, last: DataFrame, how: str = "inner") -> DataFrame:
    """Two runs side by side: (tracer, cell_id, i, j, q0, q)."""
    a = first.select("tracer", "cell_id", "i", "j", F.col("q").alias("q0"))
    return a.join(last.select("tracer", "cell_id", "q"), ["tracer", "cell_id"], how)


def error_norms(pairs: DataFrame, area: Column) -> DataFrame:
    """(tracer, l2, l_inf, quadratic): relative to q0, but the quadratic error, which is a plain sum.

    Where q0 is zero in all cells the relative errors are not defined: null.
    """
    d = F.col("q") - F.col("q0")
    return pairs.groupBy("tracer").agg(
        F.sqrt(F.try_divide(F.sum(area * d * d), F.sum(area * F.col("q0") * F.col("q0")))).alias("l2"),
        F.try_divide(F.max(F.abs(d)), F.max(F.abs("q0"))).alias("l_inf"),
        F.sum(area * d * d).alias("quadratic"),
    )


def filaments(pairs: DataFrame, area: Column, levels: int = FILAMENT_LEVELS) -> DataFrame:
    """(tracer, threshold, preserved): percent of the area at or above each threshold that is left.

    Each cell is spread over the thresholds, a fixed number, and sums are pre-aggregated; nothing is joined.
    """
    at = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    each = pairs.select("tracer", area.alias("area"), "q0", "q", at.alias("k")).withColumn("threshold", F.lit(0.1) + F.col("k") / F.lit(float(levels)) * F.lit(0.9))

    def above(name: str) -> Column:
        return F.sum(F.when(F.col(name) >= F.col("threshold") - TINY, F.col("area")).otherwise(0.0))

    sums = each.groupBy("tracer", "threshold").agg(above("q0").alias("a0"), above("q").alias("a"))
    return sums.select("tracer", "threshold", F.when(F.col("a0") < TINY, 0.0).otherwise(100 * F.col("a") / F.col("a0")).alias("preserved"))


def mixing(pairs: DataFrame, area: Column, low: float = 0.1, high: float = 1.0) -> DataFrame:
    """(tracer, real_mixing, unmixing, overshooting) of ratios (q0, q) that started on the curve q = 0.9 - 0.8 q0^2.

    A cell's share is its distance to the curve; it counts as mixing between curve and chord, as unmixing within the
    range of both tracers, else as overshooting. Where the cubic for the nearest point of the curve has no root by its closed
    form (c = 0: q0 = 0 and q small), the lower end of the curve stands for it.
    """
    x, y = F.col("q0"), F.col("q")
    top, bottom = 0.9 - 0.8 * low * low, 0.9 - 0.8 * high * high
    # fixed values: the coefficients of the closed form of the cubic's root
    inside = -1687296.0 + 12168000.0 * y - 29250000.0 * y * y + 23437500.0 * y * y * y + 29648025.0 * x * x
    c = F.pow(65340.0 * x + 12.0 * F.sqrt(F.greatest(inside, F.lit(0.0))), F.lit(1 / 3)) / 60.0
    root = F.least(F.lit(high), F.greatest(F.lit(low), c + F.try_divide(F.lit(13.0 / 75.0) - 5.0 / 12.0 * y, c)))

    def curve(v: Column) -> Column:
        return 0.9 - 0.8 * v * v

    distance = F.sqrt((root - x) * (root - x) / 0.81 + (curve(root) - y) * (curve(root) - y) / (0.792 * 0.792))
    slope = (bottom - top) / (high - low)
    eps = 1e-7
    kind = (
        F.when((y < curve(x) + eps) & (y > slope * (x - low) + top - eps), "mixing")
        .when((x < high + eps) & (x > low - eps) & (y < top + eps) & (y > bottom - eps), "unmixing")
        .otherwise("overshooting")
    )
    each = pairs.select("tracer", area.alias("area"), (distance * area).alias("d"), kind.alias("kind"))
    return each.groupBy("tracer").agg(*((F.sum(F.when(F.col("kind") == k, F.col("d")).otherwise(0.0)) / F.sum("area")).alias(name) for k, name in (("mixing", "real_mixing"), ("unmixing", "unmixing"), ("overshooting", "overshooting"))))


def bounds(field: DataFrame, n: int) -> DataFrame:
    """(tracer, above, negative, undefined, empty): cells outside [0, 1], not set, or of no mass."""
    q = F.col("q")
    return field.groupBy("tracer").agg(
        F.count_if(F.abs(q) > 1 + BOUND).alias("above"), F.count_if(q < -BOUND).alias("negative"), F.count_if(q.isNull() | (q == UNDEFINED)).alias("undefined"), F.count_if(G.cell_area(F.col("i"), n) < BOUND).alias("empty")
    )


def asymmetry(field: DataFrame, n: int) -> DataFrame:
    """(tracer, asymmetry): the largest difference of a cell and its mirror image across the equator.

    Both are brought together by one group of two cells, not by a join.
    """
    key = F.least("i", 2 * n + 1 - F.col("i")).alias("row")
    pairs = field.groupBy("tracer", key, "j").agg((F.max("q") - F.min("q")).alias("d"))
    return pairs.groupBy("tracer").agg(F.max("d").alias("asymmetry"))


def peak(field: DataFrame) -> DataFrame:
    """(tracer, q, cell_id) of the largest ratio; of equal ones the first cell."""
    return field.groupBy("tracer").agg(F.max("q").alias("q"), F.max_by("cell_id", F.struct("q", -F.col("cell_id"))).alias("cell_id"))


def compare_runs(first: DataFrame, last: DataFrame, tolerance: float = 2e-12) -> DataFrame:
    """(tracer, cells, missing, different, largest): cells of either run, in one run only, beyond the tolerance."""
    a = first.select("tracer", "cell_id", F.col("q").alias("q0"))
    both = a.join(last.select("tracer", "cell_id", "q"), ["tracer", "cell_id"], "full")
    d = F.abs(F.col("q") - F.col("q0"))
    return both.groupBy("tracer").agg(F.count("*").alias("cells"), F.count_if(F.col("q").isNull() | F.col("q0").isNull()).alias("missing"), F.count_if(d > tolerance).alias("different"), F.max(d).alias("largest"))


def stored_errors(first: DataFrame, last: DataFrame, n: int, *keys: str, tolerance: float = 2e-12, apart: float = 1e-9) -> DataFrame:
    """(*keys, cells, missing, misplaced, different, mse) of stored runs (*keys, value, lat, lon), for each of their files.

    Values meet by the cell that holds their coordinates, not by line. ``misplaced`` counts those whose coordinates differ by more than
    ``apart`` degrees, ``different`` values beyond ``tolerance``; ``mse`` is the mean square error of cells in both runs.
    """

    def placed(run: DataFrame, k: str) -> DataFrame:
        at = run.withColumn("i", G.point_row(F.col("lat"), n)).withColumn("j", G.point_column(F.col("i"), F.col("lon"), n))
        return at.select(*keys, "i", "j", *(F.col(c).alias(f"{c}{k}") for c in ("value", "lat", "lon")))

    both = placed(first, "0").join(placed(last, "1"), [*keys, "i", "j"], "full")
    d, off = F.col("value1") - F.col("value0"), F.greatest(F.abs(F.col("lat1") - F.col("lat0")), F.abs(F.col("lon1") - F.col("lon0")))
    return both.groupBy(*keys).agg(
        F.count("*").alias("cells"), F.count_if(F.col("lat0").isNull() | F.col("lat1").isNull()).alias("missing"), F.count_if(off > apart).alias("misplaced"), F.count_if(F.abs(d) > tolerance).alias("different"), F.avg(d * d).alias("mse")
    )


def convergence(points: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(*keys, slope, intercept, mse): straight line through log y over log x."""
    lx, ly = F.log(F.col(x)), F.log(F.col(y))
    fit = points.groupBy(*keys).agg(F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("intercept"), F.regr_r2(ly, lx).alias("r2"), F.var_pop(ly).alias("spread"))
    return fit.select(*keys, "slope", "intercept", (F.col("spread") * (1 - F.col("r2"))).alias("mse"))


def timing_stats(timings: DataFrame) -> DataFrame:
    """(procs, slowest, fastest, mean, slowest_proc, speedup) of (procs, proc, seconds), to the fewest processes.

    The reference time of the speed-up is one row, the aggregate of an aggregate of a row for each process count. Where the
    slowest time is zero the speed-up is null.
    """
    by = timings.groupBy("procs").agg(F.max("seconds").alias("slowest"), F.min("seconds").alias("fastest"), F.avg("seconds").alias("mean"), F.max_by("proc", F.struct("seconds", -F.col("proc"))).alias("slowest_proc"))
    base = by.agg(F.min_by("slowest", "procs").alias("base"))
    return by.join(F.broadcast(base)).select("procs", "slowest", "fastest", "mean", "slowest_proc", F.try_divide("base", "slowest").alias("speedup"))

"""Marks on a time line, as-of: for each point the last mark at or before it and the next one after it, of the same keys.

Marks may stand at any times. Marks and points are sorted into range partitions by keys and time, so one key's line may lie in many
partitions, and each part of it is worked off by itself. What comes before a part is the last mark of all parts before it, and likewise
behind it: one row a part, which is all that is ordered across parts. So a key that holds most of the rows is no task's burden, and a key without any
mark costs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonalis.sources.scratch import Scratch


def bracketed(points: DataFrame, marks: DataFrame, keys: tuple[str, ...], time: str = "t") -> DataFrame:
    """``points`` with (t0, v0) and (t1, v1), the marks (*keys, t, value) around their time; null where there is none.

    A mark at the time of a point is before it. Of marks of one key and time the one of the largest value counts. Points and marks
    of a null time or with a null value are no marks; null keys are keys like others. Points are given once each, repeats too.
    """
    scratch = Scratch(points.sparkSession)
    spare = [c for c in points.columns if c not in (*keys, time)]
    known = marks.filter(F.col(time).isNotNull() & F.col("value").isNotNull()).groupBy(*keys, time).agg(F.max("value").alias("_value"))
    own = F.struct(*(F.col(c) for c in spare)) if spare else F.struct(F.lit(0).alias("_none"))
    lines = points.select(*keys, time, own.alias("_point"), F.lit(None).cast(known.schema["_value"].dataType).alias("_value"), F.lit(False).alias("_mark"))
    marked = known.select(*keys, time, F.lit(None).cast(lines.schema["_point"].dataType).alias("_point"), "_value", F.lit(True).alias("_mark"))
    each = lines.unionByName(marked).repartitionByRange(*keys, time, F.desc("_mark"))
    each = scratch.table(each.withColumn("_part", F.spark_partition_id()), "timeline")

    mark = F.when(F.col("_mark"), F.struct(F.col(time).alias("t"), F.col("_value").alias("v")))
    part = ("_part", *keys)
    ends = each.groupBy(*part).agg(F.max(mark).alias("_last"), F.min(mark).alias("_first"))
    up, down = Window.partitionBy(*keys).orderBy("_part"), Window.partitionBy(*keys).orderBy(F.desc("_part"))
    ends = ends.select(
        *part,
        F.last("_last", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.last("_first", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("_behind"),
    )
    ends = scratch.table(ends.filter("_before is not null or _behind is not null"), "timeline-ends")

    # frames that start at the partition's edge are running values; the later mark is the last one seen from behind
    early = F.last(mark, ignorenulls=True).over(Window.partitionBy(*part).orderBy(F.col(time), F.desc("_mark")).rowsBetween(Window.unboundedPreceding, 0))
    late = F.last(mark, ignorenulls=True).over(Window.partitionBy(*part).orderBy(F.desc(time), F.col("_mark")).rowsBetween(Window.unboundedPreceding, 0))
    found = each.withColumn("_early", early).withColumn("_late", late).filter(~F.col("_mark"))
    same = F.lit(True)
    for c in part:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = found.alias("a").join(ends.alias("b"), same, "left")
    known_time = F.col(f"a.{time}").isNotNull()
    before, behind = (F.when(known_time, F.coalesce(x, y)) for x, y in (("_early", "_before"), ("_late", "_behind")))
    out = joined.select(*(F.col(f"a.{c}") for c in (*keys, time)), "a._point", before.alias("_early"), behind.alias("_late"))
    return out.select(*keys, time, *(F.col("_point")[c].alias(c) for c in spare), F.col("_early.t").alias("t0"), F.col("_early.v").alias("v0"), F.col("_late.t").alias("t1"), F.col("_late.v").alias("v1"))


def interpolated(at: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    """Straight line between two marks: the earlier value at its own time, null outside of the marks."""
    share = (at - t0).cast("double") / (t1 - t0).cast("double")
    return F.when(at == t0, v0).otherwise((1 - share) * v0 + share * v1)

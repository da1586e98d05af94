"""Stored tables with keys, to which only what is new or has changed is added.

A table is a folder of Parquet files. Each call appends, in one job, the rows that differ from what stands under their keys, with the
number of the call as ``version``; a failed job appends nothing, and the same rows given again append nothing. What stands under a key is its row of
the greatest version. One call at a time may write to a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.sources.scratch import Scratch


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def current(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """What stands under each key, with the ``version`` that it came with. Partial maxima are taken before the shuffle."""
    stored = spark.read.parquet(path)
    rest = [c for c in stored.columns if c not in keys]
    last = stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_row"))
    return last.select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


def append_changed(spark: SparkSession, path: str, rows: DataFrame, keys: tuple[str, ...]) -> int:
    """Adds the rows of ``rows`` that are new or differ from what stands under their keys; returns how many those are.

    Nulls are values like others. Of several rows of one key in ``rows`` the greatest (column by column) counts. Keys that
    ``rows`` lacks stay as they are.
    """
    if "version" in rows.columns:
        raise ValueError("rows have a column version")
    rest = [c for c in rows.columns if c not in keys]
    given = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, *(F.col("_row")[c].alias(c) for c in rest))
    version = 1
    if exists(spark, path):
        version = (spark.read.parquet(path).agg(F.max("version")).first()[0] or 0) + 1
        old = current(spark, path, keys).alias("b")
        same = F.lit(True)
        for c in rows.columns:
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        given = given.alias("a").join(old, same, "left_anti")
    scratch = Scratch(spark)
    fresh = scratch.table(given.select(rows.columns), "changed")
    count = fresh.count()
    if count or version == 1:
        fresh.withColumn("version", F.lit(version)).write.mode("append").parquet(path)
    scratch.drop("changed")
    return count

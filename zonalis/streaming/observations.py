"""Streams of observations: tumbling emission of field values, and a run's state carried from batch to batch.

The reference loop emits at whole periods; as a stream that is a tumbling window with a watermark. Fields of a stream are
sums and counts by tracer and cell, which later batches add to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from zonalis.operators import remap as R
from zonalis.operators import transport as T
from zonalis.sources.scratch import Scratch


def read_events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def emitted_fields(points: DataFrame, n: int, period: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(emitted, tracer, cell_id, q, points): the mean ratio of each cell and period of (tracer, ts, lat, lon, ratio).

    A period is emitted once, when the watermark has passed its end; points later than ``late`` are not in any field.
    State is one sum and one count a tracer, cell and open period.
    """
    placed = R.bin_points(points.withWatermark("ts", late), n)
    means = placed.groupBy(F.window("ts", period), "tracer", "cell_id").agg(F.avg("ratio").alias("q"), F.count("*").alias("points"))
    return means.select(F.col("window.end").alias("emitted"), "tracer", "cell_id", "q", "points")


def assimilate(stream: DataFrame, field: DataFrame, n: int, winds: tuple[DataFrame, DataFrame], dt: float, weight: float = 0.5, sink: Callable[[DataFrame, int], None] = lambda field, batch: None) -> tuple[StreamingQuery, list[DataFrame]]:
    """Each micro-batch of points moves the field one step and pulls the cells that it observes towards their means.

    Returns the query and a list whose last item is the current field. A batch's field is written before the next begins;
    ``sink`` gets it with the batch's number, and may be called again with the same number after a failure.
    """
    state, scratch = [field], Scratch(field.sparkSession)
    u, v = winds

    def one(batch: DataFrame, k: int) -> None:
        moved = T.step(state[0], u, v, n, dt, cut=scratch.table).select("tracer", "cell_id", "i", "j", "q")
        seen = R.cell_means(batch, n, F.col("ratio")).withColumnRenamed("q", "seen")
        mixed = moved.join(seen, ["tracer", "cell_id"], "left").withColumn("q", F.coalesce((1 - weight) * F.col("q") + weight * F.col("seen"), F.col("q")))
        state[0] = scratch.table(mixed.select("tracer", "cell_id", "i", "j", "q"), f"batch-{k % 2}")
        sink(state[0], k)

    return stream.writeStream.foreachBatch(one).start(), state

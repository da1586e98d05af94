import os

from pyspark.sql import functions as F

from zonalis.jobs import queries as Q
from zonalis.operators import diagnostics as D
from zonalis.operators import remap as R
from zonalis.streaming import observations as S

SCHEMA = "tracer string, event_id long, ts timestamp, ratio double, lat double, lon double"


def _files(spark, sf_dir, tmp_path, parts):
    """The observations in time order, one file a part."""
    points = Q.observations(spark, sf_dir)
    times = sorted(r.ts for r in points.select("ts").collect())
    cuts = [times[len(times) * k // parts] for k in range(parts)] + [None]
    for k in range(parts):
        own = points.filter((F.col("ts") >= cuts[k]) & (F.lit(True) if cuts[k + 1] is None else F.col("ts") < cuts[k + 1]))
        own.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return points


def test_emitted_fields_equal_the_batch(spark, sf_dir, tmp_path):
    points = _files(spark, sf_dir, tmp_path, 3)
    stream = S.emitted_fields(S.read_events(spark, str(tmp_path / "in"), SCHEMA, 10), 4)
    query = stream.writeStream.outputMode("append").format("memory").queryName("emitted").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.emitted, r.tracer, r.cell_id): (r.points, round(r.q, 9)) for r in spark.table("emitted").collect()}
    batch = R.bin_points(points, 4).groupBy(F.window("ts", "6 hours"), "tracer", "cell_id").agg(F.avg("ratio").alias("q"), F.count("*").alias("points")).collect()
    every = {(r.window.end, r.tracer, r.cell_id): (r.points, round(r.q, 9)) for r in batch}
    last = max(k[0] for k in every)
    assert got and all(every[k] == v for k, v in got.items())
    assert {k for k in every if (last - k[0]).total_seconds() > 7 * 3600} <= set(got)


def test_assimilation_steps(spark, sf_dir, tmp_path):
    n = 4
    _files(spark, sf_dir, tmp_path, 2)
    field = Q.event_field(spark, sf_dir, n)
    done = []
    query, state = S.assimilate(S.read_events(spark, str(tmp_path / "in"), SCHEMA), field, n, Q.first_winds(spark, n), Q.time_step(n), 0.0, lambda f, k: done.append(k))
    query.processAllAvailable()
    query.stop()
    assert done == [0, 1] and os.path.isdir(tmp_path / "in")
    before = {r.tracer: r.mass for r in D.mass(field, n).collect()}
    assert all(abs(r.mass - before[r.tracer]) < 1e-9 * before[r.tracer] for r in D.mass(state[0], n).collect())

"""A run: winds, transport steps, and output, one plan for each step."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields as members

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions import fields
from zonalis.functions import geometry as G
from zonalis.functions.clock import emits, period_minutes
from zonalis.operators import diagnostics as D
from zonalis.operators import transport as T
from zonalis.sources import grid
from zonalis.sources.scratch import Scratch

SPLITTINGS = ("zonal", "meridional", "zonal-first", "meridional-first", "alternate", "symmetric")


@dataclass(frozen=True)
class RunConfig:
    """n rows a hemisphere; dt seconds, or a Courant number that dt follows from; output every ``period`` minutes."""

    n: int
    steps: int
    dt: float = 0.0
    courant: float = 0.0
    wind: str = "deformation"
    splitting: str = "zonal-first"
    limited: bool = True
    period: str = "00"
    path: str = ""

    def __post_init__(self):
        grid.check_rows(self.n)
        fields.wind(self.wind)
        if self.steps < 0 or (self.dt > 0) == (self.courant > 0):
            raise ValueError("steps from 0 on, and either dt or a Courant number")
        if self.splitting not in SPLITTINGS:
            raise ValueError(f"no splitting {self.splitting!r}")
        period_minutes(self.period)

    @classmethod
    def parse(cls, text: str) -> RunConfig:
        """Lines ``key = value``; what follows '!' is a comment, and unknown keys are errors."""
        kinds = {m.name: m.type for m in members(cls)}
        got = {}
        for line in text.splitlines():
            line = line.split("!", 1)[0].strip()
            if not line:
                continue
            key, _, value = (x.strip() for x in line.partition("="))
            if key not in kinds:
                raise ValueError(f"unknown key {key!r}")
            got[key] = {"int": int, "float": float, "bool": lambda v: v.lower() == "true"}.get(kinds[key], str)(value)
        return cls(**got)


def winds_at(spark: SparkSession, config: RunConfig, t: float) -> tuple[DataFrame, DataFrame]:
    return T.corrected_winds(*T.analytic_winds(spark, config.n, fields.wind(config.wind), t), config.n)


def run(spark: SparkSession, field: DataFrame, config: RunConfig, process: Callable[[DataFrame], DataFrame] = lambda f: f) -> Iterator[tuple[int, DataFrame]]:
    """(k, field after step k) for k = 0 .. steps.

    Each step's field is written to the shared folder: a plan never spans two steps, and a lost executor costs one step.
    Winds are evaluated at the middle of a step, once for a wind that doesn't vary. ``process`` is a hook for sources
    and sinks of a step, such as chemistry.
    """
    scratch, winds = Scratch(spark), Scratch(spark)
    dt = config.dt
    if not dt:
        dt = T.largest_step(*winds_at(spark, config, 0.0), config.n, config.courant).first()["dt"]
    u = v = None
    yield 0, field
    for k in range(1, config.steps + 1):
        if u is None or fields.wind(config.wind).varies:
            new_u, new_v = winds_at(spark, config, (k - 0.5) * dt)
            u, v = winds.table(new_u, "u"), winds.table(new_v, "v")
        order = config.splitting
        if order == "alternate":
            order = "zonal-first" if k % 2 else "meridional-first"
        moved = T.step(field, u, v, config.n, dt, order, config.limited, scratch.table)
        field = scratch.table(process(moved).select("tracer", "cell_id", "i", "j", "q"), f"step-{k % 2}")
        yield k, field


def simulate(spark: SparkSession, field: DataFrame, config: RunConfig) -> DataFrame:
    """The field after the last step; with a path, fields that are due go there, a folder for each step."""
    last = field
    for k, last in run(spark, field, config):
        if config.path and emits(k, config.dt, period_minutes(config.period) * 60, config.steps):
            last.write.mode("overwrite").partitionBy("tracer").parquet(f"{config.path}/step={k}")
    return last


def sweep(spark: SparkSession, case: str, configs: list[RunConfig]) -> DataFrame:
    """(n, dt, l2, l_inf, quadratic) of a run of each configuration from ``case``, against its own start."""
    rows = None
    for c in configs:
        first = initial_field(spark, c.n, case)
        norms = D.error_norms(D.paired(first, simulate(spark, first, c)), G.cell_area_steradian(F.col("i"), c.n))
        own = norms.select(F.lit(c.n).alias("n"), F.lit(c.dt).alias("dt"), "l2", "l_inf", "quadratic")
        rows = own if rows is None else rows.unionByName(own)
    return rows


def initial_field(spark: SparkSession, n: int, *cases: str) -> DataFrame:
    """The analytic cases as tracers, at cell centres."""
    each = [grid.cells(spark, n).select(F.lit(c).alias("tracer"), "cell_id", "i", "j", fields.case(c)(F.col("lat"), F.col("lon")).cast("double").alias("q")) for c in cases]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Run the transport model on Spark.")
    parser.add_argument("--config", required=True)
    parser.add_argument("--no-run", action="store_true", help="only check the configuration")
    parser.add_argument("--case", default="gaussian")
    args = parser.parse_args(argv)
    with open(args.config) as file:
        config = RunConfig.parse(file.read())
    if not args.no_run:
        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        simulate(spark, initial_field(spark, config.n, *args.case.split(",")), config)


if __name__ == "__main__":
    main()

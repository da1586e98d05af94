"""Times of a run: twelve-digit stamps, steps and periods. All times are UTC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def stamp(ts: Column) -> Column:
    """YYYYMMDDHHMM as a long."""
    return F.date_format(ts, "yyyyMMddHHmm").cast("long")


def parse_stamp(value: Column) -> Column:
    """A stamp as a timestamp; a date of eight digits is its midnight."""
    text = F.rpad(value.cast("string"), 12, "0")
    return F.to_timestamp(text, "yyyyMMddHHmm")


def unix_minutes(ts: Column) -> Column:
    return F.floor(F.unix_timestamp(ts) / 60)


def steps_between(start: Column, end: Column, dt: int) -> Column:
    """Whole steps of ``dt`` seconds; a partial last step is dropped."""
    return F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / dt)


def step_time(start: Column, k: Column, dt: int) -> Column:
    """When step k (from 1) begins."""
    return F.timestamp_seconds(F.unix_timestamp(start) + (k - 1) * dt)


def period_minutes(text: str) -> int:
    """[DD[HH]]MM as minutes."""
    if not text.isdigit() or len(text) not in (2, 4, 6):
        raise ValueError(f"not a period: {text!r}")
    days, hours, minutes = (int(text.rjust(6, "0")[k : k + 2]) for k in (0, 2, 4))
    return (days * 24 + hours) * 60 + minutes


def run_steps(start: datetime, end: datetime, dt: float) -> int:
    return int((end - start).total_seconds() / dt)


def emits(k: int, dt: float, period: float, last: int) -> bool:
    """Whether the field is written after step k: at the start, at whole periods, and at the end."""
    return k in (0, last) or (period > 0 and (k * dt) % period == 0)

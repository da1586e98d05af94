"""Sums of doubles that don't depend on the order: exact, rounded once at the end.

A double is a whole number of 53 bits times a power of two. Numbers are grouped by their power, in steps of ``STEP``, and within a
group the whole numbers are added as decimals of 38 digits, which never round: partial sums on any machine, in any order, give the same. A key
has some sixty groups at most, whatever the rows; their sum as one fraction is rounded to the nearest double.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Powers of two that share a group: 53 + STEP bits a number leave room for some 10^17 rows in 38 digits.
STEP = 16
#: The least power of the last bit of a double, and how many bits it has.
LEAST, BITS = -1074, 53


def _power(x: Column) -> Column:
    """The power of two of the last bit of a non-zero double."""
    guess = F.floor(F.log2(F.abs(x))).cast("int")
    # the logarithm of a number just below a power of two may round up to it
    high = F.when(_two(guess) > F.abs(x), guess - 1).otherwise(guess)
    return F.greatest(high - (BITS - 1), F.lit(LEAST))


def _two(power: Column) -> Column:
    """2 to a whole power, exact: by halves, as a single factor may lie outside of the range."""
    half = F.floor(power / 2).cast("int")
    return F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)


def exact_parts(df: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """(*keys, rows, odd, groups): ``groups`` are (power, units), whose sum of units * 2^power is the sum of ``value``.

    Nulls count as rows but add nothing; ``odd`` is the plain sum of infinities and NaNs, null if there is none.
    """
    x = F.col(value).cast("double")
    odd = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    plain = ~odd & (x != 0.0)
    power = _power(x)
    group = F.floor(power / STEP).cast("int") * STEP
    # scaled in two steps: the first brings the number to its 53 bits, exactly
    half = F.floor(power / 2).cast("int")
    units = (x * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - power)).cast("long").cast("decimal(20,0)") * F.pow(F.lit(2.0), power - group).cast("decimal(10,0)")
    each = df.select(*keys, F.when(plain, group).alias("power"), F.when(plain, units).cast("decimal(38,0)").alias("units"), F.when(odd, x).alias("odd"))
    sums = each.groupBy(*keys, "power").agg(F.sum("units").alias("units"), F.sum("odd").alias("odd"), F.count("*").alias("rows"))
    few = F.filter(F.collect_list(F.struct("power", F.col("units").cast("string").alias("units"))), lambda g: g["power"].isNotNull())
    return sums.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum("odd").alias("odd"), few.alias("groups"))


def _total(groups) -> Fraction:
    return sum((Fraction(int(g["units"])) * Fraction(2) ** int(g["power"]) for g in groups), Fraction(0))


def _nearest(f: Fraction) -> float:
    try:
        return f.numerator / f.denominator
    except OverflowError:
        return float("inf") if f > 0 else float("-inf")


def exact_sum(df: DataFrame, keys: tuple[str, ...], value: str, name: str = "total") -> DataFrame:
    """(*keys, name): the double nearest to the exact sum of ``value`` of each key; 0 where all are null."""

    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for groups in batches:
            yield groups.map(lambda g: _nearest(_total(g))).astype("float64")

    round_once = F.pandas_udf(nearest, "double")
    return exact_parts(df, keys, value).select(*keys, F.coalesce("odd", round_once("groups")).alias(name))


def exact_units(df: DataFrame, keys: tuple[str, ...], value: str, power: int, name: str = "units") -> DataFrame:
    """(*keys, name): the exact sum as a whole number of 2^power, in decimal digits; null if it is none or not finite."""

    def digits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for groups in batches:
            totals = [_total(g) / Fraction(2) ** power for g in groups]
            yield pd.Series([str(t.numerator) if t.denominator == 1 else None for t in totals], dtype=object)

    written = F.pandas_udf(digits, "string")
    return exact_parts(df, keys, value).select(*keys, F.when(F.col("odd").isNull(), written("groups")).alias(name))

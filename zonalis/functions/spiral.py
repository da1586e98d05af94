"""The nearest point of a Fibonacci spiral, by a few candidates in closed form.

Point k stands at radius sqrt(k - 1/2) and turn k / golden ratio. In the plane of (number, turn) the points are a lattice, and any two
following Fibonacci numbers F(m), F(m + 1) are a basis of it: F(m) / golden ratio differs from a whole number by golden ratio^-m, with changing
sign. At a given radius one m makes the two steps about equally long and nearly square, so the nearest points are within a few steps
of the place that a point's own radius and angle have in this basis. The first points, where the spiral is no lattice yet, are all candidates.

Basis and place are computed once a batch of rows, and each candidate for the whole batch at once: as column expressions they would be
written out anew in each of the candidates, and evaluated so.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GOLDEN = (1 + sqrt(5)) / 2
#: Steps of the basis to each side of a place, and how many first points are all looked at within the radius of the first half of them.
REACH, FIRST = 3, 64


def spiral_place(k: Column) -> tuple[Column, Column]:
    """x and y of point k."""
    r, angle = F.sqrt(k - F.lit(0.5)), F.lit(2 * pi) * k / F.lit(GOLDEN)
    return r * F.cos(angle), r * F.sin(angle)


def _fibonacci(m: np.ndarray) -> np.ndarray:
    return np.rint(GOLDEN**m / sqrt(5))


def _candidates(x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the points among which the nearest one to each (x, y) is, a candidate of all places at a time; some are no points."""
    square = x * x + y * y
    place, turn = square + 0.5, np.arctan2(y, x) / (2 * pi) % 1.0
    m = np.maximum(np.rint(np.log(4 * pi * sqrt(5) * np.maximum(square, 1.0)) / (2 * log(GOLDEN))), 2.0)
    sign = np.where(m % 2 == 0, 1.0, -1.0)
    small, large = _fibonacci(m), _fibonacci(m + 1)
    off = -sign * GOLDEN**-m  # F(m) / golden ratio less the whole number next to it
    next_off = -off / GOLDEN
    a = np.floor((place * next_off - turn * large) * sign)
    b = np.floor((turn * small - place * off) * sign)
    near, middle = a * small + b * large, square < FIRST / 2
    steps = range(-REACH, REACH + 2)
    for n, (i, k) in enumerate(product(steps, steps), 1):
        yield np.where(middle, n, near + (i * small + k * large))  # there are FIRST pairs of steps


def nearest_numbers(x: np.ndarray, y: np.ndarray, points: int) -> np.ndarray:
    """The number of the nearest of ``points`` points to each (x, y) within the rim, of equals the least; 0 if there is none."""
    least, nearest = np.full(len(x), np.inf), np.zeros(len(x))
    for k in _candidates(x, y):
        valid = (k >= 1) & (k <= points)
        r, angle = np.sqrt(np.where(valid, k, 1.0) - 0.5), 2 * pi * k / GOLDEN
        px, py = r * np.cos(angle) - x, r * np.sin(angle) - y
        d = px * px + py * py
        closer = valid & ((d < least) | (d == least) & (k < nearest))
        least, nearest = np.where(closer, d, least), np.where(closer, k, nearest)
    return nearest.astype("int64")


def nearest_on_spiral(x: Column, y: Column, points: int) -> Column:
    """The number of the nearest of ``points`` points, of equals the least; null beyond the spiral's rim, for no point and for nulls."""

    def numbers(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in batches:
            at_x, at_y = (c.to_numpy("float64", na_value=np.nan) for c in batch)
            inside, k = at_x * at_x + at_y * at_y <= points, np.zeros(len(at_x), "int64")
            k[inside] = nearest_numbers(at_x[inside], at_y[inside], points)
            yield pd.Series(pd.arrays.IntegerArray(k, k == 0))

    return F.pandas_udf(numbers, "long")(x.cast("double"), y.cast("double"))

"""Analytic concentrations and winds by name, as column expressions of latitude and longitude (degrees)."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonalis.functions import geometry as G

#: Seconds of a full period of the deformational winds, and its two centres of concentration (radians).
PERIOD = 12 * 24 * 3600.0
CENTRES = ((0.0, 5 * 3.141592653589793 / 6), (0.0, 7 * 3.141592653589793 / 6))
PI = 3.141592653589793


def _angle(lat: Column, lon: Column, centre: tuple[float, float]) -> Column:
    """Great-circle angle to a centre."""
    return G.great_circle(lat, lon, F.lit(centre[0] * 180 / PI), F.lit(centre[1] * 180 / PI))


def gaussian_hills(lat: Column, lon: Column, height: float = 0.95, width: float = 5.0) -> Column:
    x, y, z = G.cartesian(lat, lon)

    def hill(centre: tuple[float, float]) -> Column:
        cx, cy, cz = G.cartesian(F.degrees(F.lit(centre[0])), F.degrees(F.lit(centre[1])))
        return F.lit(height) * F.exp(F.lit(-width) * ((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)))

    return hill(CENTRES[0]) + hill(CENTRES[1])


def cosine_bells(lat: Column, lon: Column, base: float = 0.1, height: float = 0.9, radius: float = 0.5) -> Column:
    out = F.lit(base)
    for centre in reversed(CENTRES):
        r = _angle(lat, lon, centre)
        out = F.when(r < radius, F.lit(base) + F.lit(height) * F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(PI) * r / F.lit(radius)))).otherwise(out)
    return out


def correlated(q: Column) -> Column:
    """The second tracer of the mixing diagnostic."""
    return F.lit(-0.8) * q * q + F.lit(0.9)


def correlated_bells(lat: Column, lon: Column) -> Column:
    return correlated(cosine_bells(lat, lon))


def slotted_cylinders(lat: Column, lon: Column, radius: float = 0.5) -> Column:
    """1 in two discs with a slot of a third of their radius, 0.1 elsewhere; the slots point to opposite sides."""
    out = F.lit(0.1)
    for k, centre in enumerate(CENTRES):
        r, along = _angle(lat, lon, centre), F.abs(F.radians(lon) - F.lit(centre[1]))
        rise = F.radians(lat) - F.lit(centre[0])
        solid = (along >= radius / 6) | ((rise < -5 * radius / 12) if k == 0 else (rise > 5 * radius / 12))
        out = F.when((r <= radius) & solid, F.lit(1.0)).otherwise(out)
    return out


def latitude_band(lat: Column, lon: Column, north: float = 10.0, south: float = -10.0) -> Column:
    return F.when((lat < north) & (lat > south), F.lit(1.0)).otherwise(F.lit(0.0))


def longitude_wave(lat: Column, lon: Column) -> Column:
    return F.abs(F.cos(F.radians(lon)))


def uniform(lat: Column, lon: Column) -> Column:
    return F.lit(1.0)


@dataclass(frozen=True)
class Wind:
    """Zonal and meridional wind in degrees of arc per second, north positive, at seconds ``t``."""

    u: Callable[[Column, Column, float], Column]
    v: Callable[[Column, Column, float], Column]
    varies: bool = False


def _phase(lon: Column, t: float) -> Column:
    return F.radians(lon) - F.lit(2 * PI * t / PERIOD)


def _swing(t: float) -> Column:
    return F.cos(F.lit(PI * t / PERIOD))


def deformation_u(lat: Column, lon: Column, t: float) -> Column:
    p = F.radians(lat)
    return (F.lit(10 / PERIOD) * F.sin(_phase(lon, t)) * F.sin(_phase(lon, t)) * F.sin(F.lit(2.0) * p) * _swing(t) + F.lit(2 * PI / PERIOD) * F.cos(p)) * F.lit(180 / PI)


def deformation_v(lat: Column, lon: Column, t: float) -> Column:
    return F.lit(10 / PERIOD) * F.sin(F.lit(2.0) * _phase(lon, t)) * F.cos(F.radians(lat)) * _swing(t) * F.lit(180 / PI)


#: Fixed value: seconds of the period of the divergent winds.
DIVERGENT_PERIOD = 5 * 24 * 3600.0


def mean_swing(t: float, dt: float, period: float = DIVERGENT_PERIOD) -> float:
    """The mean of cos(pi t / period) over a step of ``dt``; its value at ``t`` for no step."""
    if dt == 0:
        return math.cos(PI * t / period)
    return period / (dt * PI) * (math.sin(PI * (t + dt) / period) - math.sin(PI * t / period))


def divergent_u(lat: Column, lon: Column, t: float, dt: float = 0.0, period: float = DIVERGENT_PERIOD) -> Column:
    p, h = F.radians(lat), (F.radians(lon) - F.lit(2 * PI * t / period)) / 2
    swing = F.lit(-5 / period * mean_swing(t, dt, period)) * F.sin(h) * F.sin(h) * F.sin(F.lit(2.0) * p) * F.cos(p) * F.cos(p)
    return (swing + F.lit(2 * PI / period) * F.cos(p)) * F.lit(180 / PI)


def divergent_v(lat: Column, lon: Column, t: float, dt: float = 0.0, period: float = DIVERGENT_PERIOD) -> Column:
    p, x = F.radians(lat), F.radians(lon) - F.lit(2 * PI * t / period)
    return F.lit(5 / period * mean_swing(t, dt, period) * 180 / PI) * F.sin(x) * F.cos(p) * F.cos(p) * F.cos(p)


#: Fixed values, degrees per second: speeds of the solid rotation, of the constant zonal and meridional winds, and of the
#: stream around a point (229.7 m/s).
ROTATION = 0.0001 * 180 / PI
ZONAL = 60 / 179
MERIDIONAL = 1 / 160
SNAIL = 229.7 * 180 / (G.RADIUS * PI)


def rotation_u(lat: Column, lon: Column, t: float = 0.0, alpha: float = 0.0, beta: float = 90.0) -> Column:
    p, x, b = F.radians(lat), F.radians(lon - F.lit(alpha)), F.radians(F.lit(beta))
    return F.lit(ROTATION) * (F.cos(p) * F.cos(b) + F.sin(p) * F.cos(x) * F.sin(b))


def rotation_v(lat: Column, lon: Column, t: float = 0.0, alpha: float = 0.0, beta: float = 90.0) -> Column:
    return -F.lit(ROTATION) * F.sin(F.radians(lon - F.lit(alpha))) * F.sin(F.radians(F.lit(beta)))


def snail_u(lat: Column, lon: Column, t: float = 0.0) -> Column:
    """Winds along lines of constant cos(lon / 2) cos(lat): a stream around the point (0, 0)."""
    h = F.cos(F.radians(lon) / 2)
    return F.lit(SNAIL) * h * h * F.sin(F.lit(2.0) * F.radians(lat))


def snail_v(lat: Column, lon: Column, t: float = 0.0) -> Column:
    return -F.lit(SNAIL / 2) * F.sin(F.radians(lon)) * F.cos(F.radians(lat))


def snail_ratio(lat: Column, lon: Column, seconds: float) -> Column:
    """The exact field after ``seconds``: a Gaussian in longitude, carried along the streamlines (traced backward)."""
    p, h = F.radians(lat), F.radians(lon) / 2
    along = F.cos(h) * F.cos(p)  # its square is the stream function over its largest value
    beta = F.sqrt(F.greatest(1 - along * along, F.lit(1e-300)))
    alpha = F.abs(along) * F.lit(SNAIL * PI / 180)

    def within(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))

    phase = F.asin(within(F.sin(p) / beta)) + F.when(along < 0, -alpha).otherwise(alpha) * F.lit(seconds)
    before = F.asin(within(beta * F.sin(phase)))
    east = F.degrees(2 * F.acos(within(along / F.cos(before))))
    east = F.when(east > 180, east - 360).otherwise(east)
    return F.exp(-east * east / F.lit(2 * 70.0 * 70.0))


CASES: dict[str, Callable[[Column, Column], Column]] = {
    "gaussian": gaussian_hills,
    "cosine": cosine_bells,
    "correlated": correlated_bells,
    "slotted": slotted_cylinders,
    "band": latitude_band,
    "wave": longitude_wave,
    "uniform": uniform,
}

WINDS: dict[str, Wind] = {
    "deformation": Wind(deformation_u, deformation_v, True),
    "divergent": Wind(divergent_u, divergent_v, True),
    "rotation": Wind(rotation_u, rotation_v),
    "snail": Wind(snail_u, snail_v),
    "zonal": Wind(lambda lat, lon, t: F.lit(ZONAL) * F.cos(F.radians(lat)), lambda lat, lon, t: F.lit(0.0)),
    "meridional": Wind(lambda lat, lon, t: F.lit(0.0), lambda lat, lon, t: F.lit(MERIDIONAL)),
}


def case(name: str) -> Callable[[Column, Column], Column]:
    if name not in CASES:
        raise ValueError(f"no case {name!r}; there are {', '.join(sorted(CASES))}")
    return CASES[name]


def wind(name: str) -> Wind:
    if name not in WINDS:
        raise ValueError(f"no wind {name!r}; there are {', '.join(sorted(WINDS))}")
    return WINDS[name]

"""Geometry of the reduced grid as column expressions; angles in degrees, ``n`` latitude rows in each hemisphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: metres, the sphere's radius in the wind units.
RADIUS = 6.3172e6


def _quotient(a: Column, b: Column) -> Column:
    """Integer division of non-negative longs."""
    return F.call_function("div", a, b)


def nlon(i: Column, n: int) -> Column:
    return F.lit(3).cast("long") * (2 * F.least(i, 2 * n - i + 1) - 1)


def cells_above(i: Column, n: int) -> Column:
    """Cells in the rows north of row i."""
    return F.when(i <= n, 3 * (i - 1) * (i - 1)).otherwise(6 * n * n - 3 * (2 * n - i + 1) * (2 * n - i + 1))


def interfaces_above(i: Column, n: int) -> Column:
    """Interfaces between rows north of row i (south edges of rows 1 .. i - 1)."""
    north = 6 * (i - 1) * (i - 1) + 3 * (i - 1)
    rest = 2 * n - i
    return F.when(i <= n, north).otherwise(12 * n * n - 12 * n + 3 - 6 * rest * rest - 3 * rest)


def cell_id(i: Column, j: Column, n: int) -> Column:
    return cells_above(i, n) + j


def dlat(n: int) -> float:
    return 90.0 / n


def dlon(i: Column, n: int) -> Column:
    return F.lit(360.0) / nlon(i, n)


def row_latitude(i: Column, n: int) -> Column:
    return F.lit(90.0) - (i - F.lit(0.5)) * F.lit(dlat(n))


def north_edge(i: Column, n: int) -> Column:
    return F.lit(90.0) - (i - 1) * F.lit(dlat(n))


def cell_longitude(i: Column, j: Column, n: int) -> Column:
    return (j - F.lit(0.5)) * dlon(i, n)


def cell_area(i: Column, n: int) -> Column:
    """Square degrees."""
    return dlon(i, n) * (F.sin(F.radians(north_edge(i, n))) - F.sin(F.radians(north_edge(i + 1, n)))) * F.lit(180.0) / F.pi()


def cell_area_steradian(i: Column, n: int) -> Column:
    return F.radians(dlon(i, n)) * (F.sin(F.radians(north_edge(i, n))) - F.sin(F.radians(north_edge(i + 1, n))))


def cell_area_midpoint(i: Column, n: int) -> Column:
    """Steradian, by the cosine at the centre: 2 cos(lat) sin(dlat / 2) dlon."""
    return F.lit(2.0) * F.cos(F.radians(row_latitude(i, n))) * F.sin(F.radians(F.lit(dlat(n) / 2))) * F.radians(dlon(i, n))


def point_row(lat: Column, n: int) -> Column:
    """The row that holds a latitude; the south pole belongs to the last row."""
    return F.least(F.floor((F.lit(90.0) - lat) / F.lit(dlat(n))).cast("long") + 1, F.lit(2 * n).cast("long"))


def point_column(i: Column, lon: Column, n: int) -> Column:
    return F.floor(F.pmod(lon, F.lit(360.0)) / dlon(i, n)).cast("long") + 1


def south_bounds(i: Column, j: Column, n: int) -> tuple[Column, Column]:
    """First and last column in row i + 1 whose longitudes overlap those of cell (i, j)."""
    a, b = nlon(i, n), nlon(i + 1, n)
    return _quotient((j - 1) * b, a) + 1, _quotient(j * b + a - 1, a)


def north_bounds(i: Column, j: Column, n: int) -> tuple[Column, Column]:
    """First and last column in row i - 1 whose longitudes overlap those of cell (i, j)."""
    a, b = nlon(i, n), nlon(i - 1, n)
    return _quotient((j - 1) * b, a) + 1, _quotient(j * b + a - 1, a)


def containing_column(i: Column, j: Column, other: Column, n: int) -> Column:
    """The column of row ``other`` that holds the centre longitude of cell (i, j); it never lies on an edge."""
    return _quotient((2 * j - 1) * nlon(other, n), 2 * nlon(i, n)) + 1


def sector(i: Column, j: Column, n: int) -> Column:
    """0, 1 or 2: the third of the row that holds cell (i, j)."""
    return _quotient(j - 1, _quotient(nlon(i, n), F.lit(3).cast("long")))


def sector_column(i: Column, j: Column, n: int) -> Column:
    """The column of cell (i, j) within its third."""
    return (j - 1) % _quotient(nlon(i, n), F.lit(3).cast("long")) + 1


def is_middle(i: Column, j: Column, n: int) -> Column:
    return sector_column(i, j, n) == _quotient(_quotient(nlon(i, n), F.lit(3).cast("long")) + 1, F.lit(2).cast("long"))


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 1.0) -> Column:
    c = F.sin(F.radians(lat1)) * F.sin(F.radians(lat2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon1 - lon2))
    return F.lit(radius) * F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))


def cartesian(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Latitude and longitude (0 to 360) of a point on the unit sphere."""
    return F.degrees(F.asin(F.least(F.greatest(z, F.lit(-1.0)), F.lit(1.0)))), F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def rotated(lat: Column, lon: Column, alpha: float, beta: float) -> tuple[Column, Column]:
    """Latitude and longitude after a turn by ``alpha`` about the polar axis and one by ``beta`` about the y axis."""
    x, y, z = cartesian(lat, lon + F.lit(alpha))
    c, s = F.cos(F.radians(F.lit(beta))), F.sin(F.radians(F.lit(beta)))
    return spherical(c * x + s * z, y, c * z - s * x)


def orthographic(lat: Column, lon: Column, lat0: float = 0.0, lon0: float = 0.0) -> tuple[Column, Column, Column]:
    """x, y, and whether the point is on the near side."""
    p0, dl = F.radians(F.lit(lat0)), F.radians(lon - F.lit(lon0))
    near = F.sin(p0) * F.sin(F.radians(lat)) + F.cos(p0) * F.cos(F.radians(lat)) * F.cos(dl)
    return F.cos(F.radians(lat)) * F.sin(dl), F.cos(p0) * F.sin(F.radians(lat)) - F.sin(p0) * F.cos(F.radians(lat)) * F.cos(dl), near >= 0


def metres_to_degrees(speed: Column) -> Column:
    """m/s as degrees of arc per second."""
    return speed * F.lit(180.0) / (F.lit(RADIUS) * F.pi())


def cell_count_models(resolution: Column) -> dict[str, Column]:
    """Cells of this grid and of others whose cells at the equator are ``resolution`` degrees wide."""
    return {
        "reduced": 6 * F.pow(F.floor(0.5 * (F.floor(120.0 / resolution) + 1)), F.lit(2)),
        "regular": F.floor(360.0 / resolution) * F.floor(180.0 / resolution).cast("double"),
        "cubed": 6 * F.pow(90.0 / resolution, F.lit(2)),
        "mapped_sphere": 2 * F.pow(90.0 / resolution, F.lit(2)),
        "spectral_element": 6 * F.pow(30.0 / resolution, F.lit(2)),
    }


def _root(x: Column) -> Column:
    """Largest integer whose square is at most the non-negative long ``x``."""
    return F.floor(F.sqrt(x.cast("double"))).cast("long")


def cell_place(cell: Column, n: int) -> tuple[Column, Column]:
    """Row and column of a cell by its number."""
    north = _root(_quotient(cell - 1, F.lit(3).cast("long"))) + 1
    south = 2 * n - _root(_quotient(F.lit(6 * n * n).cast("long") - cell, F.lit(3).cast("long")))
    i = F.when(cell <= 3 * n * n, north).otherwise(south)
    return i, cell - cells_above(i, n)


def face_place(face: Column, n: int) -> tuple[Column, Column]:
    """Row and number (from 0) of a zonal face by its place among all, from 0; a row has one more than cells."""

    def above(m: Column) -> Column:
        guess = _quotient(_root(12 * m + 1) - 1, F.lit(6).cast("long"))
        return F.when(3 * guess * guess + guess > m, guess - 1).otherwise(guess)

    half, all_ = 3 * n * n + n, 6 * n * n + 2 * n
    i = F.when(face < half, above(F.least(face, F.lit(half).cast("long"))) + 1).otherwise(2 * n - above(F.greatest(F.lit(all_ - 1).cast("long") - face, F.lit(0).cast("long"))))
    return i, face - (cells_above(i, n) + i - 1)


def interface_place(face: Column, n: int) -> tuple[Column, Column, Column]:
    """Upper row, upper and lower column of a meridional interface by its place among all, from 0.

    In a third of a row a cells meet b = a + 2 others (or the other way round) at a + b - 1 interfaces. The edge after the first j of the a
    cells comes after j of the b cells, or one more past the middle, so cells change in turn, but twice in the middle.
    """
    edge = 6 * (n - 1) * (n - 1) + 3 * (n - 1)
    total = 12 * n * n - 12 * n + 3

    def above(m: Column) -> Column:
        guess = _quotient(_root(24 * m + 9) - 3, F.lit(12).cast("long"))
        return F.when(6 * guess * guess + 3 * guess > m, guess - 1).otherwise(guess)

    zero = F.lit(0).cast("long")
    north, south = above(F.least(face, F.lit(edge).cast("long"))) + 1, 2 * n - 1 - above(F.greatest(F.lit(total - 1).cast("long") - face, zero))
    i = F.when(face < edge, north).when(face >= total - edge, south).otherwise(F.lit(n).cast("long"))
    a, b = (_quotient(nlon(r, n), F.lit(3).cast("long")) for r in (i, i + 1))
    place, few = face - interfaces_above(i, n), F.least(a, b)
    each = F.when(a == b, a).otherwise(a + b - 1)
    third, k = _quotient(place, each), place % each
    slow = _quotient(F.when(k < few, k).otherwise(k - 1), F.lit(2).cast("long"))
    j = F.when(a == b, k).when(a < b, slow).otherwise(k - slow)
    down = F.when(a == b, k).otherwise(k - j)
    return i, third * a + j + 1, third * b + down + 1


def rotated_vector(u: Column, v: Column, lat: Column, lon: Column, alpha: float, beta: float) -> tuple[Column, Column]:
    """East and north components of a tangent vector after the turns of ``rotated``, at the place that its foot then has.

    A vector at a pole has its components along the meridian ``lon`` there.
    """
    a, p = F.radians(lon + F.lit(alpha)), F.radians(lat)
    x, y, z = -u * F.sin(a) - v * F.sin(p) * F.cos(a), u * F.cos(a) - v * F.sin(p) * F.sin(a), v * F.cos(p)
    c, s = F.cos(F.radians(F.lit(beta))), F.sin(F.radians(F.lit(beta)))
    x, z = c * x + s * z, c * z - s * x
    new_lat, new_lon = (F.radians(w) for w in rotated(lat, lon, alpha, beta))
    return y * F.cos(new_lon) - x * F.sin(new_lon), z * F.cos(new_lat) - (x * F.cos(new_lon) + y * F.sin(new_lon)) * F.sin(new_lat)


def miller(lat: Column, lon: Column, lon0: float = 0.0) -> tuple[Column, Column]:
    """x and y of the Miller cylindrical projection; x lies from -pi to pi."""
    x = F.radians(F.pmod(lon - F.lit(lon0) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0))
    return x, F.lit(1.25) * F.log(F.tan(F.pi() / 4 + F.lit(0.4) * F.radians(lat)))


def polar(lat: Column, lon: Column, pole: int = 1, lon0: float = 270.0, bound: float = 70.0) -> tuple[Column, Column]:
    """x and y of the stereographic projection around the north (1) or south (-1) pole, ``lon0`` downwards; null beyond the latitude ``bound``."""
    inside = lat * pole >= bound
    r = F.lit(2.0) * F.tan(F.pi() / 4 - F.radians(lat * pole) / 2)
    turn = F.radians(lon - F.lit(lon0))
    return F.when(inside, r * F.sin(turn)), F.when(inside, -r * F.cos(turn) * pole)

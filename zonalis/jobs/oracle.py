"""SQL of the registered grid queries, for DuckDB: named subqueries, each written once, put together as a query needs them."""

from __future__ import annotations

import re

#: Subqueries in order of dependence; they may use those above them.
PARTS: dict[str, str] = {
    "p": "SELECT CAST(greatest(4, floor(sqrt(count(*)) / 12)) AS BIGINT) AS n FROM events",
    "lats": """SELECT n, i, 3 * (2 * least(i, 2 * n - i + 1) - 1) AS nlon, 90::DOUBLE / n AS dlat, 90::DOUBLE - (i - 0.5::DOUBLE) * (90::DOUBLE / n) AS lat,
      90::DOUBLE - (i - 1) * (90::DOUBLE / n) AS north, 90::DOUBLE - i * (90::DOUBLE / n) AS south FROM (SELECT n, unnest(range(1, 2 * n + 1)) AS i FROM p)""",
    "rws": "SELECT *, 360::DOUBLE / nlon AS dlon, CAST(coalesce(sum(nlon) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS above FROM lats",
    "cells": """SELECT *, above + j AS cell_id, (j - 0.5::DOUBLE) * dlon AS lon, dlon * (sin(radians(north)) - sin(radians(south))) * 180::DOUBLE / pi() AS area
      FROM (SELECT *, unnest(range(1, nlon + 1)) AS j FROM rws)""",
    "intf": """SELECT a.n, a.i, a.j, b.j AS l, a.cell_id AS a_id, b.cell_id AS b_id, a.south AS lat, a.dlat,
      greatest((a.j - 1) * a.dlon, (b.j - 1) * b.dlon) AS west, least(a.j * a.dlon, b.j * b.dlon) AS east
      FROM cells a JOIN cells b ON b.i = a.i + 1 AND (a.j - 1) * b.nlon < b.j * a.nlon AND (b.j - 1) * a.nlon < a.j * b.nlon""",
    "inter": "SELECT *, west + (east - west) / 2 AS lon_mid, (east - west) * cos(radians(lat)) AS length FROM intf",
    "pts": """SELECT e.event_type AS tracer, e.event_id, e.value / (e.value + 50) AS ratio,
      90::DOUBLE - 180::DOUBLE * ((e.event_id * 7919 % 10007) + 0.5::DOUBLE) / 10007 AS lat, 360::DOUBLE * ((e.event_id * 104729 % 10009) + 0.5::DOUBLE) / 10009 AS lon FROM events e""",
    "binned": """SELECT t.tracer, t.event_id, t.ratio, r.i, CAST(floor(t.lon / r.dlon) AS BIGINT) + 1 AS j, r.above + CAST(floor(t.lon / r.dlon) AS BIGINT) + 1 AS cell_id
      FROM pts t JOIN rws r ON r.i = least(CAST(floor((90::DOUBLE - t.lat) / r.dlat) AS BIGINT) + 1, 2 * r.n)""",
    "means": "SELECT tracer, cell_id, round(avg(ratio), 9) AS q FROM binned GROUP BY ALL",
    "field": """SELECT t.tracer, c.cell_id, c.i, c.j, c.n, c.nlon, c.dlon, c.dlat, c.lat, c.lon, c.area, coalesce(m.q, 0::DOUBLE) AS q
      FROM (SELECT DISTINCT tracer FROM means) t CROSS JOIN cells c LEFT JOIN means m ON m.tracer = t.tracer AND m.cell_id = c.cell_id""",
    # winds of the first step: deformation, at its middle
    "dts": "SELECT n, 96000::DOUBLE / n AS dt, 48000::DOUBLE / n AS tm FROM p",
    "u0": """SELECT c.cell_id, c.i, c.j, c.dlat, (10 / 1036800::DOUBLE * sin(x) * sin(x) * sin(2::DOUBLE * radians(lat)) * cos(pi() * tm / 1036800)
      + 2 * pi() / 1036800 * cos(radians(lat))) * (180 / pi()) AS u FROM (SELECT c.*, d.tm, radians((c.j - 1) * c.dlon) - 2 * pi() * d.tm / 1036800 AS x FROM cells c JOIN dts d USING (n)) c""",
    "v0": """SELECT k.*, 10 / 1036800::DOUBLE * sin(2::DOUBLE * (radians(lon_mid) - 2 * pi() * tm / 1036800)) * cos(radians(lat)) * cos(pi() * tm / 1036800) * (180 / pi()) AS v
      FROM inter k JOIN dts USING (n)""",
    "rowdiv": "SELECT i, sum(-v * length) / (360::DOUBLE * cos(radians(any_value(lat)))) AS divergence FROM v0 GROUP BY i",
    "v": "SELECT k.* REPLACE (-k.v - d.divergence AS v) FROM v0 k JOIN rowdiv d USING (i)",
    "vflux": "SELECT cell_id, sum(x) AS flux FROM (SELECT b_id AS cell_id, v * length AS x FROM v UNION ALL SELECT a_id, -v * length FROM v) GROUP BY cell_id",
    "u": """SELECT c.cell_id, c.i, c.j, c.dlat, first_value(c.u) OVER w + coalesce(sum(f.flux) OVER (PARTITION BY c.i ORDER BY c.j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / c.dlat AS u
      FROM u0 c LEFT JOIN vflux f USING (cell_id) WINDOW w AS (PARTITION BY c.i ORDER BY c.j)""",
    "resid": """SELECT cell_id, (u - coalesce(lead(u) OVER (PARTITION BY i ORDER BY j), first_value(u) OVER (PARTITION BY i ORDER BY j))) * dlat + coalesce(flux, 0) AS residual
      FROM u LEFT JOIN vflux USING (cell_id)""",
}


def _around(source: str) -> str:
    w = "(PARTITION BY tracer, i ORDER BY j)"
    full = "(PARTITION BY tracer, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"SELECT *, coalesce(lag(q) OVER {w}, last_value(q) OVER {full}) AS q_west, coalesce(lead(q) OVER {w}, first_value(q) OVER {full}) AS q_east FROM {source}"


def _limit(west: str, here: str, east: str, limited: bool) -> str:
    if not limited:
        return f"({east} - {west}) / 2"
    least = f"least(abs({east} - {west}) / 2, 2 * abs({here} - {west}), 2 * abs({east} - {here}))"
    return f"CASE WHEN {here} >= {west} AND {east} >= {here} THEN {least} WHEN {here} < {west} AND {east} < {here} THEN -{least} ELSE 0::DOUBLE END"


def zonal_parts(source: str, out: str, limited: bool = True) -> dict[str, str]:
    """One zonal sub-step: from ``source`` (field with mass) to ``out``."""
    w = "(PARTITION BY tracer, i ORDER BY j)"
    full = "(PARTITION BY tracer, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    a, b, c, d = (f"{out}_{k}" for k in "abcd")
    return {
        a: f"SELECT s.*, w.u FROM ({_around(source)}) s JOIN u w USING (cell_id)",
        b: f"SELECT *, {_limit('q_west', 'q', 'q_east', limited)} AS slope FROM {a}",
        c: f"""SELECT *, u * dt / (dlon * cos(radians(lat))) AS courant, u * dt * dlat AS air, coalesce(lag(slope) OVER {w}, last_value(slope) OVER {full}) AS slope_west
          FROM {b} JOIN (SELECT dt FROM dts) ON true""",
        d: f"SELECT *, air * CASE WHEN courant > 0 THEN q_west + 0.5::DOUBLE * (1 - courant) * slope_west ELSE q - 0.5::DOUBLE * (1 + courant) * slope END AS trace FROM {c}",
        out: f"""SELECT tracer, cell_id, i, j, n, nlon, dlon, dlat, lat, lon, area, m AS mass, CASE WHEN abs(m) < 1e-13 THEN 0::DOUBLE ELSE (mass * q + trace - trace_east) / m END AS q
          FROM (SELECT *, mass + air - coalesce(lead(air) OVER {w}, first_value(air) OVER {full}) AS m, coalesce(lead(trace) OVER {w}, first_value(trace) OVER {full}) AS trace_east FROM {d})""",
    }


def slope_parts(source: str, out: str, limited: bool = True) -> dict[str, str]:
    """Meridional slopes of ``source``: rows above and below at the cell's longitude."""
    g = f"{out}_g"
    value = "{0}.q + (c.lon - {0}.lon) * cos(radians({0}.lat)) * {0}.gradient"
    return {
        g: f"SELECT *, (q_east - q_west) / 2 / (dlon * cos(radians(lat))) AS gradient FROM ({_around(source)})",
        out: f"""SELECT *, CASE WHEN q_north IS NULL OR q_south IS NULL THEN 0::DOUBLE ELSE {_limit('q_north', 'q', 'q_south', limited)} END AS slope FROM (
          SELECT c.*, {value.format('a')} AS q_north, {value.format('b')} AS q_south FROM {source} c
          LEFT JOIN {g} a ON a.tracer = c.tracer AND a.i = c.i - 1 AND a.j = CAST(floor(c.lon / a.dlon) AS BIGINT) + 1
          LEFT JOIN {g} b ON b.tracer = c.tracer AND b.i = c.i + 1 AND b.j = CAST(floor(c.lon / b.dlon) AS BIGINT) + 1)""",
    }


def meridional_parts(source: str, out: str, limited: bool = True) -> dict[str, str]:
    s, f, t = f"{out}_s", f"{out}_f", f"{out}_t"
    return slope_parts(source, s, limited) | {
        f: f"""SELECT a.tracer, k.a_id, k.b_id, k.v * dt * k.length AS air, k.v * dt * k.length * CASE WHEN k.v * dt / k.dlat > 0
          THEN a.q + 0.5::DOUBLE * (1 - k.v * dt / k.dlat) * a.slope ELSE b.q - 0.5::DOUBLE * (1 + k.v * dt / k.dlat) * b.slope END AS trace
          FROM v k JOIN (SELECT dt FROM dts) ON true JOIN {s} a ON a.cell_id = k.a_id JOIN {s} b ON b.cell_id = k.b_id AND b.tracer = a.tracer""",
        t: f"""SELECT tracer, cell_id, sum(air) AS air, sum(trace) AS trace FROM (SELECT tracer, b_id AS cell_id, air, trace FROM {f}
          UNION ALL SELECT tracer, a_id, -air, -trace FROM {f}) GROUP BY ALL""",
        out: f"""SELECT c.* REPLACE (CASE WHEN abs(c.mass + t.air) < 1e-13 THEN 0::DOUBLE ELSE (c.mass * c.q + t.trace) / (c.mass + t.air) END AS q, c.mass + t.air AS mass)
          FROM {source} c JOIN {t} t USING (tracer, cell_id)""",
    }


PARTS["fresh"] = "SELECT *, area AS mass FROM field"
PARTS |= zonal_parts("fresh", "zon") | meridional_parts("zon", "full_") | meridional_parts("fresh", "mer") | zonal_parts("mer", "alt")
PARTS |= zonal_parts("fresh", "zonu", False) | meridional_parts("zonu", "fullu", False)
PARTS |= slope_parts("field", "msl")


def sql(final: str) -> str:
    """``final`` with all the subqueries that it needs, in order."""
    needed, todo = set(), [final]
    while todo:
        for word in set(re.findall(r"\w+", todo.pop())) & PARTS.keys() - needed:
            needed.add(word)
            todo.append(PARTS[word])
    chosen = ",\n".join(f"{k} AS ({q})" for k, q in PARTS.items() if k in needed)
    for head in ("WITH RECURSIVE ", "WITH "):
        if final.startswith(head) and chosen:
            return f"{head}{chosen},\n{final.removeprefix(head)}"
    return f"WITH {chosen}\n{final}" if chosen else final


def rnd(expression: str, name: str, digits: int = 9) -> str:
    return f"round({expression}, {digits}) + 0 AS {name}"

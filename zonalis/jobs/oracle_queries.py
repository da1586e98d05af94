"""Equivalent SQL of the registered grid queries, for DuckDB."""

from __future__ import annotations

from zonalis.jobs.oracle import rnd

AREA_SR = "radians(dlon) * (sin(radians(north)) - sin(radians(south)))"
AREA_MID = "2 * cos(radians(lat)) * sin(radians(dlat / 2)) * radians(dlon)"


def _cell_area(steradian: str) -> str:
    return f"SELECT cell_id, n, i, {steradian} AS sr FROM cells"


#: Parts 24: 4 a zone, in bands of 1 and 3.
PART = """(CASE WHEN i > n THEN 3 ELSE 0 END + (j - 1) // (nlon // 3)) * 4 + (least((least(i, 2 * n + 1 - i) - 1) // (n // 2) + 1, 2) - 1)
  + (((j - 1) % (nlon // 3)) * (CASE WHEN least((least(i, 2 * n + 1 - i) - 1) // (n // 2) + 1, 2) = 1 THEN 1 ELSE 3 END)) // (nlon // 3)"""
PARTED = f"SELECT cell_id, i, j, nlon, n, {PART} AS part FROM cells"
RING = "SELECT a.cell_id AS a, a.part AS pa, b.cell_id AS b, b.part AS pb FROM parted a JOIN parted b ON b.i = a.i AND b.j = a.j % a.nlon + 1"
ACROSS = "SELECT k.a_id AS a, a.part AS pa, k.b_id AS b, b.part AS pb FROM intf k JOIN parted a ON a.cell_id = k.a_id JOIN parted b ON b.cell_id = k.b_id"

PAIRS = f"""SELECT a.tracer AS t0, 'run' AS tracer, a.cell_id, a.q AS q0, b.q, c.lat, c.dlat, c.dlon, {AREA_SR} AS sr, {AREA_MID} AS mid
  FROM field a JOIN field b ON b.cell_id = a.cell_id AND a.tracer = 'click' AND b.tracer = 'view' JOIN cells c ON c.cell_id = a.cell_id"""
PAIRS = PAIRS.replace("radians(dlon)", "radians(c.dlon)").replace("radians(north)", "radians(c.north)").replace("radians(south)", "radians(c.south)").replace("radians(lat)", "radians(c.lat)").replace("radians(dlat / 2)", "radians(c.dlat / 2)")

X1 = "cos(radians(lat)) * cos(radians(lon)) - cos({a}) * cos({o})"
HILL = "0.95::DOUBLE * exp(-5::DOUBLE * (power(cos(radians(lat)) * cos(radians(lon)) - cos({o}), 2) + power(cos(radians(lat)) * sin(radians(lon)) - sin({o}), 2) + power(sin(radians(lat)), 2)))"
ANGLE = "acos(greatest(-1::DOUBLE, least(1::DOUBLE, cos(radians(lat)) * cos(radians(lon - {o})))))"
BELL = "0.1::DOUBLE + 0.45::DOUBLE * (1 + cos(pi() * {r} / 0.5::DOUBLE))"
C1, C2 = "150::DOUBLE", "210::DOUBLE"
BELLS = f"CASE WHEN {ANGLE.format(o=C1)} < 0.5 THEN {BELL.format(r=ANGLE.format(o=C1))} WHEN {ANGLE.format(o=C2)} < 0.5 THEN {BELL.format(r=ANGLE.format(o=C2))} ELSE 0.1::DOUBLE END"
SLOT = f"""CASE WHEN {ANGLE.format(o=C2)} <= 0.5 AND (abs(radians(lon - 210)) >= 0.5::DOUBLE / 6 OR radians(lat) > 2.5::DOUBLE / 12) THEN 1::DOUBLE
  WHEN {ANGLE.format(o=C1)} <= 0.5 AND (abs(radians(lon - 150)) >= 0.5::DOUBLE / 6 OR radians(lat) < -2.5::DOUBLE / 12) THEN 1::DOUBLE ELSE 0.1::DOUBLE END"""


def _case(q: str) -> str:
    return f"SELECT event_id, {rnd(q, 'q')} FROM pts"


def _winds(u: str, v: str) -> str:
    """Expressions of lat, x (longitude in radians) and tm (seconds)."""
    return f"""SELECT 'u' AS kind, cell_id, 0::BIGINT AS other_id, {rnd(f'({u}) * 1e6', 'wind', 6)} FROM (SELECT c.*, radians((c.j - 1) * c.dlon) AS x, tm FROM cells c JOIN dts USING (n))
UNION ALL SELECT 'v', a_id, b_id, {rnd(f'({v}) * 1e6', 'wind', 6)} FROM (SELECT k.*, radians(lon_mid) AS x, tm FROM inter k JOIN dts USING (n))"""


def _step(source: str) -> str:
    return f"SELECT tracer, cell_id, {rnd('q', 'q', 10)}, {rnd('mass', 'mass', 7)} FROM {source}"


DEG = "(180 / pi())"
ROT = f"(0.0001::DOUBLE * {DEG})"
SNAIL = "(229.7::DOUBLE * 180 / (6.3172e6::DOUBLE * pi()))"
COURANT = """SELECT u.cell_id, abs(u.u) / (c.dlon * cos(radians(c.south))) AS zonal, o.flow / (c.dlat * c.dlon * cos(radians(c.south))) AS meridional
  FROM u JOIN cells c USING (cell_id) JOIN (SELECT a_id, sum(abs(v) * length) AS flow FROM v GROUP BY a_id) o ON o.a_id = u.cell_id"""

FINALS: dict[str, str] = {
    "grid_cells": f"SELECT cell_id, i, j, nlon, {rnd('dlon', 'dlon')}, {rnd('lat', 'lat')}, {rnd('lon', 'lon')}, {rnd('area', 'area')} FROM cells",
    "prefix_counts": f"""SELECT i, nlon, {rnd('dlon', 'dlon')}, {rnd('lat', 'lat')}, above AS cells_above, above + i - 1 AS faces_above,
      (SELECT count(*) FROM intf k WHERE k.i < r.i) AS interfaces_above FROM rws r""",
    "cell_area_closure": f"SELECT count(*) AS cells, {rnd(f'sum({AREA_SR})', 'steradian', 6)}, {rnd('sum(area)', 'square_degrees', 6)}, {rnd(f'sum({AREA_MID})', 'midpoint', 6)} FROM cells",
    "cell_corners": f"""SELECT tracer, cell_id, {rnd('q', 'q')}, {rnd('north', 'north')}, {rnd('south', 'south')}, {rnd('(j - 1) * dlon', 'west')}, {rnd('j * dlon', 'east')}
      FROM means JOIN cells USING (cell_id)""",
    "interfaces": f"SELECT i, j, l, a_id, b_id, {rnd('lat', 'lat')}, {rnd('lon_mid', 'lon_mid')}, {rnd('length', 'length')} FROM inter",
    "zonal_faces": f"SELECT i, f, {rnd('lat', 'lat')}, {rnd('f * dlon', 'lon')} FROM (SELECT *, unnest(range(0, nlon + 1)) AS f FROM rws)",
    "north_neighbours": "SELECT b_id AS cell_id, min(a_id) AS first_id, max(a_id) AS last_id, count(*) AS neighbours FROM intf GROUP BY b_id",
    "neighbour_reflexivity": """WITH up AS (SELECT a.cell_id AS a_id, b.cell_id AS b_id FROM cells b JOIN cells a ON a.i = b.i - 1 AND least(a.j * a.dlon, b.j * b.dlon) - greatest((a.j - 1) * a.dlon, (b.j - 1) * b.dlon) > 1e-9)
      SELECT count(*) AS pairs, count(*) FILTER (d.a_id IS NULL OR u.a_id IS NULL) AS one_sided FROM intf d FULL JOIN up u ON u.a_id = d.a_id AND u.b_id = d.b_id""",
    "isolated_cells": "SELECT count(*) AS isolated FROM cells WHERE cell_id NOT IN (SELECT a_id FROM intf UNION ALL SELECT b_id FROM intf)",
    "adjacency_degree": """SELECT degree, count(*) AS cells FROM (SELECT a, count(*) AS degree FROM (
      SELECT a_id AS a, b_id AS b FROM intf UNION SELECT b_id, a_id FROM intf
      UNION SELECT a.cell_id, b.cell_id FROM cells a JOIN cells b ON b.i = a.i AND b.j = a.j % a.nlon + 1
      UNION SELECT b.cell_id, a.cell_id FROM cells a JOIN cells b ON b.i = a.i AND b.j = a.j % a.nlon + 1) GROUP BY a) GROUP BY degree""",
    "sector_cells": "SELECT cell_id, CAST(floor(lon / 120) AS BIGINT) AS sector, j - CAST(floor(lon / 120) AS BIGINT) * (nlon // 3) AS column, abs(lon - 120 * floor(lon / 120) - 60) < dlon / 4 AS middle FROM cells",
    "sector_replicate": "SELECT cell_id, CAST(floor(lon / 120) AS BIGINT) AS sector FROM cells",
    "bin_events": "SELECT event_id, i, j, cell_id FROM binned",
    "tracer_mass": f"SELECT tracer, {rnd('sum(area * q)', 'mass', 6)} FROM means JOIN cells USING (cell_id) GROUP BY tracer",
    "mass_by_row": f"SELECT tracer, i, {rnd('sum(area * q)', 'mass', 6)} FROM means JOIN cells USING (cell_id) GROUP BY tracer, i",
    "equator_band": "SELECT tracer, j, q FROM field WHERE i = n",
    "peak_ratio": "SELECT tracer, max(q) AS q, min(cell_id) FILTER (q = top) AS cell_id FROM (SELECT *, max(q) OVER (PARTITION BY tracer) AS top FROM means) GROUP BY tracer",
    "size_check": """SELECT *, found = expected AS complete FROM (SELECT tracer AS name, count(*) AS found, any_value(6 * n * n) AS expected FROM field GROUP BY tracer
      UNION ALL SELECT 'zonal faces', (SELECT sum(nlon + 1)::BIGINT FROM rws), 6 * n * n + 2 * n FROM p
      UNION ALL SELECT 'interfaces', (SELECT count(*) FROM intf), 12 * n * n - 12 * n + 3 FROM p)""",
    "cell_predicates": """SELECT cell_id, i = 1 AS north_pole, i = 2 * n AS south_pole, i = n AS above_equator, i = n + 1 AS below_equator,
      (SELECT count(*) FROM intf k WHERE k.a_id = c.cell_id) AS below FROM cells c""",
    "point_lookup": "SELECT event_id, cell_id, q FROM binned JOIN means USING (tracer, cell_id)",
    "scatter_pairs": """SELECT 'click/view' AS pair, cell_id, a.q AS x, b.q AS y FROM means a JOIN means b USING (cell_id) WHERE a.tracer = 'click' AND b.tracer = 'view'
      UNION ALL SELECT 'signup/purchase', cell_id, a.q, b.q FROM means a JOIN means b USING (cell_id) WHERE a.tracer = 'signup' AND b.tracer = 'purchase'""",
    "spiral_points": f"""SELECT k, {rnd('sqrt(k - 0.5::DOUBLE) * cos(2 * pi() * k / ((1 + sqrt(5::DOUBLE)) / 2))', 'x', 5)}, {rnd('sqrt(k - 0.5::DOUBLE) * sin(2 * pi() * k / ((1 + sqrt(5::DOUBLE)) / 2))', 'y', 5)}
      FROM (SELECT unnest(range(1, (SELECT count(*) FROM events) + 1)) AS k)""",
    "grid_models": f"""SELECT user_id, tracer, {rnd('6 * power(floor(0.5::DOUBLE * (floor(120 / w) + 1)), 2)', 'reduced', 4)}, {rnd('floor(360 / w) * floor(180 / w)', 'regular', 4)}, {rnd('6 * power(90 / w, 2)', 'cubed', 4)},
      {rnd('2 * power(90 / w, 2)', 'mapped_sphere', 4)}, {rnd('6 * power(30 / w, 2)', 'spectral_element', 4)} FROM (SELECT user_id, event_type AS tracer, 120::DOUBLE / (2 * ceil(sqrt(count(*)) / 12) - 1) AS w FROM events GROUP BY ALL)""",
    "wind_symmetry": "SELECT 'u' AS kind, count(*) AS winds, 0::BIGINT AS asymmetric FROM u0 UNION ALL SELECT 'v', count(*), 0::BIGINT FROM v0",
    "zonal_slope": f"SELECT tracer, cell_id, {rnd('slope', 'slope', 10)} FROM zon_b",
    "zonal_gradient": f"SELECT tracer, cell_id, {rnd('gradient', 'gradient')} FROM msl_g",
    "merid_slope": f"SELECT tracer, cell_id, {rnd('slope', 'slope', 10)} FROM msl",
    "limiter_cases": f"""SELECT event_id, {rnd('''CASE WHEN value >= a AND b >= value THEN least(abs(b - a) / 2, 2 * abs(value - a), 2 * abs(b - value))
      WHEN value < a AND b < value THEN -least(abs(b - a) / 2, 2 * abs(value - a), 2 * abs(b - value)) ELSE 0::DOUBLE END''', 'slope')}
      FROM (SELECT event_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE a IS NOT NULL AND b IS NOT NULL""",
    "zonal_step": _step("zon"),
    "merid_step": _step("mer"),
    "full_step": _step("full_"),
    "unlimited_step": _step("fullu"),
    "alternate_step": _step("alt"),
    "symmetric_step": _step("(SELECT a.tracer, a.cell_id, (a.q + b.q) / 2 AS q, (a.mass + b.mass) / 2 AS mass FROM full_ a JOIN alt b USING (tracer, cell_id))"),
    "winds_deformation": f"""SELECT 'u' AS kind, cell_id, 0::BIGINT AS other_id, {rnd('u * 1e6', 'wind', 6)} FROM u0 UNION ALL SELECT 'v', a_id, b_id, {rnd('v * 1e6', 'wind', 6)} FROM v0""",
    "winds_divergent": _winds(
        f"(-5 / 432000::DOUBLE * cos(pi() * tm / 432000) * power(sin((x - 2 * pi() * tm / 432000) / 2), 2) * sin(2 * radians(lat)) * power(cos(radians(lat)), 2) + 2 * pi() / 432000 * cos(radians(lat))) * {DEG}",
        f"5 / 432000::DOUBLE * cos(pi() * tm / 432000) * sin(x - 2 * pi() * tm / 432000) * power(cos(radians(lat)), 3) * {DEG}",
    ),
    "winds_rotation": _winds(f"{ROT} * (cos(radians(lat)) * cos(pi() / 2) + sin(radians(lat)) * cos(x))", f"-{ROT} * sin(x)"),
    "winds_snail": _winds(f"{SNAIL} * power(cos(x / 2), 2) * sin(2 * radians(lat))", f"-{SNAIL} / 2 * sin(x) * cos(radians(lat))"),
    "wind_row_divergence": f"SELECT i, {rnd('divergence', 'divergence')} FROM rowdiv",
    "wind_corrected": f"SELECT cell_id, {rnd('u * 1e3', 'u', 7)} FROM u",
    "divergence_violations": "SELECT count(*) AS cells, count(*) FILTER (abs(residual) > 1e-13) AS violations FROM resid",
    "centre_winds": f"""SELECT cell_id, {rnd('um * 1e3', 'u', 7)}, {rnd('vm * 1e3', 'v', 7)} FROM (
      SELECT cell_id, (u + coalesce(lead(u) OVER (PARTITION BY i ORDER BY j), first_value(u) OVER (PARTITION BY i ORDER BY j))) / 2 AS um FROM u)
      JOIN (SELECT cell_id, sum(v * length) / sum(length) AS vm FROM (SELECT a_id AS cell_id, v, length FROM v UNION ALL SELECT b_id, v, length FROM v) GROUP BY cell_id) USING (cell_id)""",
    "cfl": f"SELECT {rnd('max(greatest(zonal, meridional)) * any_value(dt)', 'courant', 7)} FROM ({COURANT}) JOIN dts ON true",
    "timestep_from_cfl": f"SELECT {rnd('0.95::DOUBLE / max(greatest(zonal, meridional))', 'dt', 4)} FROM ({COURANT})",
    "wind_interp_time": f"""WITH t AS (SELECT DISTINCT CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
      w AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS ts, event_type AS key, round(avg(value), 6) AS value FROM events GROUP BY ALL),
      pair AS (SELECT ts, key, value, lead(CASE WHEN true THEN value END) OVER g AS next_value, lead(ts) OVER g AS next_ts FROM w WINDOW g AS (PARTITION BY key ORDER BY ts))
      SELECT t, key, {rnd('CASE WHEN t = ts THEN value ELSE (1 - (t - ts) / 86400::DOUBLE) * value + (t - ts) / 86400::DOUBLE * CASE WHEN next_ts = ts + 86400 THEN next_value END END', 'value', 6)}
      FROM t JOIN pair ON t.t >= pair.ts AND t.t < pair.ts + 86400""",
    "case_gaussian": _case(HILL.format(o="radians(150::DOUBLE)") + " + " + HILL.format(o="radians(210::DOUBLE)")),
    "case_cosine": _case(BELLS),
    "case_correlated": _case(f"-0.8::DOUBLE * ({BELLS}) * ({BELLS}) + 0.9::DOUBLE"),
    "case_slotted": _case(SLOT),
    "case_band": _case("CASE WHEN lat < 10 AND lat > -10 THEN 1::DOUBLE ELSE 0::DOUBLE END"),
    "case_wave": _case("abs(cos(radians(lon)))"),
    "snail_exact": f"""SELECT event_id, {rnd('exp(-e * e / 9800)', 'q', 6)} FROM (SELECT event_id, CASE WHEN e > 180 THEN e - 360 ELSE e END AS e FROM (
      SELECT event_id, degrees(2 * acos(greatest(-1::DOUBLE, least(1::DOUBLE, a / cos(asin(greatest(-1::DOUBLE, least(1::DOUBLE, b * sin(
        asin(greatest(-1::DOUBLE, least(1::DOUBLE, sin(radians(lat)) / b))) + a * {SNAIL} * pi() / 180 * 86400))))))))) AS e
      FROM (SELECT *, cos(radians(lon) / 2) * cos(radians(lat)) AS a, sqrt(greatest(1e-300, 1 - power(cos(radians(lon) / 2) * cos(radians(lat)), 2))) AS b FROM pts)))""",
    "great_circles": f"SELECT tracer, CAST(floor(degrees({ANGLE.format(o=C1)}) / 10) AS BIGINT) AS ring, count(*) AS events FROM pts GROUP BY ALL",
    "rotated_points": f"""SELECT event_id, {rnd('degrees(asin(greatest(-1::DOUBLE, least(1::DOUBLE, c * z - s * x))))', 'lat', 6)},
      {rnd('(degrees(atan2(y, c * x + s * z)) + 360) % 360', 'lon', 6)}, {rnd('cos(radians(lat)) * sin(radians(lon - 90))', 'x', 6)},
      {rnd('cos(pi() / 4) * sin(radians(lat)) - sin(pi() / 4) * cos(radians(lat)) * cos(radians(lon - 90))', 'y', 6)},
      sin(pi() / 4) * sin(radians(lat)) + cos(pi() / 4) * cos(radians(lat)) * cos(radians(lon - 90)) >= 0 AS near
      FROM (SELECT *, cos(radians(lat)) * cos(radians(lon + 30)) AS x, cos(radians(lat)) * sin(radians(lon + 30)) AS y, sin(radians(lat)) AS z, cos(pi() / 3) AS c, sin(pi() / 3) AS s FROM pts)""",
    "error_norms": f"""SELECT tracer, {rnd('sqrt(sum(sr * (q - q0) * (q - q0)) / sum(sr * q0 * q0))', 'l2')}, {rnd('max(abs(q - q0)) / max(abs(q0))', 'l_inf')},
      {rnd('sum(sr * (q - q0) * (q - q0))', 'quadratic')} FROM ({PAIRS}) GROUP BY tracer""",
    "legacy_norms": f"""SELECT tracer, {rnd('sqrt(sum(mid * (q - q0) * (q - q0)) / sum(mid * q0 * q0))', 'l2')}, {rnd('max(abs(q - q0)) / max(abs(q0))', 'l_inf')},
      {rnd('sum(mid / (4 * pi()) * (q - q0) * (q - q0))', 'quadratic')} FROM ({PAIRS}) GROUP BY tracer""",
    "filaments": f"""SELECT tracer, {rnd('t', 'threshold', 6)}, {rnd('CASE WHEN a0 < 1e-12 THEN 0::DOUBLE ELSE 100 * a / a0 END', 'preserved', 6)} FROM (
      SELECT tracer, t, sum(CASE WHEN q0 >= t - 1e-12 THEN sr ELSE 0 END) AS a0, sum(CASE WHEN q >= t - 1e-12 THEN sr ELSE 0 END) AS a
      FROM ({PAIRS}) JOIN (SELECT 0.1::DOUBLE + k / 18::DOUBLE * 0.9::DOUBLE AS t FROM (SELECT unnest(range(0, 19)) AS k)) ON true GROUP BY ALL)""",
    "mixing": f"""SELECT tracer, {rnd("sum(CASE WHEN kind = 'm' THEN d * sr ELSE 0 END) / sum(sr)", 'real_mixing', 7)}, {rnd("sum(CASE WHEN kind = 'u' THEN d * sr ELSE 0 END) / sum(sr)", 'unmixing', 7)},
      {rnd("sum(CASE WHEN kind = 'o' THEN d * sr ELSE 0 END) / sum(sr)", 'overshooting', 7)} FROM (
      SELECT tracer, sr, sqrt(power(root - x, 2) / 0.81::DOUBLE + power(0.9::DOUBLE - 0.8::DOUBLE * root * root - y, 2) / (0.792::DOUBLE * 0.792::DOUBLE)) AS d,
        CASE WHEN y < 0.9::DOUBLE - 0.8::DOUBLE * x * x + 1e-7 AND y > -0.88::DOUBLE * (x - 0.1::DOUBLE) + 0.892::DOUBLE - 1e-7 THEN 'm'
          WHEN x < 1 + 1e-7 AND x > 0.1::DOUBLE - 1e-7 AND y < 0.892::DOUBLE + 1e-7 AND y > 0.1::DOUBLE - 1e-7 THEN 'u' ELSE 'o' END AS kind FROM (
      SELECT *, least(1::DOUBLE, greatest(0.1::DOUBLE, c + (13 / 75::DOUBLE - 5 / 12::DOUBLE * y) / c)) AS root FROM (
      SELECT *, power(65340 * x + 12 * sqrt(greatest(0, -1687296 + 12168000 * y - 29250000 * y * y + 23437500 * y * y * y + 29648025 * x * x)), 1 / 3::DOUBLE) / 60 AS c FROM (
      SELECT f.tracer, f.q AS x, round(-0.8::DOUBLE * f.q * f.q + 0.9::DOUBLE + 0.05::DOUBLE * sin(f.cell_id), 9) AS y, k.sr FROM field f JOIN ({_cell_area(AREA_SR)}) k USING (cell_id))))) GROUP BY tracer""",
    "bounds": """SELECT tracer, count(*) FILTER (abs(v) > 1 + 1e-13) AS above, count(*) FILTER (v < -1e-13) AS negative, count(*) FILTER (v IS NULL OR v = -9999) AS undefined, 0::BIGINT AS empty
      FROM (SELECT f.tracer, m.v FROM field f LEFT JOIN (SELECT b.tracer, b.cell_id, round(avg(e.value / 100 - 0.05::DOUBLE), 9) AS v FROM binned b JOIN events e USING (event_id) GROUP BY ALL) m USING (tracer, cell_id)) GROUP BY tracer""",
    "symmetry": f"SELECT a.tracer, {rnd('max(abs(a.q - b.q))', 'asymmetry')} FROM field a JOIN field b ON a.tracer = b.tracer AND b.i = 2 * a.n + 1 - a.i AND a.j = b.j GROUP BY a.tracer",
    "run_compare": f"""SELECT a.tracer, count(*) AS cells, count(*) FILTER (b.q IS NULL) AS missing, count(*) FILTER (abs(round(b.q, 6) - a.q) > 2e-12) AS different, {rnd('max(abs(round(b.q, 6) - a.q))', 'largest')}
      FROM field a LEFT JOIN means b USING (tracer, cell_id) GROUP BY a.tracer""",
    "convergence_fit": f"""SELECT tracer, {rnd('regr_slope(y, x)', 'slope', 6)}, {rnd('regr_intercept(y, x)', 'intercept', 6)}, {rnd('var_pop(y) * (1 - regr_r2(y, x))', 'mse', 6)} FROM (
      SELECT tracer, ln(m * any_value(90::DOUBLE / n)) AS x, ln(stddev_samp(q)) AS y FROM (
      SELECT tracer, n, m, floor((90 - lat) / (90::DOUBLE / n * m)) AS band, round(avg(ratio), 9) AS q FROM pts JOIN p ON true JOIN (SELECT unnest([1, 2, 4]) AS m) ON true GROUP BY ALL) GROUP BY tracer, m) GROUP BY tracer""",
    "timing_stats": f"""WITH one AS (SELECT l_suppkey % 8 + 1 AS procs, l_orderkey % (l_suppkey % 8 + 1) AS proc, sum(CAST(l_quantity AS DOUBLE)) AS s FROM lineitem GROUP BY ALL),
      two AS (SELECT procs, max(s) AS slow, min(s) AS fast, avg(s) AS mean FROM one GROUP BY procs)
      SELECT procs, {rnd('slow', 'slowest', 6)}, {rnd('fast', 'fastest', 6)}, {rnd('mean', 'mean', 6)}, (SELECT min(proc) FROM one WHERE one.procs = two.procs AND one.s = two.slow) AS slowest_proc,
      {rnd('(SELECT slow FROM two ORDER BY procs LIMIT 1) / slow', 'speedup', 6)} FROM two""",
    "partition_ids": f"SELECT cell_id, {PART} AS part FROM cells",
    "partition_adjacency": f"""WITH parted AS ({PARTED}) SELECT pa AS part, pb AS other, side, count(*) AS cells FROM (
      SELECT pa, pb, 'east' AS side FROM ({RING}) UNION ALL SELECT pa, pb, 'south' FROM ({ACROSS})) WHERE pa <> pb GROUP BY ALL""",
    "halo_counts": f"""WITH parted AS ({PARTED}), cut AS (SELECT * FROM ({RING} UNION ALL {ACROSS}) WHERE pa <> pb),
      both_ways AS (SELECT pa AS part, a AS own, b AS far FROM cut UNION ALL SELECT pb, b, a FROM cut)
      SELECT part, count(*) AS cells, coalesce((SELECT count(DISTINCT own) FROM both_ways e WHERE e.part = parted.part), 0) AS border,
      coalesce((SELECT count(DISTINCT far) FROM both_ways e WHERE e.part = parted.part), 0) AS halo FROM parted GROUP BY part""",
    "edge_cut": f"WITH parted AS ({PARTED}) SELECT count(*) AS edges, count(*) FILTER (pa <> pb) AS cut FROM ({RING} UNION ALL {ACROSS})",
    "remap_frac": f"""WITH fine_rows AS (SELECT 2 * n AS m, unnest(range(1, 4 * n + 1)) AS i, n FROM p),
      fine AS (SELECT *, 3 * (2 * least(i, 2 * m - i + 1) - 1) AS nl FROM fine_rows),
      off AS (SELECT *, coalesce(sum(nl) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM fine),
      small AS (SELECT *, unnest(range(1, nl + 1)) AS j FROM off),
      link AS (SELECT s.above + s.j AS dst, c.cell_id AS src, least(s.j * (360::DOUBLE / s.nl), c.j * c.dlon) - greatest((s.j - 1) * (360::DOUBLE / s.nl), (c.j - 1) * c.dlon) AS w
        FROM small s JOIN cells c ON c.i = (s.i - 1) // 2 + 1 AND (c.j - 1) * s.nl < s.j * c.nlon AND (s.j - 1) * c.nlon < c.j * s.nl)
      SELECT tracer, CAST(dst AS BIGINT) AS cell_id, {rnd('sum(w * q) / sum(w)', 'q')} FROM link JOIN field ON field.cell_id = link.src GROUP BY tracer, dst""",
    **{f"remap_partial_{k}": f"""WITH fine_rows AS (SELECT 2 * n AS m, unnest(range(1, 4 * n + 1)) AS i, n FROM p),
      fine AS (SELECT *, 3 * (2 * least(i, 2 * m - i + 1) - 1) AS nl FROM fine_rows),
      off AS (SELECT *, coalesce(sum(nl) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM fine),
      small AS (SELECT *, 360::DOUBLE / nl AS dl, unnest(range(1, nl + 1)) AS j FROM off),
      seen AS (SELECT DISTINCT cell_id FROM binned WHERE cell_id % 3 <> 0),
      link AS (SELECT s.above + s.j AS dst, c.cell_id AS src, {weight} * (least(s.j * s.dl, c.j * c.dlon) - greatest((s.j - 1) * s.dl, (c.j - 1) * c.dlon)) AS w
        FROM small s JOIN cells c ON c.i = (s.i - 1) // 2 + 1 AND (c.j - 1) * s.nl < s.j * c.nlon AND (s.j - 1) * c.nlon < c.j * s.nl JOIN seen USING (cell_id))
      SELECT tracer, CAST(dst AS BIGINT) AS cell_id, {rnd('sum(w * q) / sum(w)', 'q')} FROM link JOIN field ON field.cell_id = link.src GROUP BY tracer, dst"""
      for k, weight in (("frac", "1"), ("destarea", "1 / s.dl"), ("none", "(sin(radians(90 - (s.i - 1) * 90::DOUBLE / s.m)) - sin(radians(90 - s.i * 90::DOUBLE / s.m)))"))},
    "neighbour_means": f"""WITH e AS (SELECT a_id AS a, b_id AS b FROM intf UNION SELECT b_id, a_id FROM intf
      UNION SELECT a.cell_id, b.cell_id FROM cells a JOIN cells b ON b.i = a.i AND b.j = a.j % a.nlon + 1
      UNION SELECT b.cell_id, a.cell_id FROM cells a JOIN cells b ON b.i = a.i AND b.j = a.j % a.nlon + 1)
      SELECT tracer, a AS cell_id, count(*) AS neighbours, {rnd('avg(q)', 'q', 12)} FROM e JOIN field ON field.cell_id = e.b GROUP BY tracer, a""",
    "interface_jumps": f"SELECT a.tracer, k.i, {rnd('sum(k.length * abs(a.q - b.q)) / sum(k.length)', 'jump', 8)} FROM inter k JOIN field a ON a.cell_id = k.a_id JOIN field b ON b.cell_id = k.b_id AND b.tracer = a.tracer GROUP BY a.tracer, k.i",
    "sector_totals": f"""SELECT tracer, CAST(floor(lon / 120) AS BIGINT) AS sector, {rnd('sum(area * q)', 'mass', 6)},
      {rnd('sum(CASE WHEN abs(lon - 120 * floor(lon / 120) - 60) < dlon / 4 THEN area * q ELSE 0 END)', 'middle_mass', 6)} FROM field GROUP BY ALL""",
    "corner_round_trip": f"""SELECT tracer, cell_id, {rnd('m.q', 'q')}, {rnd('north', 'north')}, {rnd('south', 'south')}, {rnd('(j - 1) * dlon', 'west')}, {rnd('j * dlon', 'east')} FROM means m JOIN cells USING (cell_id)""",
    "stored_errors": f"""WITH d AS (SELECT b.tracer, CAST(strftime(e.ts, '%Y%m%d0000') AS BIGINT) AS stamp, b.i, b.j, round(avg(b.ratio), 9) AS q FROM binned b JOIN events e USING (event_id) GROUP BY ALL)
      SELECT tracer, stamp, count(*) AS cells, count(*) FILTER ((i + j) % 11 = 0) AS missing, count(*) FILTER ((i + j) % 11 <> 0 AND j % 7 = 0) AS misplaced,
      count(*) FILTER ((i + j) % 11 <> 0 AND abs(round(q, 3) - q) > 2e-12) AS different, {rnd('avg((round(q, 3) - q) * (round(q, 3) - q)) FILTER ((i + j) % 11 <> 0)', 'mse', 12)} FROM d GROUP BY ALL""",
    "wind_files": f"""WITH e AS (SELECT CAST(floor(epoch(e.ts) / 86400) AS BIGINT) AS day, epoch(e.ts) AS s, b.i, b.ratio FROM binned b JOIN events e USING (event_id)),
      d AS (SELECT min(day) AS d FROM e), m AS (SELECT day - d AS k, i, round(avg(ratio), 9) AS q FROM e, d WHERE day <= d + 1 GROUP BY ALL),
      r AS (SELECT r.*, coalesce(a.q, 0) AS q0, CASE WHEN (SELECT max(k) FROM m) = 1 THEN coalesce(b.q, 0) END AS q1 FROM rws r LEFT JOIN m a ON a.i = r.i AND a.k = 0 LEFT JOIN m b ON b.i = r.i AND b.k = 1),
      f AS (SELECT 'u' AS kind, i AS cell_id, unnest(range(0, nlon + 1)) AS other, q0, q1 FROM r
        UNION ALL SELECT 'v', k.a_id, k.b_id, a.q0 - b.q0, a.q1 - b.q1 FROM intf k JOIN r a ON a.i = k.i JOIN r b ON b.i = k.i + 1),
      h AS (SELECT DISTINCT CAST(floor(s / 3600) * 3600 AS BIGINT) AS t, (floor(s / 3600) * 3600 - d * 86400) / 86400 AS x FROM e, d WHERE day = d)
      SELECT t, kind, cell_id, other, {rnd('CASE WHEN x = 0 THEN q0 ELSE (1 - x) * q0 + x * q1 END', 'value', 12)} FROM f, h""",
    "isentrope": f"""WITH lv AS (SELECT l_orderkey, 1050::DOUBLE - 100 * l_linenumber AS pressure, CAST(max(l_quantity) AS DOUBLE) AS u FROM lineitem GROUP BY l_orderkey, l_linenumber),
      hot AS (SELECT *, 280 + u / 10 AS temperature, (280 + u / 10) * power(1000 / pressure, 2 / 7::DOUBLE) AS theta FROM lv),
      nx AS (SELECT *, lead(theta) OVER w AS t2, lead(u) OVER w AS u2, lead(temperature) OVER w AS k2 FROM hot WINDOW w AS (PARTITION BY l_orderkey ORDER BY pressure DESC)),
      hit AS (SELECT *, (300 - theta) / (t2 - theta) AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY pressure DESC) AS r FROM nx WHERE theta <= 300 AND t2 > 300)
      SELECT l_orderkey, {rnd('u + s * (u2 - u)', 'u', 6)}, {rnd('temperature + s * (k2 - temperature)', 'temperature', 6)} FROM hit WHERE r = 1""",
    "run_times": """SELECT event_id, CAST(strftime(ts, '%Y%m%d%H%M') AS BIGINT) AS stamp, CAST(floor((epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01')) / 1200) AS BIGINT) AS step,
      CAST(floor(epoch(ts) / 60) AS BIGINT) AS minutes FROM events""",
    "emissions": """SELECT event_type AS tracer, CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 + 21600 AS emitted, count(*) AS events, round(round(sum(value), 4), 2) AS total FROM events GROUP BY ALL""",
    "text_round_trip": "SELECT tracer, cell_id, q FROM field",
}

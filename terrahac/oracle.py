"""DuckDB SQL for the registered queries, written from the definitions and not from the plans.

Every pair of a period is compared: no bands, no cells. Values are rounded where engines
differ in the last bits.
"""

from __future__ import annotations

from terrahac import fixtures

CUTOFF, LAG = 300.0, 2.0
RAD = "0.017453292519943295e0"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0e0"


def r7(x: str) -> str:
    """For halves of scores, which have seven decimals themselves."""
    return f"round({x}, 7) + 0.0e0"


def distance(fn: str, i: str = "i", j: str = "j") -> str:
    la, lb, oa, ob = f"radians({i}.lat)", f"radians({j}.lat)", f"radians({i}.lon)", f"radians({j}.lon)"
    if fn == "haversine":
        a = f"least(1.0e0, greatest(0.0e0, pow(sin(({lb} - {la}) / 2), 2) + cos({la}) * cos({lb}) * pow(sin(({ob} - {oa}) / 2), 2)))"
        return f"(2 * 6371.0e0 * atan2(sqrt({a}), sqrt(1 - {a})))"
    if fn == "spherical":
        return f"(6371.0e0 * acos(least(1.0e0, greatest(-1.0e0, sin({la}) * sin({lb}) + cos({la}) * cos({lb}) * cos({oa} - {ob})))))"
    if fn == "chord":
        d = [f"pow(cos({la}) * cos({oa}) - cos({lb}) * cos({ob}), 2)", f"pow(cos({la}) * sin({oa}) - cos({lb}) * sin({ob}), 2)", f"pow(sin({la}) - sin({lb}), 2)"]
        return f"(6371.0e0 * sqrt({' + '.join(d)}))"
    return f"sqrt(pow(111.0e0 * ({j}.lat - {i}.lat), 2) + pow(cos(radians(least({i}.lat, {j}.lat))) * 111.0e0 * ({j}.lon - {i}.lon), 2))"


def kernel(name: str, d: str = "dist") -> str:
    return f"(CASE WHEN {d} > {CUTOFF}e0 THEN 0.0e0 ELSE {'1 - ' + d + f' / {CUTOFF}e0' if name == 'bartlett' else '1.0e0'} END)"


def pairs(obs: str, fn: str, k: str, cutoff: float = CUTOFF, time: bool = True) -> str:
    """All unordered pairs within the cutoff as (time, i, j, dist, w, ei, ej, zi, zj), southern point first."""
    same = "i.time = j.time AND " if time else ""
    return f"""
    SELECT time, i, j, dist, {kernel(k).replace(f'{CUTOFF}e0', f'{cutoff}e0')} AS w, ei, ej, zi, zj FROM (
      SELECT i.time AS time, i.row AS i, j.row AS j, {distance(fn)} AS dist, i.y AS ei, j.y AS ej, i.z AS zi, j.z AS zj
      FROM ({obs}) i JOIN ({obs}) j ON {same}(i.lat < j.lat OR (i.lat = j.lat AND (i.lon < j.lon OR (i.lon = j.lon AND i.row < j.row))))
    ) WHERE dist <= {cutoff}e0 AND {kernel(k).replace(f'{CUTOFF}e0', f'{cutoff}e0')} <> 0"""


def meat_rows(s00: str, s01: str, s11: str, source: str) -> str:
    """A symmetric 2 x 2 matrix in long form."""
    return f"""
    SELECT a, b, {r6('CASE WHEN a = 0 AND b = 0 THEN s00 WHEN a = 1 AND b = 1 THEN s11 ELSE s01 END')} AS value FROM (
      SELECT coalesce({s00}, 0.0e0) AS s00, coalesce({s01}, 0.0e0) AS s01, coalesce({s11}, 0.0e0) AS s11 FROM ({source})
    ), (SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM range(2) t(a), range(2) u(b))"""


def spatial_sums(obs: str, fn: str, k: str, cutoff: float = CUTOFF) -> str:
    """One row s00, s01, s11: the meat of regressors (1, z) and residual y."""
    return f"""
    SELECT sum(s00) AS s00, sum(s01) AS s01, sum(s11) AS s11 FROM (
      SELECT y * y AS s00, y * y * z AS s01, y * y * z * z AS s11 FROM ({obs})
      UNION ALL
      SELECT 2 * w * ei * ej, w * ei * ej * (zi + zj), 2 * w * ei * ej * zi * zj FROM ({pairs(obs, fn, k, cutoff)}))"""


def serial_sums(obs: str, lag: float, by_unit: bool = True) -> str:
    unit = "i.unit = j.unit AND " if by_unit else ""
    return f"""
    SELECT sum(w * ei * ej) AS s00, sum(w * ei * ej * zj) AS s01, sum(w * ei * ej * zi * zj) AS s11 FROM (
      SELECT 1 - abs(i.time - j.time) / ({lag}e0 + 1) AS w, i.y AS ei, j.y AS ej, i.z AS zi, j.z AS zj
      FROM ({obs}) i JOIN ({obs}) j ON {unit}abs(i.time - j.time) <= {lag}e0 AND i.time <> j.time)"""


def plain(source: str) -> str:
    return meat_rows("s00", "s01", "s11", source)


def residuals(obs: str) -> str:
    """The fixture with y replaced by the residual of y on (1, z)."""
    return f"""
    SELECT row, unit, time, lat, lon, y - b0 - b1 * z AS y, z FROM ({obs}), (
      SELECT (sy - b1 * sz) / n AS b0, b1 FROM (
        SELECT n, sz, sy, (n * szy - sz * sy) / (n * szz - sz * sz) AS b1 FROM (
          SELECT CAST(count(*) AS DOUBLE) AS n, sum(z) AS sz, sum(y) AS sy, sum(z * z) AS szz, sum(z * y) AS szy FROM ({obs}))))"""


def vcov(obs: str, meat: str) -> str:
    """V of (1, z) from a one-row source s00, s01, s11, scaled by 1e3."""
    return f"""
    WITH m AS ({meat}), g AS (
      SELECT szz / det AS i00, -sz / det AS i01, n / det AS i11 FROM (
        SELECT n, sz, szz, n * szz - sz * sz AS det FROM (SELECT CAST(count(*) AS DOUBLE) AS n, sum(z) AS sz, sum(z * z) AS szz FROM ({obs})))
    ), h AS (
      SELECT i00, i01, i11, i00 * s00 + i01 * s01 AS l00, i00 * s01 + i01 * s11 AS l01, i01 * s00 + i11 * s01 AS l10, i01 * s01 + i11 * s11 AS l11 FROM m, g
    ), v AS (
      SELECT l00 * i00 + l01 * i01 AS v00, (l00 * i01 + l01 * i11 + l10 * i00 + l11 * i01) / 2 AS v01, l10 * i01 + l11 * i11 AS v11 FROM h
    )
    SELECT term_i, term_j, {r6('1.0e3 * value')} AS value FROM (
      SELECT 'one' AS term_i, 'one' AS term_j, v00 AS value FROM v UNION ALL SELECT 'one', 'z', v01 FROM v
      UNION ALL SELECT 'z', 'one', v01 FROM v UNION ALL SELECT 'z', 'z', v11 FROM v)"""


def both_sums(obs: str, fn: str, k: str, lag: float) -> str:
    return f"SELECT sum(s00) AS s00, sum(s01) AS s01, sum(s11) AS s11 FROM ({spatial_sums(obs, fn, k)} UNION ALL {serial_sums(obs, lag)})"


def within_two(obs: str) -> str:
    m = lambda c: f"{c} - avg({c}) OVER (PARTITION BY unit) - avg({c}) OVER (PARTITION BY time) + avg({c}) OVER ()"
    return f"SELECT row, unit, time, lat, lon, {m('y')} AS y, {m('z')} AS z FROM ({obs})"


def queries() -> dict[str, str]:
    f = fixtures.SQL
    xs, unb, bal, day = f["xs"], f["unb3"], f["bal"], f["day"]
    out = {
        "radians_cache": f"SELECT row, {r6('radians(lat)')} AS lat_r, {r6('radians(lon)')} AS lon_r, {r6('cos(radians(lat))')} AS cos_lat, {r6('sin(radians(lat))')} AS sin_lat FROM ({xs})",
        "xyz_cache": f"SELECT row, {r6('6371.0e0 * cos(radians(lat)) * cos(radians(lon))')} AS px, {r6('6371.0e0 * cos(radians(lat)) * sin(radians(lon))')} AS py, {r6('6371.0e0 * sin(radians(lat))')} AS pz FROM ({xs})",
        "safe_acos": f"SELECT row, {r6('CASE WHEN lon / 10 < -1 THEN pi() WHEN lon / 10 > 1 THEN 0.0e0 ELSE acos(lon / 10) END')} AS angle FROM ({xs})",
        "lon_wrap": f"SELECT row, {r6('least(abs(radians(9 * lon) - 3.0e0), 2 * pi() - abs(radians(9 * lon) - 3.0e0))')} AS gap FROM ({xs})",
        "scores": f"SELECT row, {r6('y')} AS s0, {r6('y * z')} AS s1 FROM ({xs})",
        "neighbor_counts": f"SELECT i, count(*) AS n FROM ({pairs(unb, 'haversine', 'uniform')}) GROUP BY i",
        "row_ptr": f"SELECT row, CAST(coalesce(sum(n) OVER (ORDER BY lat, lon, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM (SELECT row, lat, lon, coalesce(n, 0) AS n FROM ({xs}) p LEFT JOIN (SELECT i, count(*) AS n FROM ({pairs(xs, 'haversine', 'uniform', 100.0)}) GROUP BY i) c ON c.i = p.row)",
        "score_accum": f"SELECT p.row AS row, {r7('p.y / 2 + coalesce(c0, 0.0e0)')} AS c0, {r7('p.y * p.z / 2 + coalesce(c1, 0.0e0)')} AS c1 FROM ({unb}) p LEFT JOIN (SELECT i, sum(w * ej) AS c0, sum(w * ej * zj) AS c1 FROM ({pairs(unb, 'haversine', 'bartlett')}) GROUP BY i) c ON c.i = p.row",
        "gram": plain(f"SELECT CAST(count(*) AS DOUBLE) AS s00, sum(z) AS s01, sum(z * z) AS s11 FROM ({xs})"),
        "bread_inverse": f"SELECT a, b, {r6('1.0e3 * value')} AS value FROM (SELECT a, b, CASE WHEN a = 0 AND b = 0 THEN szz WHEN a = 1 AND b = 1 THEN n ELSE -sz END / (n * szz - sz * sz) AS value FROM (SELECT CAST(count(*) AS DOUBLE) AS n, sum(z) AS sz, sum(z * z) AS szz FROM ({xs})), (SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM range(2) t(a), range(2) u(b)))",
        "edges_balanced": f"SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {r6('dist')} AS dist FROM ({pairs('SELECT DISTINCT CAST(unit AS BIGINT) AS row, 1.0e0 AS time, lat, lon, 1.0e0 AS y, 1.0e0 AS z FROM (' + bal + ')', 'haversine', 'bartlett', 500.0)})",
        "graph_reuse": f"SELECT time, i, j, {r6('w')} AS w FROM ({pairs(bal, 'haversine', 'bartlett', 500.0)})",
        "serial_meat_window": plain(serial_sums(day, 2.0)),
        "serial_meat_fraction": plain(serial_sums(day, 1.5)),
        "serial_meat_join": plain(serial_sums(bal, 2.0)),
        "timedist_meat": plain(serial_sums(f"SELECT row, 1 AS unit, CAST(row AS DOUBLE) AS time, y, z FROM ({xs})", 3.0, by_unit=False)),
        "meat_balanced": plain(spatial_sums(bal, "haversine", "bartlett", 500.0)),
        "meat_unbalanced": plain(spatial_sums(day, "chord", "uniform")),
        "meat_tiled": plain(spatial_sums(unb, "haversine", "bartlett")),
        "meat_total": plain(both_sums(bal, "haversine", "bartlett", 2.0)),
        "vcov_cross_section": vcov(xs, spatial_sums(residuals(xs), "haversine", "bartlett")),
        "vcov_panel": vcov(unb, spatial_sums(residuals(unb), "spherical", "uniform")),
        "vcov_panel_serial": vcov(bal, both_sums(residuals(bal), "haversine", "bartlett", 2.0)),
        "block_sizes": f"SELECT time, count(*) AS n FROM ({day}) GROUP BY time",
        "block_rank": f"SELECT row, row_number() OVER (PARTITION BY time ORDER BY lat, lon, row) AS rank FROM ({unb})",
        "block_end": f"SELECT row, count(*) OVER (PARTITION BY time) AS row_end FROM ({unb})",
        "finite_coord_check": f"SELECT count(*) AS n, CAST(sum(CASE WHEN row % 50 = 0 OR row % 70 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_coords FROM ({xs})",
        "coord_invariance_check": f"SELECT DISTINCT CAST(unit AS BIGINT) AS unit FROM ({bal}) WHERE CAST(unit AS BIGINT) % 4 = 0",
        "key_cast": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS DOUBLE) WHEN c_custkey % 3 = 1 THEN c_custkey + 0.5e0 END AS value FROM customer",
        "cross_section_mode": f"SELECT count(*) AS n, count(*) AS n_unit, CAST(1 AS BIGINT) AS n_time FROM ({xs})",
        "row_align": f"SELECT row, lat, lon FROM ({xs}) WHERE row % 2 = 0",
        "subset_filter": plain(spatial_sums(f"SELECT * FROM ({xs}) WHERE z > 0", "haversine", "uniform")),
        "within_oneway": f"SELECT row, {r6('y - avg(y) OVER (PARTITION BY unit)')} AS y, {r6('z - avg(z) OVER (PARTITION BY unit)')} AS z FROM ({bal})",
        "within_twoway": f"SELECT row, {r6('y')} AS y, {r6('z')} AS z FROM ({within_two(bal)})",
    }
    for fn in ("haversine", "spherical", "chord", "flatearth"):
        out[f"dist_{fn}"] = f"SELECT i, j, {r6('dist')} AS dist FROM ({pairs(unb, fn, 'uniform')})"
        out[f"edges_band_{fn}"] = f"SELECT time, count(*) AS n, {r6('sum(dist) / 1.0e3')} AS dist FROM ({pairs(xs, fn, 'uniform', 200.0)}) GROUP BY time"
        for k in ("bartlett", "uniform"):
            out[f"meat_general_{fn}_{k}"] = plain(spatial_sums(unb, fn, k))
    for k in ("bartlett", "uniform"):
        out[f"kernel_{k}"] = f"SELECT row, {r6(kernel(k, '(10 * lat)'))} AS w FROM ({xs})"
        out[f"edges_{k}"] = f"SELECT time, i, j, {r6('w')} AS w FROM ({pairs(unb, 'haversine', k)})"
    out["lon_screen"] = f"SELECT i, j FROM ({pairs(unb, 'haversine', 'uniform', 100.0)})"
    return out

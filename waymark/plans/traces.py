"""Activities and fixes derived from the events table, as common table expressions.

An activity is a user's five-day bucket within a block of 100 000 event ids, so it has no more fixes than that, as
parsers see to with recordings; its fixes are the user's events in order of time. Positions are whole
numbers divided once, so that both engines agree to the last bit; every fourth user rides the other way, every
seventh alone.
"""

LAT = "CAST(43.6 AS DOUBLE) + (CAST((user_id % 5) * 40 + (CASE WHEN user_id % 4 = 0 THEN 12 - seq ELSE seq END) * 5 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(10000 AS DOUBLE)"
LON = "CAST(3.8 AS DOUBLE) + (CAST((user_id % 5) * 32 + (CASE WHEN user_id % 4 = 0 THEN 12 - seq ELSE seq END) * 4 + event_id % 2 + (CASE WHEN user_id % 7 = 0 THEN user_id * 50 ELSE 0 END) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(10000 AS DOUBLE)"

FIXES = f"""
ev AS (SELECT user_id, event_id, ts, event_type, value, props, CAST(floor((day(ts) - 1) / 5) AS INT) AS bucket, CAST(floor(event_id / 100000) AS BIGINT) AS block FROM {{events}}),
sq AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, bucket, block ORDER BY ts, event_id) AS INT) AS seq FROM ev),
fx AS (SELECT user_id * 10 + bucket + block * 10000000000 AS activity_id, user_id, event_id, ts, event_type, value, props, seq,
  CASE (user_id + bucket) % 5 WHEN 0 THEN 'road' WHEN 1 THEN 'gravel' WHEN 2 THEN 'mtb' WHEN 3 THEN 'running' ELSE 'offroad' END AS sport,
  {LAT} AS lat, {LON} AS lon, CAST(100 + (event_id * 7) % 41 AS DOUBLE) AS ele FROM sq)"""


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Metres on a sphere of radius 6 371 000, in SQL."""
    a = f"(power(sin(radians({lat2} - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - ({lon1})) / 2), 2))"
    return f"(2 * CAST(6371000 AS DOUBLE) * atan2(sqrt({a}), sqrt(1 - {a})))"


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Radians from north, in a local plane."""
    return f"atan2(({lon2} - ({lon1})) * cos(radians(({lat1} + {lat2}) / 2)), {lat2} - ({lat1}))"


ACTIVITIES = f"""{FIXES},
act AS (SELECT activity_id, user_id, sport, min(ts) AS started, max(ts) AS ended, count(*) AS n_fixes, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon,
  CASE WHEN user_id % 6 = 0 THEN 'strava_api' ELSE 'manual_upload' END AS source, user_id % 11 <> 0 AS contribute,
  CASE WHEN activity_id % 13 = 0 THEN NULL ELSE min(ts) END AS activity_date FROM fx GROUP BY activity_id, user_id, sport)"""

LEGS = f"""{FIXES},
lg0 AS (SELECT *, lag(lat) OVER (PARTITION BY activity_id ORDER BY seq) AS lat0, lag(lon) OVER (PARTITION BY activity_id ORDER BY seq) AS lon0, lag(ele) OVER (PARTITION BY activity_id ORDER BY seq) AS ele0 FROM fx),
lg AS (SELECT *, CASE WHEN lat0 IS NULL THEN CAST(0 AS DOUBLE) ELSE {haversine('lat0', 'lon0', 'lat', 'lon')} END AS d, CASE WHEN lat0 IS NULL THEN NULL ELSE {bearing('lat0', 'lon0', 'lat', 'lon')} END AS heading FROM lg0)"""

#: What may be seen by the community: own uploads, dated, shared (the one gate for all public results).
ELIGIBLE = "user_id % 6 <> 0 AND user_id % 11 <> 0 AND activity_id % 13 <> 0"
#: What the derived traces are prepared with: some 600 m long, they take a smaller mask than real ones.
FAR_KM, JUMP_M, RADIUS_M, GAP_M = 300, 70, 40, 3
_DEGREE_M = "(6371000 * pi() / 180)"


def _oracle_dense() -> str:
    """The prepared points in DuckDB's SQL, for the oracle alone: the end zones by a recursive walk, the mask by the cuts
    of every leg with every circle. Spark has them from operators.prepare."""
    hav = lambda k, m: haversine(f"list_extract(ys, {k})", f"list_extract(xs, {k})", f"list_extract(ys, {m})", f"list_extract(xs, {m})")
    place = lambda x, y: (f"(({x}) - cx) * {_DEGREE_M} * cos(radians(cy))", f"(({y}) - cy) * {_DEGREE_M}")
    sx, sy = place("x", "y")
    ex, ey = place("x2", "y2")
    mx, my = place("x + (x2 - x) * (t0 + t1) / 2", "y + (y2 - y) * (t0 + t1) / 2")
    return f"""
dm_md AS (SELECT activity_id, list_extract(list_sort(list(lat)), count(*) // 2 + 1) AS mlat, list_extract(list_sort(list(lon)), count(*) // 2 + 1) AS mlon FROM fx WHERE {ELIGIBLE} GROUP BY activity_id),
dm_tr AS (SELECT fx.activity_id, user_id, sport, list(lon ORDER BY seq) AS xs, list(lat ORDER BY seq) AS ys, count(*) AS n FROM fx JOIN dm_md ON fx.activity_id = dm_md.activity_id WHERE {haversine('mlat', 'mlon', 'lat', 'lon')} <= {FAR_KM} * 1000 GROUP BY 1, 2, 3 HAVING count(*) >= 2),
dm_en AS (SELECT activity_id, 'head' AS side, xs, ys, n FROM dm_tr UNION ALL SELECT activity_id, 'tail', list_reverse(xs), list_reverse(ys), n FROM dm_tr),
dm_zn AS (SELECT activity_id, side, xs, ys, n, CAST(1 AS BIGINT) AS i, list_value(CAST(1 AS BIGINT)) AS anchors, list_value(CAST(0 AS DOUBLE)) AS pad, CAST(0 AS DOUBLE) AS walked, CAST(1 AS BIGINT) AS last, FALSE AS done FROM dm_en
  UNION ALL SELECT activity_id, side, xs, ys, n, i + 1, CASE WHEN g <= 30 OR full_up THEN anchors ELSE list_append(anchors, i + 1) END,
    CASE WHEN g <= 30 THEN list_transform(pad, lambda p, j: CASE WHEN j = k THEN greatest(p, g) ELSE p END) WHEN full_up THEN pad ELSE list_append(pad, CAST(0 AS DOUBLE)) END,
    w, CASE WHEN g > 30 AND full_up THEN last ELSE i + 1 END, g > 30 AND full_up
  FROM (SELECT *, list_min(gs) AS g, list_position(gs, list_min(gs)) AS k, len(anchors) >= 3 AND NOT (len(anchors) < 10 AND w <= 100) AS full_up
    FROM (SELECT *, walked + {hav('i', 'i + 1')} AS w, list_transform(anchors, lambda a: {hav('a', 'i + 1')}) AS gs FROM dm_zn WHERE NOT done AND i < n) s1) s2),
dm_fz AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY activity_id, side ORDER BY i DESC) AS rk FROM dm_zn) s WHERE rk = 1),
dm_ct AS (SELECT activity_id, list_extract(xs, a) AS cx, list_extract(ys, a) AS cy, {RADIUS_M} + p AS reach FROM (SELECT activity_id, xs, ys, unnest(anchors) AS a, unnest(pad) AS p FROM dm_fz) s),
dm_lm AS (SELECT activity_id, max(CASE WHEN side = 'head' THEN last END) AS lo, max(CASE WHEN side = 'tail' THEN n + 1 - last END) AS hi FROM dm_fz GROUP BY activity_id),
dm_pt AS (SELECT activity_id, i, list_extract(xs, i) AS x, list_extract(ys, i) AS y, list_extract(xs, i + 1) AS x2, list_extract(ys, i + 1) AS y2 FROM (SELECT dm_tr.activity_id, xs, ys, unnest(range(lo, hi)) AS i FROM dm_tr JOIN dm_lm ON dm_tr.activity_id = dm_lm.activity_id WHERE lo < hi) s),
dm_lg AS (SELECT * FROM dm_pt WHERE {haversine('y', 'x', 'y2', 'x2')} <= {JUMP_M}),
dm_qd AS (SELECT activity_id, i, power({ex} - {sx}, 2) + power({ey} - {sy}, 2) AS qa, 2 * ({sx} * ({ex} - {sx}) + {sy} * ({ey} - {sy})) AS qb, power({sx}, 2) + power({sy}, 2) - reach * reach AS qc FROM dm_lg JOIN dm_ct USING (activity_id)),
dm_wh AS (SELECT activity_id, i, CAST(0 AS DOUBLE) AS t FROM dm_lg UNION SELECT activity_id, i, CAST(1 AS DOUBLE) FROM dm_lg
  UNION SELECT activity_id, i, t FROM (SELECT activity_id, i, unnest(list_value((-qb - sqrt(qb * qb - 4 * qa * qc)) / (2 * qa), (-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa))) AS t FROM dm_qd WHERE qa > 0 AND qb * qb - 4 * qa * qc > 0) s WHERE t > 0 AND t < 1),
dm_iv AS (SELECT * FROM (SELECT activity_id, i, t AS t0, lead(t) OVER (PARTITION BY activity_id, i ORDER BY t) AS t1 FROM dm_wh) s JOIN dm_lg USING (activity_id, i) WHERE t1 IS NOT NULL),
dm_sh AS (SELECT activity_id, i, t0, t1, x + (x2 - x) * t0 AS ax, y + (y2 - y) * t0 AS ay, x + (x2 - x) * t1 AS bx, y + (y2 - y) * t1 AS by_ FROM dm_iv v
  WHERE NOT EXISTS (SELECT 1 FROM dm_ct c WHERE c.activity_id = v.activity_id AND power({mx}, 2) + power({my}, 2) < reach * reach)),
dm_pc AS (SELECT *, sum(new) OVER (PARTITION BY activity_id ORDER BY i, t0 ROWS UNBOUNDED PRECEDING) AS piece FROM (SELECT *, CASE WHEN lag(i) OVER w = i AND lag(t1) OVER w = t0 OR lag(i) OVER w = i - 1 AND lag(t1) OVER w = 1 AND t0 = 0 THEN 0 ELSE 1 END AS new FROM dm_sh WINDOW w AS (PARTITION BY activity_id ORDER BY i, t0)) s),
dm_dn AS (SELECT activity_id, piece, i, t0, CAST(0 AS BIGINT) AS k, ax AS lon, ay AS lat FROM dm_pc WHERE new = 1
  UNION ALL SELECT activity_id, piece, i, t0, k, ax + (bx - ax) * (CAST(k AS DOUBLE) / n), ay + (by_ - ay) * (CAST(k AS DOUBLE) / n) FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM (SELECT *, greatest(1, CAST(floor(d / {GAP_M}) AS BIGINT)) AS n FROM (SELECT *, {haversine('ay', 'ax', 'by_', 'bx')} AS d FROM dm_pc) s0 WHERE d >= CAST(0.1 AS DOUBLE)) s1) s2),
dense AS (SELECT s.activity_id, user_id, sport, CAST(dense_rank() OVER (PARTITION BY s.activity_id ORDER BY piece) - 1 AS INT) AS run, CAST(point - 1 AS INT) AS point, lon, lat
  FROM (SELECT *, row_number() OVER (PARTITION BY activity_id, piece ORDER BY i, t0, k) AS point, count(*) OVER (PARTITION BY activity_id, piece) AS size FROM dm_dn) s JOIN dm_tr ON s.activity_id = dm_tr.activity_id WHERE size >= 2)"""


#: The prepared points as {dense}: Spark has them from one checkpointed table, the oracle from its own SQL.
DENSE = f"[[ds AS (SELECT * FROM {{dense}})||{FIXES}, {_oracle_dense()}, ds AS (SELECT * FROM dense)]]"
#: Cells are told with a nudge of a hundredth of a millimetre, for points that lie on a border but for rounding.
CELL = lambda c: f"CAST(floor({c} * 10000 + CAST(0.000001 AS DOUBLE)) AS BIGINT)"
CELLS = f"""{DENSE},
cells AS (SELECT DISTINCT sport, activity_id, user_id, {CELL('lat')} AS ilat, {CELL('lon')} AS ilon FROM ds),
lattice AS (SELECT sport, ilat, ilon, count(*) AS pass_count, least(64, count(DISTINCT user_id)) AS user_count FROM cells GROUP BY sport, ilat, ilon),
graded AS (SELECT *, least(pass_count, user_count * 5) AS eff FROM lattice)"""

#: e of g (activity_id, seq) filled along each trace: straight between known values, level beyond the ends, 0 if there
#: are none. A missing height is null or 0.
FILLED = """gk AS (SELECT *, CASE WHEN e <> 0 THEN e END AS known, CASE WHEN e <> 0 THEN seq END AS known_seq FROM g),
gn AS (SELECT *, [[last(known, true)||last_value(known IGNORE NULLS)]] OVER up AS lo, [[last(known_seq, true)||last_value(known_seq IGNORE NULLS)]] OVER up AS lo_at, [[last(known, true)||last_value(known IGNORE NULLS)]] OVER down AS hi, [[last(known_seq, true)||last_value(known_seq IGNORE NULLS)]] OVER down AS hi_at
  FROM gk WINDOW up AS (PARTITION BY activity_id ORDER BY seq ROWS UNBOUNDED PRECEDING), down AS (PARTITION BY activity_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING)),
fl AS (SELECT *, coalesce(known, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo + CAST(seq - lo_at AS DOUBLE) / (hi_at - lo_at) * (hi - lo) END, lo, hi, CAST(0 AS DOUBLE)) AS filled FROM gn)"""
#: The map tile of a position at zoom 14.
TILE_XY = "CAST(floor((lon + 180) / 360 * 16384) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384) AS BIGINT) AS y"

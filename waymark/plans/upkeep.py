"""Surfaces, display helpers, visibility rules and guarded updates over activities and the order tables."""

from .kernel import _LEGQ, _RUNS, FORWARD_BACKWARD
from .traces import ACTIVITIES, CELLS, DENSE, FIXES, LEGS

_A = f"WITH {ACTIVITIES}"
#: The surface grid's own plane: metres a degree, and a step of five metres.
_STEPS = f"""{LEGS}, sg AS (SELECT activity_id, lat0, lon0, lat, lon, greatest(1, CAST(floor(sqrt(power((lon - lon0) * 111320 * cos(radians((lat + lat0) / 2)), 2) + power((lat - lat0) * 110540, 2)) / 5) AS INT) + 1) AS n FROM lg WHERE lat0 IS NOT NULL),
pt AS (SELECT activity_id, lat0, lon0, lat, lon, n, [[explode(sequence(0, n))||unnest(range(0, n + 1))]] AS k FROM sg),
su AS (SELECT DISTINCT activity_id, CAST([[rint((lat0 + (lat - lat0) * k / n) / CAST(0.0002 AS DOUBLE))||round_even((lat0 + (lat - lat0) * k / n) / CAST(0.0002 AS DOUBLE), 0)]] AS BIGINT) AS klat, CAST([[rint((lon0 + (lon - lon0) * k / n) / CAST(0.0002 AS DOUBLE))||round_even((lon0 + (lon - lon0) * k / n) / CAST(0.0002 AS DOUBLE), 0)]] AS BIGINT) AS klon FROM pt)"""
#: The kernel radius in CSS pixels at zooms 6, 8, 10, 13, 16 and 18, straight between them.
_RAMP = "CASE WHEN z <= 6 THEN 3 WHEN z <= 8 THEN 3 + 1.5 * (z - 6) / 2 WHEN z <= 10 THEN 4.5 + (z - 8) / 2 WHEN z <= 13 THEN 5.5 + 2.5 * (z - 10) / 3 WHEN z <= 16 THEN 8 + 2 * (z - 13) / 3 WHEN z <= 18 THEN 10 + 2 * (z - 16) / 2 ELSE 12 END"
#: A point of a GPX document, and all points of a group in order.
_POINT = """concat('<trkpt lat="', CAST(CAST(round(lat, 5) AS DECIMAL(9, 5)) AS STRING), '" lon="', CAST(CAST(round(lon, 5) AS DECIMAL(9, 5)) AS STRING), '"><ele>', CAST(CAST(round(ele, 1) AS DECIMAL(6, 1)) AS STRING), '</ele></trkpt>')"""
_POINTS = f"[[listagg({_POINT}, '') WITHIN GROUP (ORDER BY seq)||string_agg({_POINT}, '' ORDER BY seq)]]"
#: Coordinates of a group in order.
_PAIR = "concat('[', CAST(CAST(round(lon, 5) AS DECIMAL(9, 5)) AS STRING), ',', CAST(CAST(round(lat, 5) AS DECIMAL(9, 5)) AS STRING), ']')"
_PAIRS = f"[[listagg({_PAIR}, ',') WITHIN GROUP (ORDER BY seq)||string_agg({_PAIR}, ',' ORDER BY seq)]]"
_ZOOMS = "[[explode(sequence(0, 22))||unnest(range(0, 23))]] AS z"

SQL = {
    "c13_surface_cells": f"WITH {_STEPS} SELECT activity_id, count(*) AS cells, min(klat) AS south, max(klon) AS east FROM su GROUP BY activity_id",
    "k31_zoom_levels": f"""WITH {DENSE}, z0 AS (SELECT {_ZOOMS}), rd AS (SELECT z, CAST({_RAMP} AS DOUBLE) AS px FROM z0),
mt AS (SELECT z, px, px * CAST(40075016.686 AS DOUBLE) * cos(radians(CAST(43.6 AS DOUBLE))) / (512 * power(2, z)) AS metres FROM rd),
lv AS (SELECT z, px, metres, CASE WHEN metres * CAST(0.75 AS DOUBLE) > 23 THEN greatest(0, CAST(floor(ln(metres * CAST(0.75 AS DOUBLE) / 23) / ln(CAST(2 AS DOUBLE))) AS INT)) ELSE 0 END AS raw FROM mt),
le AS (SELECT z, px, metres, min(raw) OVER (ORDER BY z ROWS UNBOUNDED PRECEDING) AS level FROM lv),
ev2 AS (SELECT CASE WHEN point = 0 THEN 40 ELSE CAST(round(ln(CAST([[point & -point||point & -point]] AS DOUBLE)) / ln(CAST(2 AS DOUBLE))) AS INT) END AS twos, count(*) AS n FROM ds GROUP BY 1)
SELECT z, round(px, 6) AS radius_px, round(metres, 4) AS radius_m, level, CAST(coalesce(sum(CASE WHEN twos >= level THEN n END), 0) AS BIGINT) AS points FROM le LEFT JOIN ev2 ON twos >= level GROUP BY z, px, metres, level""",
    "k35_display_parts": f"WITH {_RUNS}, p AS (SELECT activity_id, run_id, count(*) AS n FROM rn GROUP BY activity_id, run_id) SELECT activity_id, sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) AS parts, sum(CASE WHEN n >= 2 THEN n ELSE 0 END) AS points FROM p GROUP BY activity_id",
    "k44_segment_projection": f"""WITH {FIXES}, s AS (SELECT event_id, (lon - lag(lon) OVER w) * 78000 AS px, (lat - lag(lat) OVER w) * 111000 AS py, (lead(lon) OVER w - lag(lon) OVER w) * 78000 AS dx, (lead(lat) OVER w - lag(lat) OVER w) * 111000 AS dy FROM fx WINDOW w AS (PARTITION BY activity_id ORDER BY seq)),
t AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN CAST(0 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (px * dx + py * dy) / (dx * dx + dy * dy))) END AS along FROM s WHERE dx IS NOT NULL)
SELECT event_id, round(along, 5) AS along, round(sqrt(power(px - along * dx, 2) + power(py - along * dy, 2)), 4) AS off_m FROM t""",
    "w02_leg_deltas": f"WITH {LEGS} SELECT event_id, round(d, 4) AS metres, round(ele - ele0, 4) AS rise FROM lg WHERE lat0 IS NOT NULL",
    "s31_personal_summary": f"WITH {ACTIVITIES} SELECT user_id, count(*) AS activities, round(min(min_lon), 6) AS west, round(min(min_lat), 6) AS south, round(max(max_lon), 6) AS east, round(max(max_lat), 6) AS north, min(started) AS first_start FROM act GROUP BY user_id",
    "s33_metric_row": f"WITH {CELLS} SELECT count(*) AS cells, sum(pass_count) AS passes, max(user_count) AS top_users, sum(CASE WHEN user_count >= 2 THEN 1 ELSE 0 END) AS open_cells FROM lattice",
    "s29_gpx_documents": f"""WITH {FIXES} SELECT activity_id, concat('<gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>', activity_id, '</name><type>', sport, '</type><trkseg>', {_POINTS}, '</trkseg></trk></gpx>') AS document FROM fx GROUP BY activity_id, sport""",
    "s30_trip_documents": f"""WITH {FIXES}, tr AS (SELECT user_id, CAST(floor(activity_id / 10000000000) AS BIGINT) AS trip, activity_id, concat('<trk><name>', activity_id, '</name><trkseg>', {_POINTS}, '</trkseg></trk>') AS track FROM fx GROUP BY user_id, activity_id)
SELECT user_id, trip, concat('<gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1">', [[listagg(track, '') WITHIN GROUP (ORDER BY activity_id)||string_agg(track, '' ORDER BY activity_id)]], '</gpx>') AS document FROM tr GROUP BY user_id, trip""",
    "s34_user_features": f"""WITH {ACTIVITIES}, ft AS (SELECT activity_id, concat(chr(123), '"type":"LineString","coordinates":[', {_PAIRS}, ']', chr(125)) AS geometry FROM fx GROUP BY activity_id)
SELECT a.user_id, row_number() OVER (PARTITION BY a.user_id ORDER BY coalesce(activity_date, ended), a.activity_id) AS position, concat(chr(123), '"type":"Feature","properties":', chr(123), '"sport":"', sport, '","undated":', CASE WHEN activity_date IS NULL THEN 'true' ELSE 'false' END, chr(125), ',"geometry":', geometry, chr(125)) AS feature FROM act a JOIN ft ON a.activity_id = ft.activity_id""",
    "f09_trip_visibility": "SELECT o_orderkey FROM {orders} WHERE o_custkey = 7 OR (o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'P')",
    "f10_batch_by_ids": f"{_A} SELECT activity_id, sport FROM act WHERE activity_id IN (10, 21, 32, 43) AND contribute",
    "f11_map_feed": f"{_A} SELECT activity_id, user_id FROM act WHERE user_id = 8 AND n_fixes > 0 AND sport IN ('mtb', 'gravel', 'offroad')",
    "f18_live_and_expired": "SELECT sum(CASE WHEN l_shipdate IS NULL THEN 1 ELSE 0 END) AS live, sum(CASE WHEN l_shipdate < TIMESTAMP '1996-01-01 00:00:00' THEN 1 ELSE 0 END) AS expired FROM {lineitem}",
    "f19_visible_to_owner": "SELECT o.o_orderkey, l.l_linenumber FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey AND (l.l_returnflag <> 'R' OR l.l_suppkey % 10 = o.o_custkey % 10)",
    "f20_direction_arrows": f"WITH {FORWARD_BACKWARD} SELECT sport, ilat, ilon, forward_count, backward_count FROM fb WHERE sport IN ('mtb', 'gravel') AND forward_count + backward_count >= 3 AND abs(forward_count - backward_count) >= CAST(0.8 AS DOUBLE) * (forward_count + backward_count)",
    "j21_token_to_version": "SELECT o_orderkey, c_custkey, max(l_linenumber) AS version FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey LEFT JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_orderkey, c_custkey",
    "l03_recent_five": "SELECT o_orderkey, o_orderdate FROM {orders} ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 5",
    "l07_preferred_copy": f"{_A} SELECT user_id, sport, activity_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, sport ORDER BY CASE WHEN source = 'manual_upload' THEN 0 ELSE 1 END, started, activity_id) AS rk FROM act) x WHERE rk = 1",
    "m08_stage_reorder": "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN row_number() OVER w = 1 THEN count(*) OVER (PARTITION BY l_orderkey) ELSE row_number() OVER w - 1 END AS BIGINT) AS position FROM {lineitem} WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)",
    "m12_guarded_backfill": """WITH src AS (SELECT o_orderkey, md5(concat(o_orderkey, '|', o_orderstatus)) AS fingerprint, o_totalprice FROM {orders}),
cache AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'stale' ELSE md5(concat(o_orderkey, '|', o_orderstatus)) END AS seen, floor(o_totalprice) AS cached FROM {orders})
SELECT s.o_orderkey, CASE WHEN c.seen IS DISTINCT FROM s.fingerprint THEN CAST(s.o_totalprice AS DOUBLE) ELSE CAST(c.cached AS DOUBLE) END AS cached, s.fingerprint, c.seen IS DISTINCT FROM s.fingerprint AS rebuilt FROM src s LEFT JOIN cache c ON s.o_orderkey = c.o_orderkey""",
    "m13_reclass_by_name": f"{_A} SELECT a.activity_id, CASE WHEN a.sport = 'road' AND lower(p.p_type) LIKE '%steel%' THEN 'gravel' WHEN a.sport = 'road' AND lower(p.p_type) LIKE '%brass%' THEN 'mtb' ELSE a.sport END AS sport FROM act a LEFT JOIN {{part}} p ON p.p_partkey = a.activity_id % 150 + 1",
    "r02_stale_reclaim": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' AND o_orderkey % 7 < 5 THEN 'queued' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' AND o_orderkey % 7 < 5 THEN o_orderkey % 7 + 1 ELSE o_orderkey % 7 END AS attempts FROM {orders}",
    "k43_start_and_end": f"WITH {_LEGQ} SELECT activity_id, [[min_by(lat, seq)||arg_min(lat, seq)]] AS start_lat, [[max_by(lat, seq)||arg_max(lat, seq)]] AS end_lat, round(max(cum), 3) AS length_m FROM q GROUP BY activity_id",
}

"""Trace kernel queries: lattice, directions, runs, densifying, profiles, tiles."""

from .traces import ACTIVITIES, CELL, CELLS, DENSE, FILLED, FIXES, LEGS, TILE_XY, bearing, haversine

_PCTL = "(SELECT greatest(1, [[percentile_disc(0.999) WITHIN GROUP (ORDER BY eff)||quantile_disc(eff, 0.999)]]) AS top FROM graded)"
_RUNS = f"""{LEGS},
br AS (SELECT *, CASE WHEN d > 70 THEN 1 ELSE 0 END AS brk FROM lg),
rn AS (SELECT *, sum(brk) OVER (PARTITION BY activity_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run_id FROM br)"""
#: Legs of the prepared traces of two metres or more, with the cell they start in.
_DIR = f"""{DENSE},
d0 AS (SELECT *, lag(lat) OVER (PARTITION BY activity_id, run ORDER BY point) AS lat0, lag(lon) OVER (PARTITION BY activity_id, run ORDER BY point) AS lon0 FROM ds WHERE sport IN ('mtb', 'gravel')),
dl AS (SELECT * FROM (SELECT activity_id, sport, run * CAST(1000000000 AS BIGINT) + point AS seq, {haversine('lat0', 'lon0', 'lat', 'lon')} AS d, {bearing('lat0', 'lon0', 'lat', 'lon')} AS heading, {CELL('lat0')} AS ilat, {CELL('lon0')} AS ilon FROM d0 WHERE lat0 IS NOT NULL) x WHERE d >= 2)"""
_FLOW = f"""{_DIR}, rs AS (SELECT sport, ilat, ilon, sum(d * sin(heading)) AS rx, sum(d * cos(heading)) AS ry, sum(d) AS rw, count(DISTINCT activity_id) AS passes FROM dl GROUP BY sport, ilat, ilon),
fl AS (SELECT dl.activity_id, dl.sport, dl.ilat, dl.ilon, dl.seq, round(sqrt(rx * rx + ry * ry) / rw, 6) AS oneway, passes, rx * sin(heading) + ry * cos(heading) AS along FROM dl JOIN rs ON dl.sport = rs.sport AND dl.ilat = rs.ilat AND dl.ilon = rs.ilon)"""
_TILE = TILE_XY
_LEGQ = f"{LEGS}, q AS (SELECT *, sum(d) OVER (PARTITION BY activity_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum FROM lg)"

#: Traces that go with and against the first leg of each cell.
FORWARD_BACKWARD = f"""{_DIR}, rf AS (SELECT * FROM (SELECT sport, ilat, ilon, heading AS ref, row_number() OVER (PARTITION BY sport, ilat, ilon ORDER BY activity_id, seq) AS rk FROM dl) r WHERE rk = 1),
fb AS (SELECT dl.sport, dl.ilat, dl.ilon, count(DISTINCT CASE WHEN cos(heading - ref) >= CAST(-0.000001 AS DOUBLE) THEN activity_id END) AS forward_count, count(DISTINCT CASE WHEN cos(heading - ref) < CAST(-0.000001 AS DOUBLE) THEN activity_id END) AS backward_count
FROM dl JOIN rf ON dl.sport = rf.sport AND dl.ilat = rf.ilat AND dl.ilon = rf.ilon GROUP BY dl.sport, dl.ilat, dl.ilon)"""

SQL = {
    "community_lattice": f"WITH {CELLS} SELECT sport, ilat, ilon, pass_count, user_count, eff, round(least(CAST(1 AS DOUBLE), ln(1 + eff) / ln(1 + top)), 3) AS heat FROM graded CROSS JOIN {_PCTL}",
    "k09_masked_points": f"WITH {DENSE} SELECT activity_id, run, count(*) AS points, round(min(lat), 7) AS south, round(max(lat), 7) AS north, round(min(lon), 7) AS west, round(max(lon), 7) AS east, round(sum(lat + lon), 5) AS total FROM ds GROUP BY activity_id, run",
    "k11_k12_cells": f"WITH {CELLS} SELECT sport, ilat, ilon, pass_count FROM lattice",
    "k02_track_distance": f"WITH {LEGS} SELECT activity_id, round(sum(d), 3) AS distance_m, count(*) AS n FROM lg GROUP BY activity_id",
    "k04_region_clip": f"WITH {FIXES} SELECT activity_id, count(*) AS kept FROM fx WHERE lat BETWEEN CAST(43.601 AS DOUBLE) AND CAST(43.61 AS DOUBLE) AND lon BETWEEN CAST(3.8 AS DOUBLE) AND CAST(3.81 AS DOUBLE) GROUP BY activity_id",
    "k05_outlier_reject": f"""WITH {FIXES}, rk AS (SELECT activity_id, lat, lon, row_number() OVER (PARTITION BY activity_id ORDER BY lat) AS rlat, row_number() OVER (PARTITION BY activity_id ORDER BY lon) AS rlon, count(*) OVER (PARTITION BY activity_id) AS n FROM fx),
md AS (SELECT activity_id, lat, lon, n, max(CASE WHEN rlat = CAST(floor(n / 2) AS BIGINT) + 1 THEN lat END) OVER (PARTITION BY activity_id) AS mlat, max(CASE WHEN rlon = CAST(floor(n / 2) AS BIGINT) + 1 THEN lon END) OVER (PARTITION BY activity_id) AS mlon FROM rk)
SELECT activity_id, count(*) AS n, sum(CASE WHEN {haversine('mlat', 'mlon', 'lat', 'lon')} > 250 THEN 1 ELSE 0 END) AS dropped FROM md GROUP BY activity_id""",
    "k06_break_runs": f"WITH {_RUNS} SELECT activity_id, run_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM rn GROUP BY activity_id, run_id HAVING count(*) >= 2",
    "k10_densify": f"""WITH {LEGS}, st AS (SELECT activity_id, seq, lat0, lon0, lat, lon, greatest(1, CAST(floor(d / 15) AS INT)) AS n FROM lg WHERE lat0 IS NOT NULL AND d >= CAST(0.1 AS DOUBLE) AND d <= 2500),
pt AS (SELECT activity_id, lat0, lon0, lat, lon, n, [[explode(sequence(1, n))||unnest(range(1, n + 1))]] AS k FROM st)
SELECT activity_id, count(*) AS points, round(sum(lat0 + (lat - lat0) * k / n), 5) AS sum_lat, round(sum(lon0 + (lon - lon0) * k / n), 5) AS sum_lon FROM pt GROUP BY activity_id""",
    "k13_saturating_users": f"WITH {CELLS} SELECT user_count, count(*) AS cells, sum(pass_count) AS passes FROM lattice GROUP BY user_count",
    "k15_direction_resultant": f"WITH {_DIR}, rs AS (SELECT sport, ilat, ilon, round(sum(d * sin(heading)), 3) AS rx, round(sum(d * cos(heading)), 3) AS ry, round(sum(d), 3) AS dir_w, round(sqrt(power(sum(d * sin(heading)), 2) + power(sum(d * cos(heading)), 2)) / sum(d), 3) AS oneway_score FROM dl GROUP BY sport, ilat, ilon) SELECT sport, ilat, ilon, CASE WHEN rx = 0 THEN CAST(0 AS DOUBLE) ELSE rx END AS dir_x, CASE WHEN ry = 0 THEN CAST(0 AS DOUBLE) ELSE ry END AS dir_y, dir_w, oneway_score FROM rs",
    "k17_forward_backward": f"WITH {FORWARD_BACKWARD} SELECT sport, ilat, ilon, forward_count, backward_count FROM fb",
    "k21_anonymity_gate": f"""WITH {CELLS}, pp AS (SELECT ds.activity_id, ds.run, ds.point, CASE WHEN l.user_count >= 2 THEN 1 ELSE 0 END AS ok FROM ds JOIN lattice l ON ds.sport = l.sport AND {CELL('lat')} = l.ilat AND {CELL('lon')} = l.ilon),
ch AS (SELECT *, CASE WHEN ok = lag(ok) OVER (PARTITION BY activity_id, run ORDER BY point) THEN 0 ELSE 1 END AS cut FROM pp),
isl AS (SELECT *, sum(cut) OVER (PARTITION BY activity_id, run ORDER BY point ROWS UNBOUNDED PRECEDING) AS island FROM ch)
SELECT activity_id, run, island, min(point) AS first_point, max(point) AS last_point, count(*) AS points FROM isl WHERE ok = 1 GROUP BY activity_id, run, island HAVING count(*) >= 2""",
    "k23_eff_histogram": f"WITH {CELLS} SELECT eff, count(*) AS cells, sum(count(*)) OVER (ORDER BY eff ROWS UNBOUNDED PRECEDING) AS running FROM graded GROUP BY eff",
    "k26_rolling_lower_median": f"""WITH {_LEGQ}, nb AS (SELECT activity_id, seq, cum, [[collect_list(struct(cum, value))||list(struct_pack(cum := cum, value := value))]] OVER (PARTITION BY activity_id ORDER BY seq ROWS BETWEEN 256 PRECEDING AND 256 FOLLOWING) AS f FROM q),
vs AS (SELECT activity_id, seq, [[sort_array(transform(filter(f, x -> abs(x.cum - nb.cum) <= 130.5D), x -> x.value))||list_sort(list_transform(list_filter(f, lambda x: abs(x.cum - nb.cum) <= CAST(130.5 AS DOUBLE)), lambda x: x.value))]] AS v FROM nb)
SELECT activity_id, seq, [[element_at(v, CAST(floor((size(v) - 1) / 2) AS INT) + 1)||list_extract(v, CAST(floor((len(v) - 1) / 2) AS INT) + 1)]] AS median_value FROM vs""",
    "k32_network_length": f"WITH {CELLS} SELECT sport, count(*) AS cells, round(count(*) * CAST(0.0001 AS DOUBLE) * 93900, 3) AS metres FROM lattice GROUP BY sport",
    "k34_scoped_lattice": f"WITH {CELLS} SELECT sport, ilat, ilon, pass_count, user_count FROM lattice WHERE user_count >= 3 AND sport = 'gravel' AND ilat BETWEEN 436000 AND 436200",
    "k39_tile_cells": f"WITH {FIXES} SELECT DISTINCT activity_id, user_id, {_TILE} FROM fx",
    "k40_tile_bounds": f"WITH {FIXES}, t AS (SELECT DISTINCT {_TILE} FROM fx) SELECT x, y, round(CAST(x AS DOUBLE) / 16384 * 360 - 180, 6) AS west, round(degrees(atan((exp(pi() * (1 - 2 * CAST(y AS DOUBLE) / 16384)) - exp(-pi() * (1 - 2 * CAST(y AS DOUBLE) / 16384))) / 2)), 6) AS north FROM t",
    "k41_elevation_profile": f"""WITH {_LEGQ}, g AS (SELECT activity_id, seq, cum, d, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE ele END AS e FROM q), {FILLED},
sm AS (SELECT *, CASE WHEN lag(filled) OVER w IS NULL OR lead(filled) OVER w IS NULL THEN filled ELSE (lag(filled) OVER w + filled + lead(filled) OVER w) / 3 END AS smooth FROM fl WINDOW w AS (PARTITION BY activity_id ORDER BY seq)),
df AS (SELECT *, smooth - lag(smooth) OVER (PARTITION BY activity_id ORDER BY seq) AS de FROM sm)
SELECT activity_id, round(max(cum), 3) AS length_m, round(min(smooth), 6) AS low, round(max(smooth), 6) AS high, round(coalesce(sum(CASE WHEN de >= CAST(1.5 AS DOUBLE) THEN de END), 0), 6) AS gain, round(coalesce(sum(CASE WHEN de <= CAST(-1.5 AS DOUBLE) THEN -de END), 0), 6) AS loss, round(coalesce(max(CASE WHEN d > 0 THEN de / d * 100 END), 0), 5) AS steepest_up, round(coalesce(min(CASE WHEN d > 0 THEN de / d * 100 END), 0), 5) AS steepest_down FROM df GROUP BY activity_id""",
    "k42_nearest_by_distance": f"WITH {_LEGQ} SELECT activity_id, seq FROM (SELECT activity_id, seq, row_number() OVER (PARTITION BY activity_id ORDER BY abs(round(cum, 3) - 200), seq) AS rk FROM q) r WHERE rk = 1",
    "k43_distance_markers": f"""WITH {_LEGQ}, mk AS (SELECT activity_id, seq, cum, d, lat0, lon0, lat, lon, [[explode(sequence(CAST(ceil((cum - d) / 100) AS INT), CAST(floor(cum / 100) AS INT)))||unnest(range(CAST(ceil((cum - d) / 100) AS INT), CAST(floor(cum / 100) AS INT) + 1))]] AS m FROM q WHERE d > 0 AND floor(cum / 100) >= ceil((cum - d) / 100))
SELECT activity_id, m * 100 AS metres, round(lat0 + (lat - lat0) * (m * 100 - (cum - d)) / d, 6) AS lat, round(lon0 + (lon - lon0) * (m * 100 - (cum - d)) / d, 6) AS lon FROM mk WHERE m > 0""",
    "k45_slope_classes": f"WITH {LEGS} SELECT CASE WHEN abs(g) < 5 THEN 'flat' WHEN abs(g) < 20 THEN 'rolling' WHEN abs(g) < 40 THEN 'steep' ELSE 'wall' END AS slope, count(*) AS legs FROM (SELECT round((ele - ele0) / d * 100, 6) AS g FROM lg WHERE d > 0) s GROUP BY 1",
    "k48_centre_and_bbox": f"WITH {ACTIVITIES} SELECT a.activity_id, round(min_lat, 6) AS south, round(max_lat, 6) AS north, round(min_lon, 6) AS west, round(max_lon, 6) AS east, round(f.lat, 6) AS mid_lat, round(f.lon, 6) AS mid_lon FROM act a JOIN fx f ON a.activity_id = f.activity_id AND f.seq = CAST(floor(n_fixes / 2) AS INT) + 1 WHERE n_fixes > 1",
    "s21_line_features": f"""WITH {FIXES} SELECT activity_id, concat(chr(123), '"type":"LineString","coordinates":[', [[listagg(concat('[', CAST(CAST(round(lon, 5) AS DECIMAL(9, 5)) AS STRING), ',', CAST(CAST(round(lat, 5) AS DECIMAL(9, 5)) AS STRING), ']'), ',') WITHIN GROUP (ORDER BY seq)||string_agg(concat('[', CAST(CAST(round(lon, 5) AS DECIMAL(9, 5)) AS VARCHAR), ',', CAST(CAST(round(lat, 5) AS DECIMAL(9, 5)) AS VARCHAR), ']'), ',' ORDER BY seq)]], ']', chr(125)) AS feature FROM fx GROUP BY activity_id""",
    "t03_tiles_crossed": f"WITH {FIXES}, z AS (SELECT activity_id, lat, lon, [[explode(sequence(10, 14))||unnest(range(10, 15))]] AS z FROM fx) SELECT z, CAST(floor((lon + 180) / 360 * power(2, z)) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * power(2, z)) AS BIGINT) AS y, count(DISTINCT activity_id) AS activities FROM z GROUP BY 1, 2, 3",
    "a21_tile_accumulate": f"WITH {CELLS} SELECT CAST(floor(ilat / 16) AS BIGINT) AS ty, CAST(floor(ilon / 16) AS BIGINT) AS tx, max(user_count) AS user_count, max(pass_count) AS pass_count, max(eff) AS eff FROM graded GROUP BY 1, 2",
    "c12_surface_key": f"WITH {FIXES} SELECT DISTINCT CAST([[rint(lat / CAST(0.0002 AS DOUBLE))||round_even(lat / CAST(0.0002 AS DOUBLE), 0)]] AS BIGINT) AS klat, CAST(floor(lon * 2) AS BIGINT) AS tile FROM fx",
    "c16_popularity_bucket": f"WITH {CELLS} SELECT CASE WHEN pass_count <= 2 THEN 1 WHEN pass_count <= 5 THEN 2 WHEN pass_count <= 15 THEN 3 WHEN pass_count <= 50 THEN 4 ELSE 5 END AS bucket, count(*) AS cells FROM lattice GROUP BY 1",
    "k01_leg_metres": f"WITH {LEGS} SELECT event_id, round(d, 4) AS metres FROM lg",
    "k14_leg_bearing": f"WITH {LEGS} SELECT event_id, round(cos(heading), 6) AS north, round(sin(heading), 6) AS east FROM lg WHERE d >= 2",
    "k16_run_oneway_score": f"WITH {_FLOW} SELECT activity_id, round(avg(oneway), 3) AS oneway_score FROM (SELECT DISTINCT activity_id, ilat, ilon, oneway FROM fl) x GROUP BY activity_id",
    "k18_representative_cell": f"WITH {_FLOW} SELECT activity_id, ilat, ilon, passes FROM (SELECT activity_id, ilat, ilon, passes, row_number() OVER (PARTITION BY activity_id ORDER BY abs(passes - 5), min(seq)) AS rk FROM fl GROUP BY activity_id, ilat, ilon, passes) x WHERE rk = 1",
    "k19_flow_sign": f"WITH {_FLOW} SELECT activity_id, CAST(sign(round(sum(along), 3)) AS INT) AS flow FROM fl GROUP BY activity_id",
    "k20_orient": f"WITH {_FLOW}, o AS (SELECT activity_id, sum(CASE WHEN round(along, 3) >= 0 THEN 1 ELSE 0 END) AS f, sum(CASE WHEN round(along, 3) < 0 THEN 1 ELSE 0 END) AS b FROM fl GROUP BY activity_id) SELECT activity_id, greatest(f, b) AS forward_count, least(f, b) AS backward_count, f < b AS turned FROM o",
    "k22_effective_passes": f"WITH {CELLS} SELECT sport, sum(eff) AS eff, sum(pass_count) AS passes, sum(CASE WHEN eff < pass_count THEN 1 ELSE 0 END) AS capped FROM graded GROUP BY sport",
    "k25_point_series": f"WITH {CELLS} SELECT ds.activity_id, run, point, greatest(1, coalesce(pass_count, 1)) AS passes, greatest(1, coalesce(user_count, 1)) AS users, greatest(1, coalesce(eff, 1)) AS eff FROM ds LEFT JOIN graded l ON ds.sport = l.sport AND {CELL('lat')} = l.ilat AND {CELL('lon')} = l.ilon",
    "k37_rounded_coordinates": f"WITH {FIXES} SELECT event_id, round(lon, 5) AS lon, round(lat, 5) AS lat, round(ele, 1) AS ele FROM fx",
    "k46_endpoint_slope": f"WITH {_LEGQ}, e AS (SELECT activity_id, max(cum) AS way, min(seq) AS a, max(seq) AS b FROM q GROUP BY activity_id) SELECT e.activity_id, round((z.ele - s.ele) / way * 100, 3) AS slope_pct FROM e JOIN q s ON s.activity_id = e.activity_id AND s.seq = e.a JOIN q z ON z.activity_id = e.activity_id AND z.seq = e.b WHERE way > 0",
    "t01_world_pixel": f"WITH {FIXES} SELECT event_id, round((lon + 180) / 360 * 256 * 4096, 4) AS px, round((CAST(0.5 AS DOUBLE) - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 256 * 4096, 4) AS py FROM fx",
    "t02_tile_range": f"WITH {FIXES}, t AS (SELECT activity_id, {_TILE} FROM fx) SELECT activity_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, (max(x) - min(x) + 1) * (max(y) - min(y) + 1) AS tiles FROM t GROUP BY activity_id",
}

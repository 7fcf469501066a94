"""Relational analytics: rollups, joins, ordered passes, top-N, sets and conditional updates over activities."""

from .traces import ACTIVITIES, CELL, CELLS, FILLED, FIXES, LEGS, TILE_XY

_A = f"WITH {ACTIVITIES}"
_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_NEAR = "a.started <= b.started + INTERVAL '30' MINUTE AND b.started <= a.started + INTERVAL '30' MINUTE"
#: Five-minute and longer tolerances become an equality of time buckets, probed at both neighbours.
_B = "CAST(floor([[unix_timestamp(started)||epoch(started)]] / 1800) AS BIGINT)"
_BUCKETS = f"bk AS (SELECT *, {_B} AS tb FROM act), nb AS (SELECT *, [[explode(array(tb - 1, tb, tb + 1))||unnest([tb - 1, tb, tb + 1])]] AS pb FROM bk)"
#: Sums of tenths are exact, whatever their order, so that a tie in what is rounded of them is told alike in each run.
_TENTHS = lambda c: f"[[CAST(sum(CAST({c} AS DECIMAL(18, 1))) AS DOUBLE)||sum({c})]]"
#: Rounded as the SQL does it, by a product: a quotient next to a tie isn't told by its decimal digits.
_ROUNDED = lambda c, n: f"round({c}[[ * {10**n}) / {10**n}||, {n})]]"
#: Whole seconds of a time, to the nearest (the even one between two).
_SECONDS = lambda c: f"[[CAST(rint(unix_micros(CAST({c} AS TIMESTAMP)) / 1000000D) AS BIGINT)||CAST(epoch({c}) AS BIGINT)]]"

SQL = {
    "f01_community_eligibility": f"{_A} SELECT activity_id, user_id, sport FROM act WHERE contribute AND source = 'manual_upload' AND activity_date IS NOT NULL",
    "f02_share_eligibility": f"{_A} SELECT user_id, count(*) AS n FROM act WHERE source = 'manual_upload' AND activity_date IS NOT NULL AND n_fixes > 0 GROUP BY user_id",
    "f03_bbox_overlap": f"{_A} SELECT activity_id FROM act WHERE min_lon <= CAST(3.81 AS DOUBLE) AND max_lon >= CAST(3.805 AS DOUBLE) AND min_lat <= CAST(43.61 AS DOUBLE) AND max_lat >= CAST(43.605 AS DOUBLE)",
    "f04_any_vertex_in_bbox": f"WITH {FIXES} SELECT DISTINCT activity_id FROM fx WHERE lat BETWEEN CAST(43.605 AS DOUBLE) AND CAST(43.61 AS DOUBLE) AND lon BETWEEN CAST(3.805 AS DOUBLE) AND CAST(3.81 AS DOUBLE)",
    "f05_relative_window": f"{_A} SELECT sport, count(*) AS n FROM act WHERE started >= {_NOW} - INTERVAL '7' DAY GROUP BY sport",
    "f06_sport_alias": f"{_A} SELECT activity_id, sport FROM act WHERE sport IN ('mtb', 'offroad', 'gravel')",
    "f07_heat_sport": f"{_A} SELECT CASE WHEN sport IN ('road', 'gravel', 'mtb', 'running') THEN sport ELSE 'gravel' END AS heat_sport, count(*) AS n FROM act GROUP BY 1",
    "f08_route_list": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus <> 'P' AND lower(o_orderpriority) LIKE '%high%' AND o_totalprice BETWEEN 50000 AND 200000",
    "f12_conditional_projection": f"{_A} SELECT activity_id, CASE WHEN n_fixes >= 10 THEN 'cache' ELSE NULL END AS cached, CASE WHEN n_fixes < 10 THEN n_fixes END AS raw FROM act",
    "f13_null_safe": f"{_A} SELECT activity_id FROM act WHERE activity_date IS DISTINCT FROM started",
    "f14_text_predicates": "SELECT doc_id, [[left(text, 12)||left(text, 12)]] AS head, length(text) AS n, [[regexp_replace(source, '[0-9]+$', '')||regexp_replace(source, '[0-9]+$', '')]] AS kind FROM {documents} WHERE text LIKE '%e%' AND text NOT LIKE '%###%' AND [[source rlike '^src1'||regexp_matches(source, '^src1')]]",
    "f15_plausible_date": "SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '1997-01-01 00:00:00' THEN o_orderdate END AS d FROM {orders}",
    "f17_effective_date": f"{_A} SELECT activity_id, coalesce(activity_date, ended) AS effective, activity_date IS NULL AS undated FROM act",
    "j01_latest_with_author": "SELECT o_orderkey, o_orderdate, c_name FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20",
    "j02_distinct_cells_by_sport": f"WITH {CELLS} SELECT sport, user_id, count(DISTINCT ilat * 100000000 + ilon) AS cells FROM cells GROUP BY sport, user_id",
    "j03_conditional_counts": f"{_A}, us AS (SELECT DISTINCT user_id FROM {{events}}) SELECT us.user_id, count(act.activity_id) AS n, sum(CASE WHEN source = 'strava_api' THEN 1 ELSE 0 END) AS synced FROM us LEFT JOIN act ON us.user_id = act.user_id GROUP BY us.user_id",
    "j04_near_time_pairs": f"{_A}, {_BUCKETS} SELECT a.user_id AS user_a, b.user_id AS user_b, count(*) AS hits FROM nb a JOIN bk b ON a.pb = b.tb AND a.user_id < b.user_id AND {_NEAR} GROUP BY a.user_id, b.user_id",
    "j05_or_join": f"""{_A}, {_BUCKETS}, k AS (SELECT a.activity_id AS x, b.activity_id AS y FROM act a JOIN act b ON floor(a.activity_id / 2) = floor(b.activity_id / 2) AND a.activity_id < b.activity_id),
t AS (SELECT a.activity_id AS x, b.activity_id AS y FROM nb a JOIN bk b ON a.pb = b.tb AND a.activity_id < b.activity_id AND {_NEAR} AND abs(a.n_fixes - b.n_fixes) <= CAST(0.05 AS DOUBLE) * greatest(a.n_fixes, b.n_fixes)) SELECT x, y FROM k UNION SELECT x, y FROM t""",
    "j08_exists_sibling": f"{_A} SELECT a.activity_id FROM act a WHERE EXISTS (SELECT 1 FROM act b WHERE b.user_id = a.user_id AND b.activity_id <> a.activity_id AND b.sport = 'mtb')",
    "j10_stale_contributors": f"{_A} SELECT user_id, max(started) AS latest FROM act WHERE contribute GROUP BY user_id HAVING max(started) < {_NOW} - INTERVAL '4' DAY",
    "j12_without_current_consent": """WITH cs AS (SELECT DISTINCT user_id, concat('v', event_id % 7) AS version FROM {events} WHERE event_id % 5 = 0)
SELECT user_id, [[listagg(version, ',') WITHIN GROUP (ORDER BY version)||string_agg(version, ',' ORDER BY version)]] AS prior_versions FROM cs GROUP BY user_id HAVING NOT bool_or(version = 'v5')""",
    "j13_hash_difference": "SELECT DISTINCT md5(l_shipmode) AS h FROM (SELECT l_returnflag AS l_shipmode FROM {lineitem} UNION ALL SELECT l_linestatus FROM {lineitem}) x EXCEPT SELECT DISTINCT md5(o_orderstatus) FROM {orders}",
    "j14_trip_totals": "SELECT o_custkey, count(*) AS stages, sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((1 - l_discount) * 100) AS BIGINT)) AS total_e4 FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' AND l_returnflag <> 'R' GROUP BY o_custkey",
    "j15_masked_items": "SELECT o_custkey, o_orderkey, CASE WHEN c_nationkey % 2 = 0 THEN c_name END AS shown, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey",
    "j17_listing_states": f"{_A}, csv AS (SELECT user_id AS k, CASE WHEN user_id % 2 = 0 THEN 'ride' END AS listed FROM act WHERE user_id % 3 <> 0 GROUP BY user_id) SELECT activity_id, CASE WHEN k IS NULL THEN 'absent' WHEN listed IS NULL THEN 'no sport' ELSE listed END AS state FROM act LEFT JOIN csv ON act.user_id = csv.k",
    "j18_lattice_probe": f"WITH {CELLS} SELECT ds.activity_id, max(pass_count) AS busiest, min(user_count) AS quietest FROM ds JOIN lattice l ON ds.sport = l.sport AND {CELL('lat')} = l.ilat AND {CELL('lon')} = l.ilon GROUP BY ds.activity_id",
    "j19_neighbour_probe": f"""WITH {CELLS}, o AS (SELECT ilat, ilon, sum(pass_count) AS p FROM lattice GROUP BY ilat, ilon), n1 AS (SELECT ilat AS a, ilon AS b, [[explode(array(ilat - 1, ilat, ilat + 1))||unnest([ilat - 1, ilat, ilat + 1])]] AS ilat, ilon FROM o), n2 AS (SELECT a, b, ilat, [[explode(array(ilon - 1, ilon, ilon + 1))||unnest([ilon - 1, ilon, ilon + 1])]] AS ilon FROM n1)
SELECT a AS ilat, b AS ilon, count(*) - 1 AS neighbours, sum(o.p) AS passes_around FROM n2 JOIN o ON n2.ilat = o.ilat AND n2.ilon = o.ilon GROUP BY a, b""",
    "j24_first_seen_wins": "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rk FROM {lineitem}) x WHERE rk = 1",
    "j25_account_pairing": f"""{_A}, {_BUCKETS}, hit AS (SELECT a.user_id AS x, b.user_id AS y, count(*) AS n FROM nb a JOIN bk b ON a.pb = b.tb AND a.user_id % 3 = 0 AND b.user_id % 3 <> 0 AND {_NEAR} GROUP BY a.user_id, b.user_id), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY n DESC, y) AS rk, lead(n) OVER (PARTITION BY x ORDER BY n DESC, y) AS second FROM hit) SELECT x, y, n, coalesce(second, 0) < CAST(0.8 AS DOUBLE) * n AS resolved FROM r WHERE rk = 1""",
    "a01_sport_stats": f"""WITH {LEGS}, us AS (SELECT DISTINCT user_id FROM lg), us5 AS (SELECT user_id, [[explode(array('road', 'gravel', 'mtb', 'offroad', 'running', 'total'))||unnest(['road', 'gravel', 'mtb', 'offroad', 'running', 'total'])]] AS sport FROM us),
tc AS (SELECT DISTINCT user_id, sport, {TILE_XY} FROM lg),
st AS (SELECT user_id, sport, count(DISTINCT activity_id) AS n, sum(d) AS m, sum(CASE WHEN ele > ele0 THEN ele - ele0 ELSE 0 END) AS up FROM lg GROUP BY user_id, sport UNION ALL SELECT user_id, 'total', count(DISTINCT activity_id), sum(d), sum(CASE WHEN ele > ele0 THEN ele - ele0 ELSE 0 END) FROM lg GROUP BY user_id),
ce AS (SELECT user_id, sport, count(*) AS cells FROM tc GROUP BY user_id, sport UNION ALL SELECT user_id, 'total', count(*) FROM (SELECT DISTINCT user_id, x, y FROM tc) t GROUP BY user_id)
SELECT us5.user_id, us5.sport, coalesce(n, 0) AS activities, round(coalesce(m, 0), 2) AS metres, round(coalesce(up, 0), 2) AS climb, coalesce(cells, 0) AS cells FROM us5 LEFT JOIN st ON st.user_id = us5.user_id AND st.sport = us5.sport LEFT JOIN ce ON ce.user_id = us5.user_id AND ce.sport = us5.sport""",
    "a02_summed_cells": f"WITH {CELLS} SELECT user_id, count(*) AS summed, count(DISTINCT ilat * 100000000 + ilon) AS distinct_cells FROM (SELECT DISTINCT user_id, sport, ilat, ilon FROM cells) x GROUP BY user_id",
    "a03_personal_bests": f"""WITH {LEGS}, ac AS (SELECT activity_id, user_id, sport, CASE WHEN activity_id % 13 = 0 THEN NULL ELSE min(ts) END AS began, {_ROUNDED('sum(d)', 1)} AS m, sum(CASE WHEN ele > ele0 THEN ele - ele0 ELSE 0 END) AS up, {_SECONDS('max(ts)')} - {_SECONDS('min(ts)')} AS s FROM lg GROUP BY activity_id, user_id, sport),
pd AS (SELECT user_id, 'best_year' AS category, year(began) * 100 AS ym, {_ROUNDED(_TENTHS('m') + ' / 1000', 1)} AS v FROM ac WHERE began IS NOT NULL AND m > 0 GROUP BY user_id, year(began) UNION ALL SELECT user_id, 'best_month', year(began) * 100 + month(began), {_ROUNDED(_TENTHS('m') + ' / 1000', 1)} FROM ac WHERE began IS NOT NULL AND m > 0 GROUP BY user_id, year(began), month(began)),
rc AS (SELECT user_id, category, 'all' AS sport, v, CAST(ym AS BIGINT) AS what FROM (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY v DESC, ym) AS rk FROM pd) x WHERE rk = 1
UNION ALL SELECT user_id, 'longest', sport, {_ROUNDED('m / 1000', 1)}, activity_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, sport ORDER BY m DESC, activity_id) AS rk FROM ac WHERE m > 0) x WHERE rk = 1
UNION ALL SELECT user_id, 'most_elevation', sport, {_ROUNDED('up', 1)}, activity_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY up DESC, activity_id) AS rk FROM ac WHERE up > 0) x WHERE rk = 1
UNION ALL SELECT user_id, 'fastest', sport, {_ROUNDED('m / s * CAST(3.6 AS DOUBLE)', 4)}, activity_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, sport ORDER BY m / s DESC, activity_id) AS rk FROM ac WHERE m > 0 AND s > 0) x WHERE rk = 1
UNION ALL SELECT user_id, 'total', 'all', {_ROUNDED(_TENTHS('m') + ' / 1000', 1)}, count(*) FROM ac GROUP BY user_id)
SELECT user_id, category, sport, CAST(v AS DOUBLE) AS value, what FROM rc""",
    "a04_dashboard": f"""WITH {LEGS}, ac AS (SELECT activity_id, user_id, sport, min(ts) AS began, sum(d) AS m, sum(CASE WHEN ele > ele0 THEN ele - ele0 ELSE 0 END) AS up, CASE WHEN user_id % 6 = 0 THEN 'strava' WHEN user_id % 7 = 0 THEN NULL ELSE 'file' END AS provider FROM lg GROUP BY activity_id, user_id, sport), us AS (SELECT user_id, min(ts) AS joined FROM lg GROUP BY user_id),
ro AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'private' WHEN 'O' THEN 'public' ELSE 'unlisted' END AS visibility FROM {{orders}})
SELECT 'users' AS section, 'total' AS name, count(*) AS n, CAST(NULL AS DOUBLE) AS metres FROM us
UNION ALL SELECT 'users', 'signups_7d', count(*), NULL FROM us WHERE joined >= {_NOW} - INTERVAL '7' DAY UNION ALL SELECT 'users', 'signups_30d', count(*), NULL FROM us WHERE joined >= {_NOW} - INTERVAL '30' DAY
UNION ALL SELECT 'users', 'active_7d', count(DISTINCT user_id), NULL FROM ac WHERE began >= {_NOW} - INTERVAL '7' DAY UNION ALL SELECT 'users', 'active_30d', count(DISTINCT user_id), NULL FROM ac WHERE began >= {_NOW} - INTERVAL '30' DAY
UNION ALL SELECT 'activities', 'total', count(*), round(sum(m), 1) FROM ac UNION ALL SELECT 'activities', 'climb', count(*), round(sum(up), 1) FROM ac
UNION ALL SELECT 'by_provider', coalesce(provider, 'unknown'), count(*), NULL FROM ac GROUP BY 2 UNION ALL SELECT 'by_sport', coalesce(sport, 'unknown'), count(*), round(sum(m), 1) FROM ac GROUP BY 2
UNION ALL SELECT 'routes', visibility, count(*), NULL FROM ro GROUP BY 2 UNION ALL SELECT 'routes', 'total', count(*), NULL FROM ro""",
    "a05_user_rollup": f"""WITH {LEGS}, ac AS (SELECT activity_id, user_id, sport, CASE WHEN activity_id % 13 = 0 THEN NULL ELSE min(ts) END AS began, round(sum(d), 1) AS m, CASE WHEN activity_id % 3 = 0 THEN 'strava' WHEN activity_id % 7 = 0 THEN NULL ELSE 'file' END AS provider FROM lg GROUP BY activity_id, user_id, sport),
sp AS (SELECT user_id, sport, count(*) AS n, {_TENTHS('m')} AS m, min(began) AS a, max(began) AS z FROM ac GROUP BY user_id, sport),
pr AS (SELECT user_id, coalesce(provider, 'unknown') AS provider, count(*) AS n FROM ac GROUP BY 1, 2),
s2 AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS n, round({_TENTHS('m')}, 1) AS metres, min(a) AS first_at, max(z) AS last_at, [[listagg(concat(sport, '=', n, '/', CAST(round(m) AS BIGINT)), ';') WITHIN GROUP (ORDER BY sport)||string_agg(concat(sport, '=', n, '/', CAST(round(m) AS BIGINT)), ';' ORDER BY sport)]] AS by_sport FROM sp GROUP BY user_id),
p2 AS (SELECT user_id, [[listagg(concat(provider, '=', n), ';') WITHIN GROUP (ORDER BY provider)||string_agg(concat(provider, '=', n), ';' ORDER BY provider)]] AS by_provider FROM pr GROUP BY user_id)
SELECT s2.user_id, n, metres, first_at, last_at, by_sport, by_provider FROM s2 JOIN p2 ON p2.user_id = s2.user_id""",
    "a06_status_zero_filled": "SELECT s.status, count(o_orderkey) AS n FROM (SELECT 'F' AS status UNION ALL SELECT 'O' UNION ALL SELECT 'P' UNION ALL SELECT 'X') s LEFT JOIN {orders} ON o_orderstatus = s.status GROUP BY s.status",
    "a07_community_stats": f"WITH {LEGS} SELECT count(DISTINCT user_id) AS contributors, count(DISTINCT activity_id) AS traces, round(sum(d) / 1000, 3) AS km FROM lg WHERE user_id % 6 <> 0 AND user_id % 11 <> 0",
    "a09_freshness": f"{_A} SELECT max(started) AS newest, max(activity_date) AS newest_dated FROM act",
    "a10_digest": """WITH part AS (SELECT user_id, CAST(floor(event_id / 10000) AS BIGINT) AS block, count(*) AS n, md5([[listagg(CAST(event_id AS STRING), ',') WITHIN GROUP (ORDER BY event_id)||string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)]]) AS digest FROM {events} GROUP BY 1, 2)
SELECT user_id, sum(n) AS n, md5([[listagg(digest, ',') WITHIN GROUP (ORDER BY block)||string_agg(digest, ',' ORDER BY block)]]) AS digest FROM part GROUP BY user_id""",
    "a12_bounded_count": "SELECT count(*) AS n FROM (SELECT 1 FROM {lineitem} LIMIT 1001) x",
    "a13_fork_counts": "SELECT c_custkey, coalesce(n, 0) AS forks FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) x ON c_custkey = o_custkey",
    "a14_majority_sport": "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS rk FROM {events} GROUP BY user_id, event_type) x WHERE rk = 1",
    "a16_outcome_pivot": f"{_A} SELECT user_id, sum(CASE WHEN n_fixes >= 12 THEN 1 ELSE 0 END) AS enough, sum(CASE WHEN n_fixes < 12 AND n_fixes >= 6 THEN 1 ELSE 0 END) AS few, sum(CASE WHEN n_fixes < 6 THEN 1 ELSE 0 END) AS too_few FROM act GROUP BY user_id",
    "a20_next_position": f"WITH {FIXES} SELECT activity_id, coalesce(max(seq) + 1, 0) AS next_position FROM fx GROUP BY activity_id",
    "w01_latest_per_key": f"{_A} SELECT user_id, sport, activity_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, sport ORDER BY activity_date DESC NULLS LAST, activity_id DESC) AS rk FROM act) x WHERE rk = 1",
    "w03_cumulative_distance": f"WITH {LEGS} SELECT activity_id, seq, round(sum(d) OVER (PARTITION BY activity_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 3) AS cum FROM lg",
    "w04_rolling_median": f"WITH {FIXES} SELECT activity_id, seq, [[percentile(ele, 0.5)||quantile_cont(ele, 0.5)]] OVER (PARTITION BY activity_id ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS median_ele FROM fx",
    "w09_fill_missing": f"""WITH {FIXES}, g AS (SELECT activity_id, seq, CASE WHEN event_id % 3 = 0 OR event_id % 7 < 3 THEN NULL WHEN event_id % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE ele END AS e FROM fx), {FILLED} SELECT activity_id, seq, round(filled, 6) AS ele FROM fl""",
    "w10_running_min": f"WITH {FIXES} SELECT activity_id, seq, min(ele) OVER (PARTITION BY activity_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS low_so_far FROM fx",
    "l01_recent_then_ascending": f"{_A} SELECT * FROM (SELECT activity_id, activity_date FROM act ORDER BY activity_date DESC NULLS LAST, activity_id DESC LIMIT 50) x ORDER BY activity_date ASC NULLS FIRST, activity_id",
    "l05_nulls_last_sort": f"{_A} SELECT activity_id, activity_date FROM act ORDER BY activity_date DESC NULLS LAST, activity_id LIMIT 100",
    "l06_oldest_batch": "SELECT event_id, ts FROM {events} ORDER BY ts, event_id LIMIT 25",
    "l08_smallest_first": "SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id ORDER BY n, user_id LIMIT 30",
    "l11_first_four": f"WITH {FIXES} SELECT activity_id, seq, event_id FROM fx WHERE seq <= 4",
    "u01_owner_union": "SELECT o_custkey AS owner FROM {orders} WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'O'",
    "u02_first_method_wins": "SELECT k, method FROM (SELECT k, method, row_number() OVER (PARTITION BY k ORDER BY method) AS rk FROM (SELECT l_partkey AS k, 1 AS method FROM {lineitem} WHERE l_quantity > 45 UNION ALL SELECT l_partkey, 2 FROM {lineitem} WHERE l_discount > 0.05) x) y WHERE rk = 1",
    "c03_name_refinement": "SELECT doc_id, kind, CASE WHEN kind <> 'road' THEN kind WHEN lower(text) LIKE '%gravel%' THEN 'gravel' WHEN lower(text) LIKE '%vtt%' OR lower(text) LIKE '%mtb%' OR lower(text) LIKE '%mountain%' THEN 'mtb' ELSE kind END AS sport FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'running' ELSE 'road' END AS kind, CASE doc_id % 5 WHEN 0 THEN concat('Sortie VTT ', text) WHEN 1 THEN concat('GRAVEL ', text) WHEN 2 THEN concat('Mountain bike ', text) ELSE text END AS text FROM {documents}) x",
    "c04_sport_cascade": f"{_A} SELECT activity_id, CASE WHEN a = 'road' AND b IN ('gravel', 'mtb') THEN b ELSE coalesce(a, b, 'unknown') END AS sport FROM (SELECT activity_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'road' END AS a, CASE WHEN user_id % 2 = 0 THEN sport END AS b FROM act) x",
    "c18_date_parts": "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, CASE month(o_orderdate) WHEN 1 THEN 'janvier' WHEN 2 THEN 'février' WHEN 3 THEN 'mars' WHEN 4 THEN 'avril' WHEN 5 THEN 'mai' WHEN 6 THEN 'juin' WHEN 7 THEN 'juillet' WHEN 8 THEN 'août' WHEN 9 THEN 'septembre' WHEN 10 THEN 'octobre' WHEN 11 THEN 'novembre' ELSE 'décembre' END AS month_name, count(*) AS n FROM {orders} GROUP BY 1, 2, 3",
    "c20_freshness_level": f"{_A} SELECT user_id, CASE WHEN max(started) IS NULL THEN 'unknown' WHEN max(started) >= {_NOW} - INTERVAL '3' DAY THEN 'green' WHEN max(started) >= {_NOW} - INTERVAL '10' DAY THEN 'amber' ELSE 'red' END AS level FROM act GROUP BY user_id",
    "c22_hashes": "SELECT doc_id, [[sha2(text, 256)||sha256(text)]] AS file_hash, md5(text) AS etag FROM {documents}",
    "m09_ttl_split": f"SELECT event_id FROM {{events}} WHERE ts < {_NOW} - INTERVAL '20' DAY",
    "m10_reaper": f"SELECT event_id, CASE WHEN ts < {_NOW} - INTERVAL '15' DAY AND event_id % 7 >= 5 THEN 'failed' ELSE event_type END AS status FROM {{events}}",
    "r08_window_dedup": "SELECT user_id, [[CAST(floor(unix_timestamp(ts) / 300) AS BIGINT)||CAST(floor(epoch(ts) / 300) AS BIGINT)]] AS w, count(*) AS n FROM {events} GROUP BY 1, 2",
    "r09_trailing_window": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS recent FROM {events}",
    "a08_contribution_status": f"{_A} SELECT user_id, count(*) AS n, max(started) AS newest FROM act WHERE contribute AND source = 'manual_upload' AND activity_date IS NOT NULL GROUP BY user_id",
    "a11_two_conditional_counts": f"SELECT user_id, count(*) FILTER (WHERE ts >= {_NOW} - INTERVAL '1' DAY) AS last_day, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM {{events}} GROUP BY user_id",
    "a17_match_status": "SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM {orders} GROUP BY o_orderstatus",
    "a19_default_sport_count": f"{_A} SELECT user_id, count(*) AS n FROM act WHERE sport = 'road' AND n_fixes < 12 GROUP BY user_id",
    "a22_data_bounds": f"{_A} SELECT sport, round(min(min_lat), 6) AS south, round(max(max_lat), 6) AS north, round(min(min_lon), 6) AS west, round(max(max_lon), 6) AS east FROM act GROUP BY sport",
    "a23_trip_days": "SELECT o_custkey, max(month(o_orderdate)) + 1 AS days FROM {orders} GROUP BY o_custkey",
    "a24_unread_count": "SELECT user_id, count(*) FILTER (WHERE event_id % 3 = 0) AS unread FROM {events} GROUP BY user_id",
    "c05_default_flag": f"{_A} SELECT activity_id, sport = 'road' AND user_id % 2 = 0 AND n_fixes < 12 AS sport_is_default FROM act",
    "c17_safe_names": f"""WITH n AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat(text, '.gpx') WHEN 1 THEN concat('../', text, '.tar.much-too-long-an-ending') WHEN 2 THEN concat('._', substr(text, 1, 20), '..', doc_id, '_.') ELSE '...' END AS name FROM {{documents}}),
c AS (SELECT doc_id, replace([[trim(BOTH '._' FROM regexp_replace(coalesce(name, ''), '[^A-Za-z0-9._-]+', '_'))||trim(regexp_replace(coalesce(name, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '._')]], '..', '_') AS c FROM n),
e AS (SELECT *, CASE WHEN c LIKE '%.%' THEN [[substring_index(c, '.', -1)||split_part(c, '.', -1)]] ELSE '' END AS ext FROM c)
SELECT doc_id, CASE WHEN c = '' THEN 'upload.bin' WHEN length(c) <= 100 THEN c WHEN length(ext) BETWEEN 1 AND 10 AND length(c) > length(ext) + 1 THEN concat(substr(substr(c, 1, length(c) - length(ext) - 1), 1, 99 - length(ext)), '.', ext) ELSE substr(c, 1, 100) END AS file_name FROM e""",
    "j11_bool_or_having": "SELECT c_custkey, count(*) AS n FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey HAVING bool_or(o_orderstatus = 'P')",
    "j16_version_fallback": "SELECT o_orderkey, coalesce(max(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END), max(l_extendedprice), o_totalprice) AS shown FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice",
    "j22_natural_key_merge": "SELECT coalesce(old.n_name, new.name) AS name, coalesce(new.sport, old.sport) AS sport, coalesce(new.v, old.n_nationkey) AS v, CASE WHEN old.n_name IS NULL THEN 'insert' WHEN new.name IS NULL THEN 'keep' ELSE 'update' END AS outcome FROM (SELECT n_name, n_nationkey, n_regionkey % 2 AS sport FROM {nation}) old FULL OUTER JOIN (SELECT n_name AS name, n_regionkey % 2 AS sport, n_nationkey * 10 AS v FROM {nation} WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_name, 1 - n_regionkey % 2, -1 FROM {nation} WHERE n_nationkey % 5 = 0 UNION ALL SELECT r_name, 0, r_regionkey FROM {region}) new ON old.n_name = new.name AND old.sport = new.sport",
    "j23_changed_rows": f"{_A}, old AS (SELECT activity_id, sport FROM act), new AS (SELECT activity_id, CASE WHEN n_fixes > 12 THEN 'gravel' ELSE sport END AS sport FROM act WHERE user_id % 9 <> 0) SELECT coalesce(old.activity_id, new.activity_id) AS activity_id FROM old FULL OUTER JOIN new ON old.activity_id = new.activity_id WHERE old.sport IS DISTINCT FROM new.sport",
    "j26_orphan_sweep": "SELECT DISTINCT e.user_id FROM {events} e WHERE NOT EXISTS (SELECT 1 FROM {customer} c WHERE c.c_custkey = e.user_id * 11)",
    "l02_latest_reversed": "SELECT event_id, ts FROM (SELECT event_id, ts FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 40) x ORDER BY ts, event_id",
    "l04_default_sports_newest": f"{_A} SELECT activity_id, activity_date FROM act WHERE sport = 'road' ORDER BY activity_date DESC NULLS LAST, activity_id LIMIT 30",
    "l09_ordered_stages": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate ASC NULLS LAST, l_linenumber) AS position FROM {lineitem}",
    "m07_deep_copy": "SELECT l_orderkey + 10000000 AS new_key, l_linenumber, l_partkey FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'",
    "m11_evidence_purge": f"{_A} SELECT activity_id FROM act WHERE source = 'strava_api' AND EXISTS (SELECT 1 FROM {{events}} e WHERE e.user_id = act.user_id AND e.event_type = 'error') AND n_fixes < 12",
    "r05_revision_counts": "SELECT user_id, count(DISTINCT [[date_trunc('DAY', ts)||date_trunc('day', ts)]]) AS revision, count(*) AS changes FROM {events} GROUP BY user_id",
}

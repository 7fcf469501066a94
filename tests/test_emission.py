"""Density points, display lines, shares and cuts, against plain versions."""

import json
import math

import numpy as np

from waymark.functions import geo
from waymark.operators import emission, matching, queries, shapes

SF = "/root/testdata/sf0.001"


def brute_levels(lat, every):
    stops, out = list(emission.RADIUS_PX), []
    for z in range(23):
        if z <= stops[0][0]:
            px = stops[0][1]
        elif z >= stops[-1][0]:
            px = stops[-1][1]
        else:
            (z0, r0), (z1, r1) = next((a, b) for a, b in zip(stops, stops[1:]) if z <= b[0])
            px = r0 + (r1 - r0) * (z - z0) / (z1 - z0)
        room = 0.75 * px * 40_075_016.686 * math.cos(math.radians(lat)) / (512 * 2**z)
        level = max(0, math.floor(math.log2(room / (every + 3)))) if room > every + 3 else 0
        out.append(min([level, *out[-1:]]))
    return out


def test_levels_and_zooms():
    for lat in (0, 43.6, -70):
        for every in (20.0, 500.0):
            levels = emission.point_levels(lat, every)
            assert levels.tolist() == brute_levels(lat, every)
            assert emission.lowest_zooms(300, levels).tolist() == [next(z for z, v in enumerate(levels) if i % (1 << v) == 0) for i in range(300)]


def test_heat_points_of_a_run(spark):
    lon = 3.8 + np.arange(200) * 4.0 / (geo.DEGREE_M * math.cos(math.radians(43.6)))
    rows = [(1, r, i, "mtb", float(x), 43.6, int(1 + i % 7)) for r in (0, 5) for i, x in enumerate(lon)] + [(2, 0, 0, "road", 3.8, 43.6, 2)]
    df = spark.createDataFrame(rows, "activity_id long, run long, seq int, sport string, lon double, lat double, eff long")
    got = sorted(emission.heat_points(df, 7.0).collect())
    assert {(r["activity_id"], r["run"]) for r in got} == {(1, 0), (1, 5), (2, 0)}
    for run in (0, 5):
        own = [r for r in got if (r["activity_id"], r["run"]) == (1, run)]
        at, since, want = None, 20.0, []
        for i, x in enumerate(lon):
            since += 0 if at is None else float(geo.metres(at, 43.6, x, 43.6))
            at = x
            if since >= 20:
                want.append(i)
                since = 0.0
        assert [r["lon"] for r in own] == [round(float(lon[i]), 5) for i in want] and [r["number"] for r in own] == list(range(len(want)))
        assert [r["w"] for r in own] == [round(min(1, math.log1p(1 + i % 7) / math.log1p(7)), 3) for i in want]
    lines = {(r["activity_id"], r["run"], r["number"]): json.loads(r["value"]) for r in emission.point_features(emission.heat_points(df, 7.0)).collect()}
    for r in got:
        f = lines[r["activity_id"], r["run"], r["number"]]
        assert f["geometry"]["coordinates"] == [r["lon"], r["lat"]] and f["properties"] == {"w": r["w"], "sport": r["sport"]}
        assert f.get("tippecanoe", {}).get("minzoom", 6) == max(6, r["minzoom"])
    assert emission.heat_points(df.limit(0)).collect() == []


def brute_dp(p, high, tolerance):
    """Recursive Douglas-Peucker, point by point."""
    if len(p) <= 2:
        return list(range(len(p)))
    (ax, ay), (bx, by) = p[0], p[-1]
    far, at = -1.0, 0
    for i in range(1, len(p) - 1):
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        t = 0.0 if n == 0 else max(0.0, min(1.0, ((p[i][0] - ax) * dx + (p[i][1] - ay) * dy) / n))
        d = (p[i][0] - ax - t * dx) ** 2 + (p[i][1] - ay - t * dy) ** 2
        if high is not None:
            d += (high[i] - (high[0] + t * (high[-1] - high[0]))) ** 2
        if d > far:
            far, at = d, i
    if far <= tolerance**2:
        return [0, len(p) - 1]
    left = brute_dp(p[: at + 1], None if high is None else high[: at + 1], tolerance)
    right = brute_dp(p[at:], None if high is None else high[at:], tolerance)
    return left[:-1] + [at + k for k in right]


def test_simplify_against_recursion():
    r = np.random.default_rng(6)
    for n in (2, 3, 30, 120):
        for high in (False, True):
            lon, lat = 3.8 + np.cumsum(r.normal(0, 2e-5, n)), 43.6 + np.cumsum(r.normal(0, 2e-5, n))
            ele = 100 + np.cumsum(r.normal(0, 2, n)) if high else None
            k = geo.DEGREE_M * math.cos(math.radians(lat.mean()))
            want = brute_dp(list(zip(lon * k, lat * geo.DEGREE_M)), None if ele is None else (ele * 2 / 5).tolist(), 2.0)
            assert shapes.simplify(lon, lat, ele).tolist() == want


def brute_levels_split(passes, eff, way, least):
    """Level split, vertex by vertex."""
    out, begin, seen, n = [], 0, 0, len(passes)
    while True:
        p, e, since, cut = passes[begin], eff[begin], None, None
        for i in range(seen + 1, n):
            if passes[i] >= 2 * p or 2 * passes[i] <= p or eff[i] >= 2 * e or 2 * eff[i] <= e:
                since = i if since is None else since
                if way[i] - way[since - 1] >= least:
                    cut, seen = since, i
                    break
            else:
                since = None
        if cut is None:
            return [*out, (begin, n - 1)]
        out.append((begin, cut))
        begin = cut


def test_level_split_against_a_walk():
    r = np.random.default_rng(9)
    for _ in range(120):
        n = int(r.integers(2, 700))
        level = np.repeat(r.integers(1, 40, n // 3 + 1), r.choice([1, 3, 40, 150]))[:n]
        level = np.concatenate([level, np.full(n - len(level), 5)])
        eff = np.maximum(1, level - r.integers(0, 3, n))
        way = np.cumsum(r.uniform(0, 12, n))
        assert shapes.level_pieces(level, eff, way, 200.0) == brute_levels_split(level, eff, way, 200.0)


def test_display_lines(spark):
    lon = 3.8 + np.arange(60) * 1e-4
    lat, ele = np.full(60, 43.6), np.full(60, 100.0)
    far = lon.copy()
    far[30:] += 1
    ele2 = ele.copy()
    ele2[10] = np.nan
    peak = ele.copy()
    peak[20] = 160
    tracks = {1: (lon, ele), 2: (far, ele), 3: (lon, ele2), 4: (lon, peak), 5: (lon[:1], ele[:1])}
    rows = [(k, i, float(x), 43.6, None if np.isnan(e) else float(e)) for k, (xs, es) in tracks.items() for i, (x, e) in enumerate(zip(xs, es))]
    got = {r["activity_id"]: r for r in emission.display_geometry(spark.createDataFrame(rows, "activity_id long, seq int, lon double, lat double, ele double")).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1]["kind"] == "LineString" and got[1]["parts"] == [[[3.8, 43.6, 100.0], [round(float(lon[-1]), 5), 43.6, 100.0]]]
    assert got[2]["kind"] == "MultiLineString" and len(got[2]["parts"]) == 2
    assert got[3]["points"] == 2 and any(p[0] == round(float(lon[20]), 5) for p in got[4]["parts"][0])
    outliers = emission.compact_line(np.array([1.0, 50.0, 100.0]), np.array([0.0, 20.0, 0.0]), None)
    assert len(outliers) == 1 and len(outliers[0]) == 3  # nothing can be drawn: left as it is


def test_shares_tell_the_sport_and_mask_the_ends(spark):
    ends = {}
    for r in queries._shared(spark, SF).collect():
        ends.setdefault(r["activity_id"], []).append((r["seq"], r["lon"], r["lat"]))
    rows = [json.loads(r["value"]) for r in queries.k47_s32_share_features(spark, SF).collect()]
    assert rows and all(set(r) == {"type", "geometry", "properties"} and set(r["properties"]) == {"sport"} for r in rows)
    for r in emission.share_lines(queries._shared(spark, SF), 40.0).collect():
        for part in r["parts"]:
            for _, lon, lat in (min(ends[r["activity_id"]]), max(ends[r["activity_id"]])):
                assert geo.metres(lon, lat, *np.array(part).T).min() > 39


def test_outlines_keep_ends(spark):
    got = {r["activity_id"]: r["coords"] for r in queries.k49_outlines(spark, SF).collect()}
    first = {}
    for r in queries._fixes(spark, SF).collect():
        first.setdefault(r["activity_id"], []).append((r["seq"], round(r["lon"], 5), round(r["lat"], 5)))
    for k, coords in got.items():
        assert [tuple(coords[0]), tuple(coords[-1])] == [min(first[k])[1:], max(first[k])[1:]]


def test_a_track_within_a_longer_way_matches_directed_only(spark):
    lon = [3.8 + k * 1e-3 for k in range(60)]
    ways = spark.createDataFrame([(7, [[x, 43.6] for x in lon]), (8, [[x, 43.61] for x in lon])], "way_id long, coords array<array<double>>")
    tracks = spark.createDataFrame([(1, [[x + 5e-5, 43.60005] for x in lon[20:30]]), (2, [[5.0, 44.0], [5.1, 44.0]])], "track_id long, coords array<array<double>>")
    both, one = ({r["track_id"]: r["way_id"] for r in matching.match_lines(tracks, ways, directed=d).collect()} for d in (False, True))
    assert both == {1: None, 2: None} and one == {1: 7, 2: None}
    assert all(r["way_id"] is not None for r in queries.j20_directed_line_match(spark, SF).collect())

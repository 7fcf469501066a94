import math

import numpy as np
import pytest

from waymark.functions import geo
from waymark.operators import heatmap, matching, queries
from waymark.plans.dialect import over, prepared
from waymark.plans.traces import RADIUS_M

SF = "/root/testdata/sf0.001"


def test_rolling_lower_median():
    rng = np.random.default_rng(2)
    for n in (1, 2, 40):
        values, way = rng.integers(0, 9, n), np.sort(rng.uniform(0, 300, n))
        got = heatmap.rolling_lower_median(values, way, 50.0, 5)
        for i in range(n):
            near = sorted(int(values[j]) for j in range(n) if abs(way[j] - way[i]) <= 50 and abs(j - i) <= 5)
            assert got[i] == near[(len(near) - 1) // 2]


def trail(spark, passes, sport="mtb"):
    lon = 3.80005 + np.arange(len(passes)) * 1e-4 * 2
    rows = [(1, 0, i, sport, float(x), 43.60005, int(p), 2, int(p)) for i, (x, p) in enumerate(zip(lon, passes))]
    return spark.createDataFrame(rows, "activity_id long, run long, seq int, sport string, lon double, lat double, pass_count long, user_count long, eff long")


def test_pieces_share_a_vertex_that_counts_for_the_later(spark):
    rows = sorted(heatmap.graded_pieces(trail(spark, [2] * 40 + [20] * 40)).collect(), key=lambda r: r["piece"])
    assert [(r["pass_count"], r["user_count"], r["terminal"]) for r in rows] == [(2, 2, False), (20, 2, True)]
    assert rows[0]["lon"][-1] == rows[1]["lon"][0] and sum(len(r["lon"]) for r in rows) == 81
    assert heatmap.graded_pieces(trail(spark, [5])).count() == 0 and heatmap.graded_pieces(trail(spark, [5, 5]).filter("false")).count() == 0


@pytest.mark.parametrize("east", [1, -1])
def test_direction(spark, east):
    pieces = heatmap.graded_pieces(trail(spark, [5] * 10))
    cells = [("mtb", 436000, 38000 + 2 * i, 5 if i == 3 else 9, east * 10.0, 0.0, 20.0, 4 if i == 3 else 1, 6 if i == 3 else 2) for i in range(10)]
    flows = spark.createDataFrame(cells, "sport string, ilat long, ilon long, passes long, rx double, ry double, rw double, forward long, backward long")
    r = heatmap.directed(pieces, flows).collect()[0]
    assert (r["oneway_score"], r["forward_count"], r["backward_count"]) == (0.5, 6, 4)
    assert (r["lon"][0] < r["lon"][-1]) == (east == 1) and len(r["lon"]) == 10
    r = heatmap.directed(pieces, flows.filter("sport = 'road'")).collect()[0]
    assert (r["oneway_score"], r["forward_count"], r["backward_count"]) == (0.0, 0, 0) and r["lon"][0] < r["lon"][-1]


def test_trails_of_the_table(spark):
    """Every gated point of runs of two or more is drawn, or lies on the line between two that are, and heat is on the
    lattice's scale; nothing is drawn that the mask hides."""
    dense = prepared(spark, SF)
    gated = over(queries._GATED, dense).collect()
    runs = {}
    for g in gated:
        runs.setdefault((g["activity_id"], g["run"]), []).append(g)
    rows = queries.k28_k33_trails(spark, SF).collect()
    drawn = {}
    for r in rows:
        drawn.setdefault((r["activity_id"], r["run"]), []).append(r)
    assert drawn.keys() == {k for k, v in runs.items() if len(v) >= 2} and rows
    for k, pieces in drawn.items():
        own = {(g["lon"], g["lat"]) for g in runs[k]}
        assert all((x, y) in own for p in pieces for x, y in zip(p["lon"], p["lat"]))
        lines = [np.column_stack([p["lon"], p["lat"]]) for p in pieces]
        for g in runs[k]:
            assert min(matching.to_line(np.array([[g["lon"], g["lat"]]]) * geo.DEGREE_M, x * geo.DEGREE_M)[0] for x in lines) < 1e-3
    eff = sorted(r["eff"] for r in over(queries._LATTICE, dense).collect())
    top = max(1, eff[math.ceil(0.999 * len(eff)) - 1])
    assert all(r["heat_score"] == pytest.approx(min(1, math.log1p(r["eff"]) / math.log1p(top)), abs=6e-4) for r in rows)
    ends = {}
    for f in queries._fixes(spark, SF).collect():
        ends.setdefault(f["activity_id"], []).append((f["seq"], f["lon"], f["lat"]))
    for r in rows:
        for _, lon, lat in (min(ends[r["activity_id"]]), max(ends[r["activity_id"]])):
            assert geo.metres(lon, lat, np.array(r["lon"]), np.array(r["lat"])).min() > RADIUS_M - 0.1
    found = queries.s26_vector_tiles(spark, SF).collect()
    assert {t["z"] for t in found} >= {14, 15} and all(t["dropped"] == 0 and len(t["tile"]) == t["bytes"] for t in found)
    raster = queries.t05_t09_raster_tiles(spark, SF).collect()
    assert {t["sport"] for t in raster} >= {None, "gravel"} and all(bytes(t["png"][:4]) == b"\x89PNG" for t in raster)


def test_stripping_keeps_corners(spark):
    pieces = heatmap.graded_pieces(trail(spark, [5] * 10))
    assert [len(r["lon"]) for r in heatmap.stripped(pieces).collect()] == [2]
    assert heatmap.stripped(pieces.filter("false")).collect() == []

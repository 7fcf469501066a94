import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import intervals, privacy, queries, shapes
from waymark.sources import gpx
from waymark.streaming import revisions


def line(n, step_m=20.0, lat=43.6):
    lon = 3.8 + np.arange(n) * step_m / (geo.DEGREE_M * math.cos(math.radians(lat)))
    return lon, np.full(n, lat)


def test_hilbert_ids_run_through_each_zoom():
    assert [geo.hilbert_tile_id(0, 0, 0)] + [geo.hilbert_tile_id(1, *t) for t in ((0, 0), (0, 1), (1, 1), (1, 0))] == [0, 1, 2, 3, 4]
    for z in (2, 3, 5):
        by = sorted((geo.hilbert_tile_id(z, x, y), x, y) for x in range(1 << z) for y in range(1 << z))
        assert [i for i, _, _ in by] == list(range(by[0][0], by[0][0] + 4**z))
        assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(by, by[1:]))


def test_mask_hides_both_ends_and_cuts_on_the_circle():
    lon, lat = line(200)
    pieces = privacy.masked_pieces(lon, lat, np.zeros(200, int), 200.0)
    assert len(pieces) == 1
    for end in (0, -1):
        gap = geo.metres(lon[end], lat[end], pieces[0][:, 0], pieces[0][:, 1])
        assert gap.min() >= 199.9


def test_mask_covers_a_loop_past_home_and_jitter():
    lon, lat = line(150)
    loop = np.concatenate([lon, lon[::-1], lon]), np.concatenate([lat, lat[::-1], lat])
    rng = np.random.default_rng(3)
    for x, y in (loop, (np.concatenate([lon[0] + rng.normal(0, 5e-5, 80), lon]), np.concatenate([lat[0] + rng.normal(0, 5e-5, 80), lat]))):
        for p in privacy.masked_pieces(x, y, np.zeros(len(x), int), 200.0):
            assert geo.metres(x[0], y[0], p[:, 0], p[:, 1]).min() >= 199.5


def test_mask_small_cases():
    lon, lat = line(5)
    assert privacy.masked_pieces(lon, lat, np.zeros(5, int), 200.0) == []
    assert privacy.masked_pieces(lon[:1], lat[:1], np.zeros(1, int), 200.0) == []
    assert len(privacy.masked_pieces(lon, lat, np.array([0, 0, 0, 1, 1]), 0)) == 2


def test_elevation_gain():
    assert shapes.elevation_gain([1, np.nan, 2]) == 0
    assert shapes.elevation_gain([0, 2, 4, 6]) == 4
    rng = np.random.default_rng(1)
    assert shapes.elevation_gain(100 + rng.normal(0, 0.8, 500)) < 10
    assert 90 < shapes.elevation_gain(np.linspace(0, 100, 400) + rng.normal(0, 0.5, 400)) < 110


def test_simplify_keeps_ends_and_corners():
    lon, lat = line(50)
    assert shapes.simplify(lon, lat).tolist() == [0, 49]
    lat = lat.copy()
    lat[25] += 0.001
    assert 25 in shapes.simplify(lon, lat)
    assert shapes.simplify(lon[:2], lat[:2]).tolist() == [0, 1]
    ele = np.where(np.arange(50) == 20, 50.0, 0.0)
    assert 20 in shapes.simplify(lon, np.full(50, 43.6), ele)


def test_level_pieces_absorb_flicker():
    far = np.arange(60) * 10.0
    level = np.where(np.arange(60) < 30, 10, 40)
    assert shapes.level_pieces(level, level, far) == [(0, 30), (30, 59)]
    flicker = np.where(np.arange(60) % 20 == 5, 40, 10)
    assert shapes.level_pieces(flicker, flicker, far) == [(0, 59)]


def test_density_points_start_anew():
    lon, lat = line(30, 8.0)
    at = shapes.density_points(lon, lat, 20.0)
    assert at[0] == 0 and set(np.diff(at)) == {3}


def test_interval_joins_match_brute_force(spark):
    rng = np.random.default_rng(0)
    a = pd.DataFrame({"i": range(60), "u": rng.integers(0, 3, 60), "t": pd.to_datetime(rng.integers(0, 3000, 60), unit="s")})
    b = pd.DataFrame({"j": range(60), "u": rng.integers(0, 3, 60), "s": pd.to_datetime(rng.integers(0, 3000, 60), unit="s")})
    got = intervals.bucketed_interval_join(spark.createDataFrame(a), spark.createDataFrame(b), "t", "s", 60, ["u"]).select("i", "j").collect()
    want = {(x.i, y.j) for x in a.itertuples() for y in b.itertuples() if x.u == y.u and abs((x.t - y.s).total_seconds()) <= 60}
    assert sorted(map(tuple, got)) == sorted(want)
    near = dict(map(tuple, intervals.nearest_in_time(spark.createDataFrame(a), spark.createDataFrame(b), "i", "j", "t", "s", 60, ["u"]).collect()))
    for i in a.i:
        gaps = sorted((abs((a.t[i] - b.s[j]).total_seconds()), j) for x, j in want if x == i)
        tied = [j for g, j in gaps if g == gaps[0][0]] if gaps else []
        assert near.get(i) == (tied[0] if len(tied) == 1 else None)


def test_gpx_files(spark, tmp_path):
    (tmp_path / "a.gpx").write_text('<gpx xmlns="x"><trk><name>Ride</name><type>gravel</type><trkseg><trkpt lat="43.6" lon="3.8"><ele>10</ele><time>2024-01-01T00:00:00Z</time></trkpt><trkpt lat="99" lon="3.8"/></trkseg></trk></gpx>')
    (tmp_path / "b.gpx").write_text('<!DOCTYPE x><gpx/>')
    (tmp_path / "c.gpx").write_text("<gpx>")
    rows = {r["path"][-5]: r for r in gpx.read_gpx(spark, str(tmp_path)).collect()}
    assert rows["a"]["name"] == "Ride" and rows["a"]["ele"] == 10 and rows["a"]["error"] is None
    assert "refused" in rows["b"]["error"] and "malformed" in rows["c"]["error"]


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, 7, "click", "2024-01-01 00:00:01"), (1, 7, "click", "2024-01-01 00:00:01"), (2, 8, "view", "2024-01-01 00:00:02")], "event_id long, user_id long, event_type string, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def drain(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert len(drain(revisions.deduplicated(source()), "once", "append")) == 2
    assert {tuple(r) for r in drain(revisions.revisions(source()), "revised", "update")} == {(7, 1, 2), (8, 1, 1)}


def test_near_twins_across_arrivals(spark, tmp_path):
    day = "2024-01-01 "
    arrivals = [[(1, 1, day + "08:00:00", 1000.0), (1, 2, day + "08:04:00", 1030.0), (1, 3, day + "08:04:00", 2000.0), (2, 4, day + "08:00:00", 1000.0)], [(1, 5, day + "08:04:59", 990.0), (1, 6, day + "08:06:00", 1000.0), (2, 7, day + "07:56:00", 960.0), (2, 8, day + "07:56:00", 500.0)]]
    schema = "user_id long, activity_id long, started string, distance_m double"
    for k, rows in enumerate(arrivals):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = revisions.near_deduplicated(stream).writeStream.outputMode("append").format("memory").queryName("twins").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(r["activity_id"] for r in spark.table("twins").collect())
    kept = []
    for rows in arrivals:  # the order of files is that of their names
        for u, a, t, d in sorted(rows, key=lambda r: (r[2], r[1])):
            if not any(u == v and abs((pd.Timestamp(t) - pd.Timestamp(s)).total_seconds()) <= 300 and abs(d - e) <= 0.05 * max(d, e) for v, _, s, e in kept):
                kept.append((u, a, t, d))
    assert got == sorted(a for _, a, _, _ in kept) == [1, 3, 4, 6, 8]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_operator_queries_have_rows(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0

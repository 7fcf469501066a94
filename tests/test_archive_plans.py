"""Plans of archives with listings, tile pyramids, whole recordings, French dates."""

import json
import zipfile

from pyspark.sql import functions as F

from waymark.sources import archives, gpx, listings, tilefiles


def packed(path, files):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, body)


def test_plans(spark, tmp_path):
    listing = 'Activity ID,Activity Date,Activity Name,Activity Type,Filename\n1,"Mar 2, 2024, 7:30:00 AM",Tour,Ride,activities/1.gpx\n2,,"Long, name",Yoga,Activities/2.FIT.gz\n3,,x,Run,\n'
    inner = tmp_path / "inner.zip"
    packed(inner, {"a.fit": b"x" * 10})
    files = {"export/activities.csv": "﻿" + listing, "export/deep/activities.csv": "Filename\nno", "export/activities/1.gpx": "<gpx/>", "export/activities/2.fit.gz": b"x", "export/activities/9.gpx": "<gpx/>", "export/routes/5.gpx": "<gpx/>", "other/7.gpx": "<gpx/>", "__MACOSX/export/._1.gpx": "x", "export/photo.jpg": "x", "export/more.zip": inner.read_bytes()}
    tmp_path = tmp_path / "in"
    tmp_path.mkdir()
    packed(tmp_path / "whole.zip", files)
    packed(tmp_path / "half.zip", {**files, "export/activities.csv": "Activity Name,Filename\nx,activities/1.gpx\n"})
    packed(tmp_path / "plain.zip", {"routes/1.gpx": "<gpx/>", "a.fit": b"x"})
    packed(tmp_path / "evil.zip", {"../x.gpx": "<gpx/>", "a.gpx": "<gpx/>"})
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    directory, listed = archives.read_directories(spark, str(tmp_path)), archives.read_archive_listings(spark, str(tmp_path))
    plans = archives.planned(directory, listed)
    got = {(r["archive"].rsplit("/", 1)[1], r["member"]): (r["plan"], r["listed"], r["error"]) for r in plans.collect()}
    of = lambda a: {m: v[0] for (x, m), v in got.items() if x == a}
    assert of("whole.zip") == {"export/activities.csv": "none", "export/deep/activities.csv": "none", "export/activities/1.gpx": "activity", "export/activities/2.fit.gz": "activity", "export/activities/9.gpx": "unlisted", "export/routes/5.gpx": "route", "other/7.gpx": "activity", "__MACOSX/export/._1.gpx": "none", "export/photo.jpg": "none", "export/more.zip": "archive"}
    assert got["whole.zip", "export/activities/2.fit.gz"][1] and not got["whole.zip", "export/activities/9.gpx"][1]
    assert of("half.zip")["export/activities/9.gpx"] == "activity" and of("half.zip")["export/routes/5.gpx"] == "route"
    assert of("plain.zip") == {"routes/1.gpx": "activity", "a.fit": "activity"}
    assert of("evil.zip") == {"../x.gpx": "none", "a.gpx": "none"} and "leaves" in got["evil.zip", "a.gpx"][2]
    n = {r["archive"].rsplit("/", 1)[1]: r["members"] for r in archives.estimated_members(plans).collect()}
    assert n == {"whole.zip": 4, "half.zip": 5, "plain.zip": 2, "evil.zip": 0}
    rows = [r for r in listed.collect() if "whole" in r["archive"]]
    assert [(r["filename"], r["type"]) for r in rows if r["filename"]] == [("activities/1.gpx", "Ride"), ("Activities/2.FIT.gz", "Yoga")]
    assert {r["root"] for r in rows} == {"export/"} and [r["complete"] for r in rows if not r["filename"]] == [True]
    assert [r["complete"] for r in listed.collect() if "half" in r["archive"]] == [False]


def test_pyramid(spark, tmp_path):
    root = f"file://{tmp_path}/tiles"
    tiles = spark.createDataFrame([(z, x, y, bytes([z, x, y])) for z in (6, 7) for x in range(3) for y in range(2)], "z int, x long, y long, png binary")
    tilefiles.write_pyramid(tiles, root)
    assert (tmp_path / "tiles/7/2/1.png").read_bytes() == bytes([7, 2, 1]) and len(list(tmp_path.rglob("*.png"))) == 12
    assert tilefiles.purge_pyramid(tiles.filter("z = 6"), root) == 6 and len(list(tmp_path.rglob("*.png"))) == 6
    assert tilefiles.purge_pyramid(tiles.filter("z = 6"), root) == 0
    about = tilefiles.tile_json(tiles, "https://example.org/{z}/{x}/{y}.png", (3.123456, 43.0, 4.0, 44.0), "map", "all")
    assert json.loads(json.dumps(about))["bounds"] == [3.12346, 43.0, 4.0, 44.0] and (about["minzoom"], about["maxzoom"], about["center"][2]) == (6, 7, 7)


def test_recordings(spark, tmp_path):
    track = '<gpx><trk><name>Tour</name><type>gravel_ride</type><trkseg><trkpt lat="43.6" lon="3.8"><ele>10</ele><time>2024-05-01T08:00:00Z</time></trkpt><trkpt lat="43.601" lon="3.8"><ele>110</ele></trkpt></trkseg></trk><rte><rtept lat="1" lon="1"/></rte></gpx>'
    (tmp_path / "a.gpx").write_text(track)
    (tmp_path / "b.gpx").write_text('<gpx><trk/><rte><name>Plan</name><rtept lat="43.6" lon="3.8"/><rtept lat="43.601" lon="3.8"/></rte></gpx>')
    (tmp_path / "c.gpx").write_text("<gpx>")
    (tmp_path / "d.gpx").write_text("<gpx/>")
    got = {r["path"][-5]: r for r in gpx.recordings(gpx.read_gpx(spark, str(tmp_path))).collect()}
    flat = 111.1949
    assert abs(got["a"]["distance_m"] - (flat**2 + 100**2) ** 0.5) < 0.01 and (got["a"]["sport"], got["a"]["skip"], got["a"]["n"]) == ("gravel", False, 2)
    assert str(got["a"]["started"]) == "2024-05-01 08:00:00" and got["a"]["climb_m"] == 0.0
    assert got["b"]["name"] == "Plan" and abs(got["b"]["distance_m"] - flat) < 0.01 and got["b"]["sport"] is None
    assert "malformed" in got["c"]["error"] and "d" not in got


def test_spelled_dates(spark):
    said = {"Mar 2, 2024, 7:30:00 AM": "2024-03-02 07:30:00", "2 mars 2024, 07:30:00": "2024-03-02 07:30:00", "14 févr. 2023 à 1:02:03": None, "1 août 2022 9:00:00": "2022-08-01 09:00:00", "31 Déc. 2021, 23:59:59": "2021-12-31 23:59:59", "2 marz 2024, 07:30:00": None, "2024-03-02T07:30:00Z": "2024-03-02 07:30:00", "2 mars 1999, 07:30:00": None, "": None, "32 mai 2024, 1:00:00": None}
    df = spark.createDataFrame([(k,) for k in said], "t string")
    got = {r["t"]: r["d"] and str(r["d"]) for r in df.select("t", listings.listing_date(F.col("t"), 2025).alias("d")).collect()}
    assert got == said

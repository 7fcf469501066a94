import gzip
import io
import sqlite3
import zipfile

from waymark.sources import archives, gpx, tilefiles


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("activities/1.gpx", "<gpx/>")
        z.writestr("activities/2.GPX.gz", gzip.compress(b"<gpx>2</gpx>"))
        z.writestr("activities/3.fit.gz", b"broken")
        z.writestr("routes/4.gpx", "<gpx/>")
        z.writestr("__MACOSX/1.gpx", "x")
        z.writestr("media/photo.jpg", "x")
        z.writestr("../evil.gpx", "x")
    (tmp_path / "b.zip").write_bytes(b"no zip")
    found = archives.read_archives(spark, str(tmp_path))
    rows = {r["member"]: r for r in found.collect()}
    assert {k: r["kind"] for k, r in rows.items() if k} == {"activities/1.gpx": "activity", "activities/2.GPX.gz": "activity", "activities/3.fit.gz": "activity", "routes/4.gpx": "route", "__MACOSX/1.gpx": "junk", "media/photo.jpg": "other", "../evil.gpx": "unsafe"}
    assert bytes(rows["activities/2.GPX.gz"]["content"]) == b"<gpx>2</gpx>" and rows["activities/3.fit.gz"]["error"] and rows["../evil.gpx"]["content"] is None
    assert "not an archive" in rows[None]["error"]
    listing = spark.createDataFrame([("Activities/1.gpx", "gravel"), ("activities/2.gpx.gz", None)], "filename string, sport string")
    state = {r["member"]: (r["csv_listed"], r["csv_sport"]) for r in archives.listed(found, listing).collect()}
    assert state["activities/1.gpx"] == (True, "gravel") and state["activities/2.GPX.gz"] == (True, None) and state["routes/4.gpx"] == (False, None)


def test_nested_archives():
    def packed(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in files.items():
                z.writestr(name.replace("_", "."), data)
        return out.getvalue()

    rows = list(archives.members("a", packed(a_gpx=b"1", in_zip=packed(b_gpx=b"2", deep_zip=packed(c_gpx=b"3")), bad_zip=b"no")))
    assert [(r[1], r[2], r[3]) for r in rows] == [("a.gpx", "activity", b"1"), ("in.zip/b.gpx", "activity", b"2"), ("in.zip/deep.zip", "archive", None), ("bad.zip", None, None)]
    assert "not an archive" in rows[3][4]


def test_curated_folder(spark, tmp_path):
    doc = "<gpx><trk><name>{}</name><trkseg>{}</trkseg></trk></gpx>"
    pts = lambda *p: "".join(f'<trkpt lat="{y}" lon="{x}"/>' for x, y in p)
    (tmp_path / "GRAVEL_North_1.gpx").write_text(doc.format(" One ", pts((3, 43), (3, 44))))
    (tmp_path / "GRAVEL_x.gpx").write_text(doc.format("", pts((3, 43))))
    (tmp_path / "far.gpx").write_text(doc.format("far", pts((3, 43), (3, 80))))
    (tmp_path / "bad.gpx").write_text("<gpx>")
    rows = gpx.curated(gpx.read_gpx(spark, str(tmp_path)), {"GRAVEL": "gravel", "GRAVEL_North": "mtb"}).collect()
    assert {(r["name"], r["sport"], round(r["km"])) for r in rows} == {("One", "mtb", 111), ("GRAVEL_x", "gravel", 0)}


def test_tile_files(spark, tmp_path):
    rows = [(7, x, y, bytes([x, y])) for x in (0, 31, 32) for y in (0, 127)] + [(0, 0, 0, b"top"), (7, 1, None, b"")]
    files = tilefiles.mbtiles(spark.createDataFrame(rows, "z int, x long, y long, png binary"), "png", "png").collect()
    assert len(files) == 5 and sum(f["n"] for f in files) == 7
    got = {}
    for f in files:
        db = sqlite3.connect(":memory:")
        db.deserialize(bytes(f["content"]))
        got |= {(z, x, (1 << z) - 1 - y): t for z, x, y, t in db.execute("SELECT * FROM tiles")}
    assert got == {(z, x, y): t for z, x, y, t in rows if y is not None}

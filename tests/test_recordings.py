import datetime
import gzip
import json
import struct

import pytest

from waymark.sources import fit, listings


def fit_file(points, sport=2, sub_sport=8, maker=1, odd=False, little=True):
    """A FIT file with a file id, records (lat, lon, height or None) and a session of 12.34 m."""
    o, order = (b"\x00", "<") if little else (b"\x01", ">")
    define = lambda local, number, fields: bytes([0x40 | local, 0]) + o + struct.pack(order + "HB", number, len(fields)) + b"".join(bytes(f) for f in fields)
    body = define(0, fit.FILE_ID, [(1, 2, 0x84)]) + b"\x00" + struct.pack(order + "H", maker)
    fields = [(253, 4, 0x86), (0, 4, 0x85), (1, 4, 0x85), (2, 2, 0x84)] + ([(99, 1, 0x86)] if odd else [])
    body += define(1, fit.RECORD, fields)
    for i, (lat, lon, ele) in enumerate(points):
        raw = 0xFFFF if ele is None else round((ele + 500) * 5)
        body += b"\x01" + struct.pack(order + "IiiH", 1_000_000_000 + i, round(lat * 2**31 / 180), round(lon * 2**31 / 180), raw) + (b"\x07" if odd else b"")
    body += define(2, fit.SESSION, [(9, 4, 0x86), (5, 1, 0), (6, 1, 0)]) + b"\x02" + struct.pack(order + "IBB", 1234, sport, sub_sport)
    head = struct.pack("<BBHI4s", 12, 16, 0, len(body), b".FIT")
    return head + body + struct.pack("<H", fit.crc16(head + body))


LINE = [(43.6, 3.8, 100.0), (0.0, 0.0, 100.0), (43.601, 3.8, 104.0), (43.602, 3.8, None), (43.603, 3.8, 103.0), (43.604, 3.8, 105.4)]


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("little", [False, True])
def test_parse_fit(odd, little):
    found = fit.parse_fit(fit_file(LINE, odd=odd, little=little))
    assert len(found["points"]) == 5 and found["invalid"] == 1 and found["distance_m"] == 12.34
    assert found["climb_m"] == pytest.approx(6.4) and (found["sport"], found["sub_sport"], found["skipped"]) == (2, 8, None)
    assert found["points"][1] == (pytest.approx(3.8, abs=1e-6), pytest.approx(43.601, abs=1e-6), 104.0)
    assert found["started"].timestamp() == 1_000_000_000 + fit.EPOCH


def test_fit_skips_chains_and_faults():
    assert fit.crc16(b"123456789") == 0xBB3D
    assert fit.parse_fit(fit_file(LINE, sub_sport=58))["skipped"] == "virtual_activity"
    assert fit.parse_fit(fit_file(LINE, maker=260))["skipped"] == "zwift"
    assert len(fit.parse_fit(fit_file(LINE) + fit_file(LINE[2:]))["points"]) == 9
    good = fit_file(LINE)
    for bad in (b"", b"nonsense", good[:-3], good[:40] + b"\x13" + good[41:]):
        with pytest.raises(ValueError):
            fit.parse_fit(bad)
    with pytest.raises(ValueError, match="too large"):
        list(fit.messages(good, limit=10))


def test_read_fit(spark, tmp_path):
    (tmp_path / "a.fit").write_bytes(fit_file(LINE))
    (tmp_path / "b.fit").write_bytes(b"broken")
    (tmp_path / "c.fit").write_bytes(fit_file([]))
    rows = fit.read_fit(spark, str(tmp_path)).collect()
    by = {n: [r for r in rows if r["path"].endswith(n)] for n in ("a.fit", "b.fit", "c.fit")}
    assert [r["seq"] for r in by["a.fit"]] == [0, 1, 2, 3, 4] and by["a.fit"][2]["ele"] is None
    assert by["b.fit"][0]["error"] and by["b.fit"][0]["lon"] is None
    assert len(by["c.fit"]) == 1 and by["c.fit"][0]["seq"] is None and by["c.fit"][0]["distance_m"] == 12.34


def test_listing(spark, tmp_path):
    (tmp_path / "en.csv").write_text('﻿Activity ID,Activity Date,Activity Name,Activity Type,Filename\n1,"Mar 2, 2024, 7:30:00 AM","a ""b"",\nc",Ride,activities/1.gpx\n2,never,x,Run,activities/2.gpx\n3,"Mar 2, 1999, 7:30:00 AM",x,Run,activities/3.gpx\n4,2024-03-02T07:30:00Z,x,,activities/4.gpx\n5,,x,,\n')
    (tmp_path / "fr.csv").write_text("Date de l'activité,Nom du fichier,Type d'activité\n\"2 févr. 2024, 17:30:00\",7.gpx,Vélo\n\"31 août 2024 07:30:00\",8.gpx,Vélo\n")
    en = {r["filename"]: r for r in listings.read_listing(spark, str(tmp_path / "en.csv"), 2026).collect()}
    half_past = datetime.datetime(2024, 3, 2, 7, 30)
    assert {k: r["date"] for k, r in en.items()} == {"activities/1.gpx": half_past, "activities/2.gpx": None, "activities/3.gpx": None, "activities/4.gpx": half_past}
    assert en["activities/1.gpx"]["name"] == 'a "b",\nc' and en["activities/4.gpx"]["type"] is None
    fr = {r["filename"]: (r["date"], r["type"], r["name"]) for r in listings.read_listing(spark, str(tmp_path / "fr.csv"), 2026).collect()}
    assert fr == {"7.gpx": (datetime.datetime(2024, 2, 2, 17, 30), "Vélo", None), "8.gpx": (datetime.datetime(2024, 8, 31, 7, 30), "Vélo", None)}


def test_summaries(spark, tmp_path):
    whole = json.dumps([{"summarizedActivitiesExport": [{"beginTimestamp": 1_700_000_000_000.0, "activityType": {"typeKey": "cycling"}, "name": " a "}, {"startTimeGmt": True, "activityType": "run"}]}])
    (tmp_path / "whole.json").write_text(whole)
    (tmp_path / "cut.json").write_text(whole[: whole.index('{"startTimeGmt"') + 9])
    (tmp_path / "none.json").write_text("no list")
    rows = sorted(((r["path"].rsplit("/", 1)[1], r["started"], r["type"], r["name"], r["complete"]) for r in listings.read_summaries(spark, str(tmp_path)).collect()), key=repr)
    assert rows == sorted([("whole.json", 1.7e9, "cycling", "a", True), ("whole.json", None, "run", None, True), ("cut.json", 1.7e9, "cycling", "a", True), ("cut.json", None, None, None, False)], key=repr)


def test_open_data(spark, tmp_path):
    rows = [{"type": "Feature", "properties": {"highway": "track", "id": 1}, "geometry": {"type": "LineString", "coordinates": [[3.0, 43.0], [3.1, 43.1]]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "MultiLineString", "coordinates": [[[5, 45], [5, 46]], [[7, 7, 1], [8, 8, 1]]]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]
    (tmp_path / "ways.geojsonseq").write_text("".join("\x1e" + json.dumps(r) + "\n" for r in rows) + "broken\n")
    found = listings.read_tracks(spark, str(tmp_path / "ways.geojsonseq"))
    assert sorted((r["part"], r["coords"][0][0]) for r in found.collect()) == [(0, 3.0), (0, 5.0), (1, 7.0)]
    assert [r["properties"]["highway"] for r in found.filter(listings.in_bbox("coords", 2, 42, 3.05, 44)).collect()] == ["track"]
    with gzip.open(tmp_path / "f.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r["a"] for r in listings.read_fixture(spark, str(tmp_path / "f.jsonl.gz"), "a long").collect()) == [1, 2]

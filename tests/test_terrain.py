import struct

import pytest

from waymark.plans import upkeep
from waymark.plans.dialect import spark_query
from waymark.sources import gpx, terrain


def test_heights(spark, tmp_path):
    n = 1201
    value = lambda r, c: terrain.VOID if (r, c) == (5, 5) else (r * 7 + c) % 500 - 200
    (tmp_path / "N43E003.hgt").write_bytes(b"".join(struct.pack(f">{n}h", *[value(r, c) for c in range(n)]) for r in range(n)))
    (tmp_path / "S01W002.hgt").write_bytes(b"short")
    points = [(1, 3.0, 43.0), (2, 3.9999, 43.9999), (3, 3.25, 43.5), (4, 3 + 5.5 / 1200, 44 - 5.5 / 1200), (5, -1.5, -0.5), (6, None, 43.0), (7, 3.0, 44.0)]
    df = spark.createDataFrame(points, "id long, lon double, lat double")
    got = {r["id"]: r["height"] for r in terrain.with_height(df, terrain.read_terrain(spark, str(tmp_path))).collect()}
    assert got == {1: value(1200, 0), 2: value(0, 1199), 3: value(600, 300), 4: None, 5: None, 6: None, 7: None}


@pytest.mark.parametrize("name", ["s29_gpx_documents", "s30_trip_documents"])
def test_documents_are_read_back(spark, name):
    rows = spark_query(upkeep.SQL[name])(spark, "/root/testdata/sf0.001").collect()
    for r in rows[:20]:
        _, _, points = gpx.parse_gpx(r["document"].encode())
        assert len(points) == r["document"].count("<trkpt") > 0

"""Trace queries without an oracle, told again from their fixes a trace at a time, at ids of the first block and far on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark import catalog
from waymark.functions import geo
from waymark.operators import prepare, privacy, queries, tiles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=[0, 104_000_000])
def folder(request, spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("golden"))
    spark.read.parquet(f"{SF}/events.parquet").withColumn("event_id", F.col("event_id") + request.param).write.parquet(f"{at}/events.parquet")
    return at


def test_radial_mask(spark, folder):
    want = {}
    traces: dict = {}
    for r in queries._runs(spark, folder).orderBy("activity_id", "seq").collect():
        traces.setdefault(r["activity_id"], []).append((r["lon"], r["lat"], r["run_id"]))
    for key, fixes in traces.items():
        lon, lat, run = (np.array(c) for c in zip(*fixes))
        for k, piece in enumerate(p for p in privacy.masked_pieces(lon, lat, run, 40.0) if len(p) >= 2):
            want.update({(key, k, i): tuple(p) for i, p in enumerate(piece.tolist())})
    got = {(r["activity_id"], r["piece"], r["point"]): (r["lon"], r["lat"]) for r in catalog.QUERIES["k09_radial_mask"](spark, folder).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    assert all(np.allclose(got[k], want[k], rtol=0, atol=1e-10) for k in got)


def test_shared_lines_keep_away_from_ends(spark, folder):
    """No drawn point of a shared line lies within the radius of the first or last fix of its trace."""
    ends = {}
    for r in queries._shared(spark, folder).orderBy("activity_id", "seq").collect():
        first, _ = ends.setdefault(r["activity_id"], [(r["lon"], r["lat"]), None])
        ends[r["activity_id"]] = [first, (r["lon"], r["lat"])]
    lines = catalog.QUERIES["k47_s32_share_features"](spark, folder)
    rows = lines.collect()
    assert rows
    key = "activity_id" if "activity_id" in lines.columns else None
    for r in rows:
        for lon, lat in _points(r):
            near = [min(geo.metres(*e, lon, lat) for e in pair) for k, pair in ends.items() if key is None or k == r[key]]
            assert key is None or min(near) >= 39


def _points(row):
    import json

    for v in row:
        if isinstance(v, str) and '"coordinates"' in v:
            found = json.loads(v)["geometry"]["coordinates"] if '"geometry"' in v else json.loads(v)["coordinates"]
            lines = found if isinstance(found[0][0], list) else [found]
            yield from (p[:2] for line in lines for p in line)


def test_smooth_tiles_lie_where_the_legs_do(spark, folder):
    legs = {(r["x"], r["y"]) for r in tiles.tile_legs(queries._trails(spark, folder), [13]).select("x", "y").distinct().collect()}
    rows = catalog.QUERIES["t06_t08_smooth_tiles"](spark, folder).collect()
    assert {(r["x"], r["y"]) for r in rows if r["z"] == 13} == legs
    assert {(r["x"] >> 1, r["y"] >> 1) for r in rows if r["z"] == 14} == legs
    assert all(0 < r["covered"] <= 65536 for r in rows) and prepare.DENSE

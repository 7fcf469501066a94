import gzip
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import tiles
from waymark.sources import listings, tilefiles

SCHEMA = "sport string, lon array<double>, lat array<double>, user_count long, pass_count long, heat_score double"
ZOOMS, GRID = [6, 12, 14], 512


def world(lon, lat, z):
    s = min(0.9999, max(-0.9999, math.sin(math.radians(lat))))
    n = 2**z * GRID
    return math.floor((lon + 180) / 360 * n), math.floor((0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)) * n)


def brute(lines):
    out = {}
    for sport, lon, lat, *values in lines:
        if None in (*lon, *lat):
            continue
        for z in ZOOMS:
            at = [world(x, y, z) for x, y in zip(lon, lat)]
            for p, q in zip(at, at[1:]):
                if p == q:
                    continue
                (ax, ay), (bx, by) = sorted((p, q))
                n = max(1, math.ceil(max(abs(bx - ax), abs(by - ay)) * 4 / GRID))
                for tx, ty in {(math.floor((ax + (bx - ax) * k / n) / GRID), math.floor((ay + (by - ay) * k / n) / GRID)) for k in range(n + 1)}:
                    key = (z, tx, ty, sport, ax - tx * GRID, ay - ty * GRID, bx - tx * GRID, by - ty * GRID)
                    out[key] = tuple(max(a, b) for a, b in zip(out.get(key, values), values))
    return out


@pytest.fixture(scope="module")
def lines():
    rng = np.random.default_rng(5)
    out = [("gravel", [3.8, None], [43.6, 43.7], 9, 9, 0.9), ("gravel", [3.8], [43.6], 9, 9, 0.9), ("mtb", [], [], 9, 9, 0.9), ("gravel", [3.8, 3.8], [43.6, 43.6], 9, 9, 0.9)]
    for k in range(12):
        step = rng.normal(0, 2e-3 if k % 2 else 2e-4, (2, 60)).cumsum(axis=1)
        out += [(["gravel", "mtb"][k % 3 == 0], (3.8 + step[0]).tolist(), (43.6 + step[1]).tolist(), k + 1, 5 * k + 1, k / 12)] * (2 if k == 3 else 1)
    back = out[-1]
    return [*out, (back[0], back[1][::-1], back[2][::-1], 90, 91, 0.95)]


@pytest.fixture(scope="module")
def legs(spark, lines):
    return tiles.tile_legs(spark.createDataFrame(lines, SCHEMA), ZOOMS, GRID).cache()


def test_tile_legs(lines, legs):
    got = {(r["z"], r["x"], r["y"], r["sport"], *[r[c] for c in tiles.ENDS]): tuple(r[v] for v in tiles.VALUES) for r in legs.collect()}
    assert got == brute(lines) and len(got) == legs.count()


def test_vector_tiles_round_trip(legs):
    want = {}
    for r in legs.collect():
        want.setdefault((r["z"], r["x"], r["y"]), []).append(((r["x0"], r["y0"]), (r["x1"], r["y1"])))
    got = {(r["z"], r["x"], r["y"]): tilefiles.lines_of(bytes(r["tile"])) for r in tiles.vector_tiles(legs, GRID).collect()}
    assert got.keys() == want.keys()
    for k, layers in got.items():
        assert layers[0][0] == GRID and sorted(map(tuple, layers[0][1])) == sorted(want[k])
    rank = lambda r: (-r["pass_count"], -r["user_count"])
    ranks: dict = {}
    for r in legs.collect():
        ranks.setdefault((r["z"], r["x"], r["y"]), []).append(rank(r))
    few = tiles.vector_tiles(legs, GRID, most_bytes=150).collect()
    assert any(r["dropped"] for r in few)
    for r in few:
        found = want[r["z"], r["x"], r["y"]]
        assert r["legs"] + r["dropped"] == len(found) and (len(r["tile"]) <= 150 or r["legs"] == 1)


def test_raster_tiles(spark, lines):
    legs = tiles.tile_legs(spark.createDataFrame(lines, SCHEMA), [12], 256)
    rows = tiles.raster_tiles(legs).collect()
    assert {(r["x"], r["y"]) for r in rows} == {(r["x"], r["y"]) for r in legs.select("x", "y").distinct().collect()}
    for r in rows:
        body = bytes(r["png"])
        at = body.index(b"IDAT")
        raw = zlib.decompress(body[at + 4 : at + 4 + struct.unpack(">I", body[at - 4 : at])[0]])
        image = np.frombuffer(raw, np.uint8).reshape(256, 257)
        assert not image[:, 0].any() and (image[:, 1:] > 0).sum() == r["lit"] and image.max() == r["top"] == tiles.bucket(max(x["pass_count"] for x in legs.filter(F.expr(f"x = {r['x']} AND y = {r['y']}")).collect()))
    own = {r["sport"] for r in legs.collect()}
    assert own == {"gravel", "mtb"} and sum(r["lit"] for r in tiles.raster_tiles(legs, sport="mtb").collect()) < sum(r["lit"] for r in rows)


def test_tiles_of_a_box(legs):
    rows = {(r["z"], r["x"], r["y"]) for r in legs.select("z", "x", "y").distinct().collect()}
    for z, x, y in rows:
        west, east = x / 2**z * 360 - 180 + 1e-6, (x + 1) / 2**z * 360 - 180 - 1e-6
        lat = lambda r, z=z: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * r / 2**z))))
        got = {(r["z"], r["x"], r["y"]) for r in tiles.in_box(legs.filter(f"z = {z}"), west, lat(y + 1) + 1e-6, east, lat(y) - 1e-6).select("z", "x", "y").distinct().collect()}
        assert got == {(z, x, y)}
        break


def test_overzoom(legs):
    coarse = legs.filter("z = 12")
    fine = tiles.overzoom(coarse, 2, GRID)
    assert {(r["x"] >> 2, r["y"] >> 2) for r in fine.collect()} == {(r["x"], r["y"]) for r in coarse.collect()}
    place = lambda rows, up: {(r["sport"], *[(r[c[0]] * GRID + r[c]) * up for c in tiles.ENDS]) for r in rows}
    assert place(fine.collect(), 1) == place(coarse.collect(), 4)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def archive(entries, data, leaves=b""):
    columns = list(zip(*entries))
    ids = [b - a for a, b in zip((0, *columns[0]), columns[0])]
    root = gzip.compress(b"".join(map(varint, [len(entries), *ids, *columns[1], *columns[2], *[o + 1 for o in columns[3]]])))
    at = 127 + len(root)
    head = b"PMTiles\x03" + struct.pack("<8Q", 127, len(root), 0, 0, at, len(leaves), at + len(leaves), len(data))
    return (head + bytes(24) + bytes([1, 2, 2])).ljust(127, b"\0") + root + leaves + data


def test_tile_archives(spark, tmp_path):
    assert all(geo.tile_of_hilbert_id(geo.hilbert_tile_id(z, x, y)) == (z, x, y) for z in range(6) for x in range(1 << z) for y in range(1 << z))
    one, two = gzip.compress(b"one"), gzip.compress(b"two")
    leaf = gzip.compress(b"".join(map(varint, [2, 5, 2, 1, 1, len(one), len(two), 1, 0])))
    (tmp_path / "a.pmtiles").write_bytes(archive([(0, 2, len(one), 0), (5, 0, len(leaf), 0)], one + two, leaf))
    (tmp_path / "b.pmtiles").write_bytes(b"other")
    rows = tilefiles.read_tile_archives(spark, str(tmp_path)).collect()
    got = {(r["z"], r["x"], r["y"]): bytes(r["tile"]) for r in rows if not r["error"]}
    assert got == {geo.tile_of_hilbert_id(t): b for t, b in ((0, b"one"), (1, b"one"), (5, b"one"), (7, b"two"))}
    assert [r["archive"].rsplit("/", 1)[1] for r in rows if r["error"]] == ["b.pmtiles"]


def test_write_lines(spark, tmp_path):
    rows = spark.sql("SELECT 'mtb' AS sport, struct(3 AS pass_count) AS properties, array(array(3.5D, 43.5D), array(3.6D, 43.6D)) AS coordinates")
    tilefiles.write_lines(rows, str(tmp_path / "out"), by="sport")
    found = listings.read_tracks(spark, str(tmp_path / "out")).collect()
    assert [(r["properties"], r["coords"]) for r in found] == [({"pass_count": "3"}, [[3.5, 43.5], [3.6, 43.6]])]


def sampled(legs, width, size, n=12):
    """Shares of pixels within half the width of a leg, by n times n samples of each."""
    at = (np.arange(size * n) + 0.5) / n
    x, y = np.meshgrid(at, at)
    near = np.zeros(x.shape, bool)
    for x0, y0, x1, y1 in legs:
        dx, dy = x1 - x0, y1 - y0
        t = np.clip(((x - x0) * dx + (y - y0) * dy) / max(dx * dx + dy * dy, 1e-12), 0, 1)
        near |= np.hypot(x - x0 - t * dx, y - y0 - t * dy) <= width / 2
    return near.reshape(size, n, size, n).mean(axis=(1, 3))


def test_coverage_of_pixels():
    r = np.random.default_rng(3)
    for width in (1.0, 2.0, 3.0, 6.0):
        leg = [tuple(r.uniform(-5, 25, 4))]
        got, want = tiles.coverage(np.array(leg), width, 20), sampled(leg, width, 20)
        # A distance tells a slanted edge's share of a pixel to about an eighth, and whole pixels exactly.
        assert np.abs(got - want).max() < 0.3 and abs(got.sum() - want.sum()) <= 0.06 * want.sum() + 0.6
        assert (got[want == 1] > 0.85).all() and (got[want == 0] < 0.3).all()
    assert tiles.coverage(np.array([(-50.0, -50.0, -40.0, -9.0)]), 3, 20).sum() == 0
    level = tiles.coverage(np.array([(-5.0, 10.0, 25.0, 10.0)]), 2, 20)
    assert level[9:11].min() == 1 and level[:9].max() == 0 and level[11:].max() == 0


def test_smooth_drawing_is_finer_drawing_brought_down():
    rows = [(1, 5, 3, 60, 40), (1, 60, 40, 20, 62), (3, 0, 50, 63, 10), (5, 30, 30, 30, 30)]
    image = tiles.draw_smooth(rows, 64, 32, 2)
    assert image.shape == (32, 32, 4) and image[..., 3].max() == 255 and image[0, 0, 3] == 0
    for b in (1, 3, 5):
        share = sampled([tuple(v / 2 for v in r[1:]) for r in rows if r[0] == b], tiles.WIDTHS[b], 32)
        above = np.max([sampled([tuple(v / 2 for v in r[1:]) for r in rows if r[0] == c], tiles.WIDTHS[c], 32) for c in (3, 5) if c > b] or [np.zeros((32, 32))], axis=0)
        whole = (share == 1) & (above == 0)
        assert not whole.any() or np.abs(image[whole].astype(int) - [*tiles.COLOURS[b], 255]).max() <= 1
    total = sampled([tuple(v / 2 for v in r[1:]) for r in rows if r[0] == 1], tiles.WIDTHS[1], 32)
    alone = sampled([tuple(v / 2 for v in r[1:]) for r in rows if r[0] > 1], 4, 32) == 0
    assert np.abs(image[..., 3][alone] / 255 - total[alone]).mean() < 0.03


def test_smooth_tiles(legs):
    rows = tiles.smooth_tiles(legs, GRID).collect()
    assert {(r["z"], r["x"], r["y"]) for r in rows} == {(r["z"], r["x"], r["y"]) for r in legs.select("z", "x", "y").distinct().collect()}
    for r in rows:
        body = bytes(r["png"])
        at = body.index(b"IDAT")
        image = np.frombuffer(zlib.decompress(body[at + 4 : at + 4 + struct.unpack(">I", body[at - 4 : at])[0]]), np.uint8).reshape(256, 1025)[:, 1:].reshape(256, 256, 4)
        assert abs(image[..., 3].sum() / 255 - r["covered"]) < 1e-6 and 1 <= r["top"] <= 5
    fine = tiles.smooth_tiles(tiles.overzoom(legs.filter("z = 12"), 2, GRID), GRID).collect()
    coarse = [r for r in rows if r["z"] == 12]
    assert sum(r["covered"] for r in fine) > 3 * sum(r["covered"] for r in coarse)

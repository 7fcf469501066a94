"""Tile archives in parts: round trip, lookup by ranges, runs, retries, other readers."""

import gzip
import json
import random

import numpy as np
import pytest

from waymark.functions import geo
from waymark.sources import tilearchive, tilefiles

SCHEMA = "z int, x long, y long, tile binary"


def made(seed=5, n=900):
    r = random.Random(seed)
    tiles = {}
    for _ in range(n):
        z = r.randint(0, 9)
        tiles[z, r.randrange(1 << z), r.randrange(1 << z)] = r.choice([b"same", r.randbytes(r.randint(1, 80)), b""])
    for x in range(16):  # a whole zoom of one content: long runs
        for y in range(16):
            tiles[4, x, y] = b"sea"
    return tiles


def read(df):
    return {(t["z"], t["x"], t["y"]): None if t["tile"] is None else bytes(t["tile"]) for t in df.collect()}


@pytest.fixture(scope="module", params=["gzip", "none"])
def archive(request, spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('tiles')}/a.pmtiles"
    tiles = made()
    rows = [(*k, v) for k, v in tiles.items()] + [(3, 1, 1, None), (None, 1, 1, b"x")] + [(*k, v) for k, v in list(tiles.items())[:40]]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS body", "'y' AS file").repartition(7)
    manifest = tilearchive.write_archive(df, folder, compression=request.param, metadata={"name": "é"}, part_bytes=2000, leaf_entries=32)
    return folder, tiles, manifest


def test_ids_of_arrays():
    r = np.random.default_rng(2)
    z = r.integers(0, 20, 500)
    x, y = (r.integers(0, 1 << 30, 500) % (1 << z) for _ in range(2))
    assert geo.hilbert_tile_ids(z, x, y).tolist() == [geo.hilbert_tile_id(*map(int, t)) for t in zip(z, x, y)]


def test_round_trip_in_parts(spark, archive):
    folder, tiles, manifest = archive
    assert len([p for p in manifest["parts"] if p["file"].startswith("tiles")]) > 3
    assert manifest["tiles"] == len(tiles) and manifest["entries"] < len(tiles) - 200
    assert read(tilearchive.read_archive(spark, folder, rows=50)) == tiles


def test_look_up_reads_ranges(spark, archive):
    folder, tiles, _ = archive
    asked = [*list(tiles)[:300], (9, 511, 511), (9, 512, 0), (30, 1, 1), (-1, 0, 0), (2, -1, 0)]
    got = read(tilearchive.look_up(spark.createDataFrame(asked + asked[:9] + [(None, 1, 1)], "z int, x long, y long"), folder))
    assert got == {k: tiles.get(k) for k in asked}
    one = tilearchive.Archive(folder)
    before = one.reads
    assert one.tile(*next(iter(tiles))) == next(iter(tiles.values())) and one.reads - before == 2  # a leaf and a tile
    assert one.metadata == {"name": "é"} and (one.low, one.high, one.tiles) == (0, 9, len(tiles))


def test_small_cache_changes_nothing(archive):
    folder, tiles, _ = archive
    one = tilearchive.Archive(folder, keep_entries=1)
    assert all(one.tile(*k) == v for k, v in tiles.items()) and len(one.leaves) == 1


def test_joined_parts_are_an_archive(spark, archive, tmp_path):
    folder, tiles, manifest = archive
    tilearchive.joined(folder, f"file://{tmp_path}/one.pmtiles", block=1000)
    content = (tmp_path / "one.pmtiles").read_bytes()
    assert len(content) == sum(p["bytes"] for p in manifest["parts"])
    assert {(z, x, y): t for z, x, y, t in tilefiles.tiles_of(content)} == tiles
    assert read(tilefiles.read_tile_archives(spark, str(tmp_path)).drop("archive", "error")) == tiles
    assert read(tilearchive.read_archive(spark, f"file://{tmp_path}/one.pmtiles")) == tiles


def test_parts_that_no_manifest_names_are_deleted(spark, tmp_path):
    (tmp_path / "tiles-00000-999").write_bytes(b"left by an attempt")
    tilearchive.write_archive(spark.createDataFrame([(0, 0, 0, b"a")], SCHEMA), f"file://{tmp_path}")
    names = {p.name for p in tmp_path.iterdir()}
    assert names == {"manifest.json", *(p["file"] for p in json.loads((tmp_path / "manifest.json").read_bytes())["parts"])}


def test_empty_and_damaged(spark, tmp_path):
    tilearchive.write_archive(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none")
    assert tilearchive.read_archive(spark, f"file://{tmp_path}/none").collect() == []
    assert tilearchive.Archive(f"file://{tmp_path}/none").tile(0, 0, 0) is None
    (tmp_path / "bad").write_bytes(gzip.compress(b"no archive"))
    with pytest.raises(ValueError):
        tilearchive.Archive(f"file://{tmp_path}/bad")


def test_root_entries_without_leaves(spark, tmp_path):
    """Small archives of other writers hold their tiles' entries in the root itself."""
    import struct

    root = tilearchive.packed_directory(np.array([0, 1]), np.array([1, 4]), np.array([1, 2]), np.array([0, 1]))
    head = b"PMTiles\x03" + struct.pack("<11Q", 127, len(root), 127 + len(root), 0, 127 + len(root), 0, 127 + len(root), 3, 5, 2, 2) + bytes([1, 2, 1, 1, 0, 1]) + bytes(25)
    (tmp_path / "small.pmtiles").write_bytes(head + root + b"abb")
    got = read(tilearchive.read_archive(spark, f"file://{tmp_path}/small.pmtiles"))
    assert got == {(0, 0, 0): b"a", **{(1, x, y): b"bb" for x in (0, 1) for y in (0, 1)}}

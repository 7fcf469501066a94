"""Surfaces of ways and rides against a walk by the rules: tags, cells, tiles and their borders, shares."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import surfaces
from waymark.sources import listings

WAYS = "tags map<string,string>, coords array<array<double>>"


def key(x, y):
    return (round(y / 0.0002) + (1 << 19) << 21) | (round(x / 0.0002) + (1 << 20))


def cells(coords, step=5.0):
    out = {key(*coords[0])}
    for a, b in zip(coords, coords[1:]):
        n = int(math.hypot((b[0] - a[0]) * 111_320 * math.cos(math.radians((a[1] + b[1]) / 2)), (b[1] - a[1]) * 110_540) // step) + 1
        out |= {key(a[0] + (b[0] - a[0]) * i / n, a[1] + (b[1] - a[1]) * i / n) for i in range(n + 1)}
    return out


def test_classes_by_tags(spark):
    said = [({"highway": "track"}, "u"), ({"highway": "track", "tracktype": "grade1"}, "p"), ({"highway": "track", "surface": "asphalt"}, "p"), ({"highway": "primary", "surface": " Gravel ;asphalt"}, "u"), ({"highway": "path"}, "u"), ({"highway": "path", "bicycle": "designated"}, None), ({"highway": "path", "bicycle": "designated", "surface": "sett"}, "p"), ({"highway": "bridleway"}, "u"), ({"highway": "footway"}, None), ({"highway": "footway", "surface": "dirt"}, "u"), ({"highway": "construction", "surface": "asphalt"}, None), ({"surface": "asphalt"}, None), ({}, None), ({"highway": "cycleway", "surface": "strange"}, "p"), ({"highway": ""}, None)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(said)], "k int, tags map<string,string>").withColumn("c", surfaces.way_class(F.col("tags")))
    assert {r["k"]: r["c"] for r in df.collect()} == {k: c for k, (_, c) in enumerate(said)}


def test_cells_of_lines(spark):
    r = random.Random(3)
    lines = {k: [[r.uniform(-0.01, 0.01) + (k % 3) * 60 - 60, r.uniform(-0.01, 0.01) + k % 2 * 45] for _ in range(r.randint(2, 6))] for k in range(20)}
    df = spark.createDataFrame([*lines.items(), (90, [[1.0, 2.0]]), (91, []), (92, None)], "id int, coords array<array<double>>")
    got = {}
    for row in surfaces.rasterised(df, ["id"]).collect():
        got.setdefault(row["id"], []).append(row["key"])
    assert {k: len(v) for k, v in got.items()} == {k: len(set(v)) for k, v in got.items()}
    assert {k: set(v) for k, v in got.items()} == {k: cells(c) for k, c in lines.items()}


def walked(rides, ways, covered, **how):
    paved, unpaved = set(), set()
    for c, coords in ways:
        (paved if c == "p" else unpaved).update(cells(coords))
    tile = lambda k: (((k >> 21) - (1 << 19)) // 2500, ((k & (1 << 21) - 1) - (1 << 20)) // 2500)

    def told(k):
        p, u = k in paved, k in unpaved
        if not (p or u):
            near = [k + (dy << 21) + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
            p, u = any(n in paved for n in near), any(n in unpaved for n in near)
        return "A" if p and u else "P" if p else "U" if u else "N"

    out = {}
    for i, coords in rides:
        own = cells(coords)
        within = [told(k) for k in own if tile(k) in covered(paved | unpaved, tile)]
        n = within.count("P") + within.count("U")
        ok = len(within) / len(own) >= 0.6 and n >= how["least_known"]
        share = within.count("U") / n if ok else None
        out[i] = (len(own), len(within), within.count("P"), within.count("U"), share, ok and share >= 0.15)
    return out


def test_shares_across_a_tile_border(spark, tmp_path):
    """Ways on one side of the half-degree line, rides on both: a neighbour may lie in the next tile."""
    r = random.Random(8)
    border = 3.5
    point = lambda x: [round(x + r.uniform(-0.002, 0.002), 6), round(43.5 + r.uniform(-0.002, 0.002), 6)]
    ways = [(r.choice("pu"), [point(border + 0.0015), point(border + 0.001), point(border + 0.002)]) for _ in range(12)]
    rides = [(k, [point(border + r.choice([-0.001, 0, 0.001])) for _ in range(5)]) for k in range(25)] + [(50, [[9.0, 9.0], [9.01, 9.0]])]
    tags = {"p": {"highway": "residential"}, "u": {"highway": "track"}}
    made = spark.createDataFrame([(tags[c], coords) for c, coords in ways] + [({"highway": "steps"}, [[5.0, 5.0], [5.1, 5.0]])], WAYS)
    surfaces.write_grid(surfaces.surface_grid(made), str(tmp_path))
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("tile=t_")]) >= 2
    got = surfaces.measured(spark.createDataFrame(rides, "id int, coords array<array<double>>"), str(tmp_path), ["id"], least_known=5)
    want = walked(rides, ways, lambda keys, tile: {tile(k) for k in keys}, least_known=5)
    assert {r["id"]: tuple(r)[1:] for r in got.collect()} == {k: (*v[:4], v[4] if v[4] is None else pytest.approx(v[4]), v[5]) for k, v in want.items()}
    assert any(v[5] for v in want.values()) and want[50][1] == 0


def test_a_probe_reads_its_tiles_alone(spark, tmp_path):
    made = spark.createDataFrame([({"highway": "track"}, [[x + 0.1, 43.1], [x + 0.11, 43.1]]) for x in range(4)], WAYS)
    surfaces.write_grid(surfaces.surface_grid(made), str(tmp_path))
    one = surfaces.read_grid(spark, str(tmp_path), ["t_86_0"])
    assert len(one.inputFiles()) == 4  # what there is
    assert "PartitionFilters: [isnotnull(tile" in one._jdf.queryExecution().toString() or "PartitionFilters: [(tile" in one._jdf.queryExecution().toString()
    assert {r["tile"] for r in one.collect()} == {"t_86_0"}


def test_ways_and_open_tracks_are_read(spark, tmp_path):
    feature = lambda kind, coords, **p: json.dumps({"type": "Feature", "properties": p, "geometry": {"type": kind, "coordinates": coords}})
    line = [[1.0, 2.0], [3.0, 4.0]]
    (tmp_path / "w.geojsonseq").write_text("\x1e" + feature("LineString", line, highway="track") + "\n\x1e" + feature("Point", [1, 2], highway="x") + "\n\nbroken\n" + feature("LineString", line) + "\n")
    assert [(r["tags"], r["coords"]) for r in listings.read_ways(spark, str(tmp_path / "w.geojsonseq")).collect()] == [({"highway": "track"}, line), ({}, line)]
    records = [{"fields": {"n_dfci_1": "D1", "n_dfci_2": "T", "cat_act": "2A", "geo_shape": {"type": "LineString", "coordinates": line}}}, {"n_dfci_2": "T2", "statut_operationnel": "ok", "cat_act": "??", "geo_shape": {"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [line, [[5.0, 6.0, 7.0]]]}}}, {"n_dfci_1": "none"}, {"geo_shape": {"type": "Point", "coordinates": [1, 2]}}, {"geo_shape": {"type": "LineString", "coordinates": [[1.0, 2.0]]}}]
    (tmp_path / "t.json").write_text("\n".join(map(json.dumps, records)))
    assert [tuple(r) for r in listings.read_open_tracks(spark, str(tmp_path / "t.json")).collect()] == [("D1", "T", "", "compacted", line), ("T2", "T2", "ok", "dirt", [*line, [5.0, 6.0]])]


def test_extract_by_box_and_nature(spark):
    at = lambda c: [list(map(float, p)) for p in c]
    rows = [({"cleabs": "in", "nature_detail_dfci": "Piste Empierrée"}, 0, at([(0, 0), (2, 2)])), ({"cleabs": "corner", "nature_detail_dfci": None}, 0, at([(-1, 0.5), (0.5, -1)])), ({"cleabs": "by", "nature_detail_dfci": "Revêtue"}, 0, at([(2.2, 3), (3, 2.2)])), ({"cleabs": "across", "nature_detail_dfci": "x"}, 0, at([(-5, 1), (5, 1)])), ({"cleabs": "upright", "nature_detail_dfci": "Stabilisée"}, 0, at([(1, -5), (1, -1)])), ({"cleabs": "dot", "nature_detail_dfci": "sol naturel"}, 0, at([(1, 1), (1, 1)]))]
    df = spark.createDataFrame(rows, "properties map<string,string>, part int, coords array<array<double>>")
    assert {r["ref"]: r["surface"] for r in listings.extract_edges(df, (0.0, 0.0, 2.4, 2.4)).collect()} == {"in": "gravel", "across": "dirt", "dot": "dirt"}
    assert listings.extract_edges(df).count() == 6

"""Directed matches equal brute force, however many ways run along one road, and few of these are measured."""

import math

import numpy as np
import pytest

from waymark.functions.geo import DEGREE_M
from waymark.operators import matching, partof

SCHEMA = "{} long, coords array<array<double>>"


def road(rng, count, spread):
    """Ways along one road that differ by spread degrees at each of its corners, some of them ridden the other way."""
    out = []
    for _ in range(count):
        at = np.arange(rng.integers(0, 12), rng.integers(14, 30))
        way = np.stack([3.8 + (at * 4 + 0.5) / 1e4 + rng.choice(spread, len(at)), 43.6 + (at * 5 + 0.5) / 1e4], axis=1)
        out.append(way[::-1] if rng.random() < 0.3 else way)
    return out


def piece(way, rng, off):
    """Part of a way, with points between its corners, off degrees beside it."""
    a = rng.integers(0, len(way) - 4)
    t = np.linspace(0, 1, 8)[:, None]
    return np.concatenate([way[k] + (way[k + 1] - way[k]) * t for k in range(a, a + 3)])[3:-2] + [off, 0]


def lines(found):
    n = np.array([len(x) for x in found])
    return partof.Lines(np.concatenate([[0], np.cumsum(n)]), np.concatenate(found))


def matched(spark, tracks, ways, **kw):
    frames = [spark.createDataFrame([(k, x.tolist()) for k, x in lines], SCHEMA.format(c)) for c, lines in (("track_id", tracks), ("way_id", ways))]
    return {r["track_id"]: (r["hausdorff_m"], r["way_id"]) for r in matching.match_lines(*frames, directed=True, **kw).collect()}


@pytest.mark.parametrize("hausdorff_m,held", [(30.0, partof.HELD), (30.0, 1 << 10), (60.0, partof.HELD)])
def test_equals_brute_force(spark, monkeypatch, hausdorff_m, held):
    monkeypatch.setattr(partof, "HELD", held)
    rng = np.random.default_rng(8)
    ways = [(int(k), w) for k, w in zip(rng.permutation(80), road(rng, 80, [0, 1e-4, 1.3e-4]))]
    ways += [(100 + k, w) for k, w in ways[:10]] + [(200, ways[0][1][:1])]
    tracks = [(k, piece(ways[k % 80][1], rng, off)) for k, off in enumerate(np.repeat([0, 1e-5, 2e-4, 1e-3], 15))]
    tracks += [(90, tracks[3][1]), (91, ways[5][1][4:5]), (92, ways[0][1][:1])]
    want = {}
    for k, t in tracks:
        measured = [(*matching.closeness(t, w, directed=True), i) for i, w in ways]
        want[k] = min([(far, i) for far, share, i in measured if far < hausdorff_m and share >= 0.7], default=(None, None))
    got = matched(spark, tracks, ways, hausdorff_m=hausdorff_m)
    assert got == want and 30 < sum(w is not None for _, w in want.values()) < len(want)


def test_few_of_many_ways_are_measured():
    rng = np.random.default_rng(9)
    ways = road(rng, 3000, [0, 1e-4])
    tracks = [piece(ways[k], rng, 0) for k in range(50)]
    found = dict(partof.candidates(lines(tracks), lines(ways), 30 / 64))
    assert len(found) == 50 and sum(map(len, found.values())) < 500


def test_distance_in_the_scale_of_the_track(spark):
    """38 m beside the track at the equator are 29 m in the scale of its mean latitude."""
    tall = 30 / DEGREE_M * 1.01
    for part in (0.1, 0.5, 0.9):
        x = (1000 + part) * tall
        track, way = (np.array([[e, 0.0001], [e, 79.9999]]) for e in (x, x + 38 / DEGREE_M))
        (far, found), = matched(spark, [(1, track)], [(2, way)]).values()
        assert found == 2 and abs(far - 38 * math.cos(math.radians(40))) < 0.1


def test_lines_without_a_position(spark):
    tracks = spark.createDataFrame([(1, []), (2, None), (3, [[3.8, None]]), (4, [[3.8, 43.6], [3.801, 43.6]]), (None, [[3.8, 43.6]])], SCHEMA.format("track_id"))
    ways = spark.createDataFrame([(7, []), (8, None), (9, [[3.8, float("nan")], [3.8, 43.6]]), (None, [[3.8, 43.6], [3.801, 43.6]]), (6, [[3.8, 43.6], [3.801, 43.6]])], SCHEMA.format("way_id"))
    got = {r["track_id"]: r["way_id"] for r in matching.match_lines(tracks, ways, directed=True).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 6, None: None}

import math

import numpy as np

from waymark.functions.geo import DEGREE_M
from waymark.operators import matching, pairing, queries

PAIRS = "absorbed long, survivor long, rank long, keep_absorbed boolean"


def walk(rows):
    dropped, used, out = set(), set(), []
    for a, s, rank, keep in sorted(rows, key=lambda r: r[2]):
        if a is None or s is None or a in dropped or s in used or (a, s) in {x[:2] for x in out}:
            continue
        used.add(s)
        if not keep:
            dropped.add(a)
        out.append((a, s, rank))
    return sorted(out)


def test_pairs_resolve_as_a_walk_would(spark):
    rng = np.random.default_rng(4)
    rows = [(int(a), int(s) + 100, k, bool(a % 3 == 0)) for k, (a, s) in enumerate(dict.fromkeys(map(tuple, rng.integers(0, 25, (90, 2)).tolist())))]
    rows += [(None, 1, 500, False), (1, None, 501, True)]
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], PAIRS)
    assert sorted((r["absorbed"], r["survivor"], r["rank"]) for r in pairing.resolve_pairs(df).collect()) == walk(rows)
    assert pairing.resolve_pairs(df.filter("false")).count() == 0


def shifted(coords, east=0.0, north=0.0):
    return [[float(x + east / DEGREE_M / math.cos(math.radians(43.6))), float(y + north / DEGREE_M)] for x, y in coords]


def test_match_lines(spark):
    rng = np.random.default_rng(6)
    base = {k: (np.array([3.8, 43.6]) + k * 0.003 + rng.normal(0, 3e-4, (20, 2)).cumsum(axis=0)).tolist() for k in range(25)}
    tracks = [(k, c) for k, c in base.items()] + [(90, []), (91, None)]
    ways = []
    for k, c in base.items():
        ways += [(k * 10 + j, shifted(c, *rng.uniform(-30, 30, 2))) for j in range(3)] + [(k * 10 + 5, c[:10])]
    ways += [(998, []), (999, None)]
    schema = "{} long, coords array<array<double>>"
    got = {r["track_id"]: (r["way_id"], r["hausdorff_m"]) for r in matching.match_lines(spark.createDataFrame(tracks, schema.format("track_id")), spark.createDataFrame(ways, schema.format("way_id"))).collect()}
    want = {90: (None, None), 91: (None, None)}
    for k, c in base.items():
        measured = [(*matching.closeness(np.array(c), np.array(w)), i) for i, w in ways if w]
        good = [(h, i) for h, o, i in measured if h < 30 and o >= 0.7]
        want[k] = min(good)[::-1] if good else (None, None)
    assert got == want and sum(v[0] is not None for v in got.values()) > 10


def test_closeness():
    line = np.array([[3.8, 43.6], [3.81, 43.6]])
    far, share = matching.closeness(line, np.array(shifted(line.tolist(), north=10.0)))
    assert abs(far - 10) < 0.05 and share == 1.0
    half = np.array([[3.8, 43.6], [3.805, 43.6]])
    length = 0.01 * DEGREE_M * math.cos(math.radians(43.6))
    far, share = matching.closeness(line, half)
    assert abs(far - length / 2) < 1 and abs(share - (length / 2 + 30) / length) < 0.003


def test_queries_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    twins = [tuple(r) for r in queries._twins(spark, sf).collect()]
    assert sorted((r["absorbed"], r["survivor"], r["rank"]) for r in queries.m04_greedy_pairs(spark, sf).collect()) == walk(twins)
    found = queries.j20_line_match(spark, sf)
    assert found.count() == found.select("track_id").distinct().count() > 0

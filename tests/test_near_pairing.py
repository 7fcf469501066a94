"""Pairs within a time are resolved house by house, as a walk through all of them would."""

import numpy as np
import pytest

from waymark.operators import pairing, queries

SCHEMA = "house long, absorbed boolean, id long, at long, own boolean"


def walk(rows, seconds):
    spent, gone, out = set(), set(), []
    known = [r for r in rows if None not in (r[0], r[2], r[3])]
    for a, b in sorted(((a, b) for a in known for b in known if a[0] == b[0] and a[1] and not b[1] and abs(a[3] - b[3]) <= seconds), key=lambda p: (p[0][2], p[1][2])):
        if a[2] in gone or b[2] in spent:
            continue
        spent.add(b[2])
        if not (a[4] and not b[4]):
            gone.add(a[2])
        out.append((a[2], b[2], a[4] and not b[4]))
    return sorted(out)


@pytest.mark.parametrize("seconds", [0, 20, 100, 10_000])
def test_near_pairs_resolve_as_a_walk_would(spark, seconds):
    rng = np.random.default_rng(seconds)
    ids = rng.permutation(600).tolist()
    rows = [(int(h), bool(a), k, int(t), bool(o)) for k, h, a, t, o in zip(ids, rng.integers(0, 5, 600), rng.random(600) < 0.5, rng.integers(0, 900, 600), rng.random(600) < 0.6)]
    rows += [(77, True, 1000, 5, True), (78, False, 1001, 5, True), (None, True, 1002, 5, True), (1, True, 1003, None, True), (1, False, None, 5, True)]
    got = sorted((r["absorbed"], r["survivor"], r["keep_absorbed"]) for r in pairing.resolve_near(spark.createDataFrame(rows, SCHEMA), seconds).collect())
    assert got == walk(rows, seconds) and (got or not seconds)


def test_twins_are_no_rows(spark):
    """Pairs of starts are neither joined nor walked through in rounds."""
    sf = "/root/testdata/sf0.001"
    found = queries.m04_greedy_pairs(spark, sf)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    whole = pairing.resolve_pairs(queries._twins(spark, sf))
    assert found.columns == whole.columns and sorted(found.collect()) == sorted(whole.collect())


def test_a_house_of_many_starts():
    """All of these meet: some 2,500 million pairs, of which the walk sees those that it takes."""
    n = 50_000
    rng = np.random.default_rng(2)
    side = lambda k: (rng.permutation(n) * 2 + k, rng.integers(0, 10**6, n), np.zeros(n, bool))
    a, b = side(0), side(1)
    i, j, kept = pairing._walk(a, b, 10**6)
    assert a[0][i].tolist() == sorted(a[0]) and b[0][j].tolist() == sorted(b[0]) and not any(kept)

"""Preparation of traces for the community: order, mask before count, breaks, strays."""

import math

import numpy as np
import pytest

from waymark.functions import geo
from waymark.operators import prepare, privacy

SCHEMA = "activity_id long, user_id long, sport string, seq int, lon double, lat double"


def line(n, step_m=20.0, lat=43.6, at=0.0):
    return 3.8 + (at + np.arange(n) * step_m) / (geo.DEGREE_M * math.cos(math.radians(lat))), np.full(n, lat)


def fixes(spark, *tracks):
    return spark.createDataFrame([(k, u, "mtb", i, float(x), float(y)) for k, u, (lon, lat) in tracks for i, (x, y) in enumerate(zip(lon, lat))], SCHEMA)


def points(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["activity_id"], []).append((r["run"], r["point"], r["lon"], r["lat"]))
    return {k: sorted(v) for k, v in out.items()}


def walked_zone(lon, lat, dwell=30.0, least=3, most=10, span=100.0):
    """end_zone, a fix at a time."""
    at, pad, way, last = [0], [0.0], 0.0, 0
    for i in range(1, len(lon)):
        way += float(geo.metres(lon[i - 1], lat[i - 1], lon[i], lat[i]))
        gap = [float(geo.metres(lon[a], lat[a], lon[i], lat[i])) for a in at]
        k = min(range(len(gap)), key=gap.__getitem__)
        if gap[k] <= dwell:
            pad[k] = max(pad[k], gap[k])
        elif len(at) < least or (len(at) < most and way <= span):
            at.append(i)
            pad.append(0.0)
        else:
            break
        last = i
    return at, pad, last


def test_end_zones_against_a_walk():
    r = np.random.default_rng(1)
    for _ in range(150):
        n, s = int(r.integers(1, 900)), r.choice([1e-6, 1e-5, 1e-4, 5e-4])
        lon, lat = 3.8 + np.cumsum(r.normal(0, s, n)), 43.6 + np.cumsum(r.normal(0, s, n))
        at, pad, last = privacy.end_zone(lon, lat)
        want = walked_zone(lon, lat)
        assert (at.tolist(), last) == (want[0], want[2]) and np.allclose(pad, want[1])


def test_nothing_near_an_end_is_left(spark):
    r = np.random.default_rng(3)
    lon, lat = line(150)
    loop = np.concatenate([lon, lon[::-1]]), np.concatenate([lat, lat[::-1]])
    lingering = np.concatenate([lon[0] + r.normal(0, 5e-5, 80), lon]), np.concatenate([lat[0] + r.normal(0, 5e-5, 80), lat])
    got = points(prepare.prepare_traces(fixes(spark, (1, 1, (lon, lat)), (2, 1, loop), (3, 2, lingering))))
    for k, (x, y) in ((1, (lon, lat)), (2, loop), (3, lingering)):
        assert got[k]
        for end in (0, -1):
            assert min(geo.metres(x[end], y[end], p[2], p[3]) for p in got[k]) >= 199.5


def test_masked_ends_count_nowhere(spark):
    """Two riders who share a cell only at one's end zone: it has one contributor, not two."""
    lon, lat = line(100)
    other = lon[60:80] - 0.0, lat[60:80]  # starts and ends where the first rides by
    got = points(prepare.prepare_traces(fixes(spark, (1, 1, (lon, lat)), (2, 2, other)), radius=150.0))
    assert 2 not in got and got[1]


def test_a_stale_first_fix_does_not_publish_home(spark):
    """The mask is set on recorded fixes: a first fix far off, then home. Densifying first would draw a way to home."""
    home, lat = line(120)
    stale = np.concatenate([[home[0] - 0.02], home]), np.concatenate([[43.6], lat])
    got = points(prepare.prepare_traces(fixes(spark, (1, 1, stale))))
    assert got[1] and min(geo.metres(home[0], lat[0], p[2], p[3]) for p in got[1]) >= 199.5


def test_runs_are_dense_and_never_cross_a_jump(spark):
    a, b = line(40), line(40, at=40 * 20.0 + 5000.0)
    got = points(prepare.prepare_traces(fixes(spark, (1, 1, (np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))))))
    runs = {}
    for run, point, x, y in got[1]:
        runs.setdefault(run, []).append((x, y))
        assert point == len(runs[run]) - 1
    assert sorted(runs) == [0, 1]
    for own in runs.values():
        d = geo.metres(*np.array(own[:-1]).T, *np.array(own[1:]).T)
        assert d.max() < 6 and d.min() > 0
    assert all(x <= a[0][-1] or x >= b[0][0] for x, _ in runs[0] + runs[1])


def test_strays_and_clip(spark):
    lon, lat = line(60)
    far = lon.copy()
    far[30] += 20
    plain, strayed, boxed = (points(prepare.prepare_traces(f, **how)) for f, how in ((fixes(spark, (1, 1, (np.delete(lon, 30), np.delete(lat, 30)))), {}), (fixes(spark, (1, 1, (far, lat))), {}), (fixes(spark, (1, 1, (lon, lat))), {"box": (3.0, 43.0, float(lon[40]), 44.0)})))
    assert plain == strayed and max(p[2] for p in boxed[1]) < lon[40]


def test_small_and_odd_traces(spark):
    lon, lat = line(3)
    rows = fixes(spark, (1, 1, (lon, lat)), (2, 1, (lon[:1], lat[:1]))).collect() + [(3, None, None, 0, None, 43.6), (3, None, None, 1, 3.8, None)]
    df = prepare.prepare_traces(spark.createDataFrame([tuple(r) for r in rows], SCHEMA))
    assert df.collect() == [] and prepare.prepare_traces(spark.createDataFrame([], SCHEMA)).collect() == []
    same = np.full(50, 3.8), np.full(50, 43.6)
    assert prepare.prepare_traces(fixes(spark, (1, 1, same)), radius=0).collect() == []
    # Equal places in a row: no step is drawn twice.
    twice = np.repeat(line(40)[0], 2), np.repeat(line(40)[1], 2)
    assert points(prepare.prepare_traces(fixes(spark, (1, 1, twice)), radius=0))[1] == points(prepare.prepare_traces(fixes(spark, (1, 1, line(40))), radius=0))[1]


@pytest.mark.parametrize("gap", [3.0, 15.0])
def test_densified_against_the_definition(gap):
    r = np.random.default_rng(8)
    for _ in range(20):
        xy = np.column_stack([3.8 + np.cumsum(r.choice([0, 1e-7, 3e-4, 0.05], 30)), np.full(30, 43.6)])
        want, own = [], [tuple(xy[0])]
        for p, q in zip(xy[:-1], xy[1:]):
            d = float(geo.metres(p[0], p[1], q[0], q[1]))
            if d < 0.1:
                continue
            if d > 2500:
                want.append(own)
                own = [tuple(q)]
                continue
            n = max(1, int(d / gap))
            own += [tuple(p + (q - p) * (j / n)) for j in range(1, n + 1)]
        want.append(own)
        got = prepare.densified(xy, gap)
        assert [len(x) for x in got] == [len(x) for x in want] and all(np.allclose(a, b) for a, b in zip(got, want))

"""The mask and densifying of many traces at once give what they give a trace at a time."""

import numpy as np

from waymark.operators import prepare, privacy, ragged


def made(seed, count=60):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        n, s = int(r.integers(0, 400)), r.choice([1e-6, 1e-5, 1e-4, 5e-4, 3e-3])
        lon, lat = 3.8 + np.cumsum(r.normal(0, s, n)), 43.6 + np.cumsum(r.normal(0, s, n))
        if n and r.random() < 0.3:  # linger for longer than all traces are walked together
            lon, lat = np.concatenate([np.full(300, lon[0]), lon]), np.concatenate([np.full(300, lat[0]), lat])
        out.append((lon, lat, prepare.runs_of(lon, lat, 900.0)))
    return out


def flat(tracks):
    ends = np.cumsum([0, *[len(t[0]) for t in tracks]])
    return ends, *[np.concatenate([t[k] for t in tracks]) for k in range(3)]


def test_zones_mask_and_densifying():
    for seed in range(6):
        tracks = made(seed)
        ends, lon, lat, run = flat(tracks)
        for back in (False, True):
            at, pad, last = ragged.end_zones(ends, lon, lat, back)
            for k, (x, y, _) in enumerate(tracks):
                want, spread, stop = privacy.end_zone(x[::-1], y[::-1]) if back else privacy.end_zone(x, y)
                got = at[k][at[k] >= 0] - ends[k]
                assert not len(x) or ((len(x) - 1 - got if back else got).tolist(), last[k]) == (want.tolist(), stop)
                assert not len(x) or np.allclose(pad[k][at[k] >= 0], spread)
        for radius in (120.0, 0.0):
            trace, piece, x, y = ragged.masked(ends, lon, lat, run, radius)
            assert len(piece) == 0 or (np.diff(piece) >= 0).all()
            pieces = [(trace[piece == p][0], np.stack([x[piece == p], y[piece == p]], axis=1)) for p in np.unique(piece)]
            want = [(k, p) for k, t in enumerate(tracks) for p in privacy.masked_pieces(*t, radius)]
            assert [k for k, _ in pieces] == [k for k, _ in want]
            assert all(len(a) == len(b) and np.allclose(a, b, atol=1e-11, rtol=0) for (_, a), (_, b) in zip(pieces, want))
            t, p, dx, dy = ragged.densified(trace, piece, x, y, 7.0)
            for i, (k, line) in zip(np.unique(piece), want):
                (one,) = prepare.densified(line, 7.0, 1e9)
                assert set(t[p == i]) == {k} and np.allclose(np.stack([dx[p == i], dy[p == i]], axis=1), one, atol=1e-10, rtol=0)


def test_numbers_leave_out_single_points():
    keep, piece, point = ragged.numbered(np.array([0, 0, 0, 2, 2, 2, 2]), np.array([0, 1, 1, 2, 2, 4, 4]))
    assert keep.tolist() == [False] + [True] * 6 and piece.tolist() == [0, 0, 0, 0, 1, 1] and point.tolist() == [0, 1, 0, 1, 0, 1]


def test_empty_batch():
    none = np.zeros(0)
    trace, piece, x, y = ragged.densified(*ragged.masked(np.zeros(3, np.int64), none, none, none.astype(int)))
    assert not len(trace) and not len(ragged.numbered(trace, piece)[0])
    assert len(ragged.medians(np.zeros(3, np.int64), none)) == 0

"""The privacy mask and densifying for many traces at once, as flat arrays of fixes with the trace of each.

The rules are those of privacy.end_zone, privacy.masked_pieces and prepare.densified, which work on one trace; here
every step is one numpy call for all traces of a batch, whose cost no longer depends on how many traces it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from waymark.functions.geo import DEGREE_M, metres
from waymark.operators.privacy import end_zone

#: Fixes worked on at once: a leg meets up to 20 circles, so some 100 MB; a longer trace is worked on alone.
MOST_FIXES = 50_000
#: Fixes of an end zone that all traces are walked through together; the few that dwell longer are walked alone.
STEPS = 256


def groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]]:
    """Slices of a batch of packed traces of some MOST_FIXES fixes: the slice, the ends of its traces, flat columns."""
    ends = np.cumsum([0, *batch.column(1).value_lengths().to_pylist()])
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + MOST_FIXES, "right")) - 1)
        part = batch.slice(i, j - i)
        yield part, ends[i : j + 1] - ends[i], [part.column(k).flatten().to_numpy(zero_copy_only=False) for k in range(1, batch.num_columns)]
        i = j


def select(keep: np.ndarray, ends: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ends and columns without the fixes that aren't kept."""
    return np.concatenate([[0], np.cumsum(keep)])[ends], *[c[keep] for c in columns]


def medians(ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The upper median of each trace, repeated for its fixes."""
    size = np.diff(ends)
    order = np.lexsort((values, np.repeat(np.arange(len(size)), size)))
    at = np.minimum(ends[:-1] + size // 2, max(0, len(values) - 1))
    return np.repeat(values[order][at] if len(values) else np.zeros(len(size)), size)


def end_zones(ends: np.ndarray, lon: np.ndarray, lat: np.ndarray, back: bool, dwell=30.0, least=3, most=10, span=100.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each trace, from its start or its end: flat places of its anchors (-1: none), spreads, last step of the zone."""
    size = np.diff(ends)
    n = len(size)
    place = (lambda t, j: ends[t + 1] - 1 - j) if back else (lambda t, j: ends[t] + j)
    at, pad = np.full((n, most), -1), np.zeros((n, most))
    live = np.flatnonzero(size >= 1)
    at[live, 0] = place(live, 0)
    count, last, walked = np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    live = np.flatnonzero(size >= 2)
    for j in range(1, STEPS):
        live = live[size[live] > j]
        if not len(live):
            break
        p, before = place(live, j), place(live, j - 1)
        walked[live] += metres(lon[before], lat[before], lon[p], lat[p])
        gap = metres(lon[at[live]], lat[at[live]], lon[p][:, None], lat[p][:, None])
        gap[at[live] < 0] = np.inf
        k, near = gap.argmin(axis=1), gap.min(axis=1)
        stays = near <= dwell
        stay, away = live[stays], live[~stays]
        pad[stay, k[stays]] = np.maximum(pad[stay, k[stays]], near[stays])
        grows = away[(count[away] < least) | (count[away] < most) & (walked[away] <= span)]
        at[grows, count[grows]] = place(grows, j)
        count[grows] += 1
        live = np.union1d(stay, grows)
        last[live] = j
    for t in live[size[live] > STEPS]:
        own = slice(ends[t], ends[t + 1])
        x, y = (lon[own][::-1], lat[own][::-1]) if back else (lon[own], lat[own])
        a, spread, last[t] = end_zone(x, y, dwell, least, most, span)
        at[t], pad[t] = -1, 0
        at[t, : len(a)], pad[t, : len(a)] = place(t, a), spread
    return at, pad, last


def masked(ends: np.ndarray, lon: np.ndarray, lat: np.ndarray, run: np.ndarray, radius: float = 200.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What may be shown of traces: trace, piece (over all of them), lon, lat of each point, in order.

    run numbers the contiguous stretches of a trace. radius 0 or less: the runs as they are."""
    size = np.diff(ends)
    trace = np.repeat(np.arange(len(size)), size)
    step = np.arange(len(trace)) - ends[trace]
    if radius > 0:
        (head, head_pad, first), (tail, tail_pad, back) = (end_zones(ends, lon, lat, b) for b in (False, True))
        at = np.concatenate([head, tail], axis=1)
        reach = np.where(at < 0, 0, radius + np.concatenate([head_pad, tail_pad], axis=1))
    else:
        at, reach, first, back = np.zeros((len(size), 1), np.int64), np.zeros((len(size), 1)), np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    last = size - 1 - back
    leg = np.flatnonzero((trace[:-1] == trace[1:]) & (run[:-1] == run[1:]) & (step[:-1] >= first[trace[:-1]]) & (step[1:] <= last[trace[:-1]]) if len(trace) else np.zeros(0, bool))
    own = trace[leg]
    cx, cy, reach2 = lon[at[own]], lat[at[own]], reach[own] ** 2
    wide = DEGREE_M * np.cos(np.radians(cy))
    ax, ay = (lon[leg][:, None] - cx) * wide, (lat[leg][:, None] - cy) * DEGREE_M
    dx, dy = (lon[leg + 1][:, None] - cx) * wide - ax, (lat[leg + 1][:, None] - cy) * DEGREE_M - ay
    qa, qb, qc = dx**2 + dy**2, 2 * (ax * dx + ay * dy), ax**2 + ay**2 - reach2
    inner = qb**2 - 4 * qa * qc
    with np.errstate(invalid="ignore", divide="ignore"):
        root = np.sqrt(np.where((inner > 0) & (qa > 0) & (reach2 > 0), inner, np.nan))
        cuts = np.concatenate([(-qb - root) / (2 * qa), (-qb + root) / (2 * qa)], axis=1)
    cut_leg, cut = np.nonzero((cuts > 0) & (cuts < 1))
    # Every leg falls into parts at its cuts; a part is hidden if its middle is.
    n = len(leg)
    of = np.concatenate([np.arange(n), np.arange(n), cut_leg])
    t = np.concatenate([np.zeros(n), np.ones(n), cuts[cut_leg, cut]])
    order = np.lexsort((t, of))
    of, t = of[order], t[order]
    part = np.flatnonzero((of[:-1] == of[1:]) & (t[:-1] < t[1:])) if n else np.zeros(0, np.int64)
    of, t0, t1 = of[part], t[part], t[part + 1]
    mid = ((t0 + t1) / 2)[:, None]
    shown = ~(((ax[of] + dx[of] * mid) ** 2 + (ay[of] + dy[of] * mid) ** 2) < reach2[of]).any(axis=1)
    of, t0, t1 = of[shown], t0[shown], t1[shown]
    go_on = (of[1:] == of[:-1]) & (t0[1:] == t1[:-1]) | (leg[of[1:]] == leg[of[:-1]] + 1) & (t1[:-1] == 1) & (t0[1:] == 0)
    fresh = np.concatenate([[True], ~go_on])[: len(of)]
    # A piece is the start of its first part and the ends of all of them; whole legs end on the fixes themselves.
    piece = np.cumsum(fresh) - 1
    times = np.repeat(np.arange(len(of)), 1 + fresh)
    opens = np.concatenate([[True], times[1:] != times[:-1]])[: len(times)] & fresh[times]
    where = np.where(opens, t0[times], t1[times])
    a, b = leg[of[times]], leg[of[times]] + 1
    at_x = np.where(where == 1, lon[b], lon[a] + (lon[b] - lon[a]) * where)
    at_y = np.where(where == 1, lat[b], lat[a] + (lat[b] - lat[a]) * where)
    return trace[a], piece[times], at_x, at_y


def densified(trace: np.ndarray, piece: np.ndarray, lon: np.ndarray, lat: np.ndarray, gap: float = 3.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces with points at most nearly twice gap apart; steps below a decimetre are left out."""
    if not len(piece):
        return trace, piece, lon, lat
    same = piece[:-1] == piece[1:]
    d = np.where(same, metres(lon[:-1], lat[:-1], lon[1:], lat[1:]), 0)
    n = np.where(d >= 0.1, np.maximum(1, (d / gap).astype(np.int64)), 0)
    times = np.concatenate([[1], np.where(same, n, 1)])  # a piece begins with its first point as it is
    to = np.repeat(np.arange(len(piece)), times)
    k = np.arange(len(to)) - np.repeat(np.cumsum(times) - times, times) + 1
    first = np.concatenate([[True], ~same])[to]
    share = np.where(first, 1.0, k / times[to])
    before = np.where(first, to, to - 1)
    return trace[to], piece[to], lon[before] + (lon[to] - lon[before]) * share, lat[before] + (lat[to] - lat[before]) * share


def numbered(trace: np.ndarray, piece: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which points belong to pieces of at least so many, and of those the number of the piece in its trace and of the
    point in its piece."""
    if not len(piece):
        return np.zeros(0, bool), piece, piece
    keep = np.bincount(piece)[piece] >= least
    trace, piece = trace[keep], piece[keep]
    fresh = np.concatenate([[True], piece[1:] != piece[:-1]])[: len(piece)]
    starts = np.flatnonzero(fresh)
    point = np.arange(len(piece)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(piece)]])))
    dense = np.cumsum(fresh) - 1
    opens = np.flatnonzero(np.concatenate([[True], trace[1:] != trace[:-1]])[: len(trace)])
    return keep, dense - np.repeat(dense[opens], np.diff(np.concatenate([opens, [len(trace)]]))), point

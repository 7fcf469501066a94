"""Radial endpoint mask: nothing within a radius of where a trace starts or ends is ever shown.

Runs on raw fixes, before densifying and counting. These functions take one trace; operators.ragged has the same rules
for a batch of traces.
"""

from __future__ import annotations

import numpy as np

from waymark.functions.geo import DEGREE_M, metres


def end_zone(lon: np.ndarray, lat: np.ndarray, dwell=30.0, least=3, most=10, span=100.0) -> tuple[np.ndarray, np.ndarray, int]:
    """Anchors of the end at which the arrays start: indexes, the spread each absorbed, the zone's last index."""
    at, pad, n, last = [0], [0.0], len(lon), 0
    if n < 2:
        return np.array(at), np.array(pad), 0
    walked = np.concatenate([[0.0], np.cumsum(metres(lon[:-1], lat[:-1], lon[1:], lat[1:]))])
    i = 1
    while i < n:  # what stays near the anchors is absorbed a stretch at a time; each round but the last sets an anchor
        part = slice(i, min(n, i + 512))
        gap = metres(lon[at][:, None], lat[at][:, None], lon[part][None], lat[part][None])
        k, near = gap.argmin(axis=0), gap.min(axis=0)
        away = np.flatnonzero(near > dwell)
        stay = int(away[0]) if len(away) else len(near)
        np.maximum.at(pad := np.array(pad), k[:stay], near[:stay])
        pad, last, i = pad.tolist(), i + stay - 1, i + stay
        if len(away):
            if len(at) >= least and not (len(at) < most and walked[i] <= span):
                break
            at.append(i)
            pad.append(0.0)
            last, i = i, i + 1
    return np.array(at), np.array(pad), last


def masked_pieces(lon: np.ndarray, lat: np.ndarray, run: np.ndarray, radius: float = 200.0, **zone) -> list[np.ndarray]:
    """Pieces [points, (lon, lat)] that may be shown; cuts lie on the circles. radius 0 or less: the runs as they are.

    run numbers the contiguous stretches; a piece never crosses from one to another."""
    xy = np.stack([lon, lat], axis=1).astype(float)
    if len(xy) < 2:
        return []
    if radius <= 0:
        return [xy[run == r] for r in dict.fromkeys(run.tolist()) if (run == r).sum() >= 2]
    head, head_pad, first = end_zone(lon, lat, **zone)
    tail, tail_pad, back = end_zone(lon[::-1], lat[::-1], **zone)
    last = len(xy) - 1 - back
    if first >= last:
        return []
    centre = np.concatenate([xy[head], xy[::-1][tail]])
    reach = radius + np.concatenate([head_pad, tail_pad])
    scale = np.stack([DEGREE_M * np.cos(np.radians(centre[:, 1])), np.full(len(centre), DEGREE_M)], axis=1)
    place = lambda p: (p[:, None, :] - centre[None]) * scale[None]  # noqa: E731  metres from each centre
    hidden = lambda p: ((place(p) ** 2).sum(axis=2) < reach**2).any(axis=1)
    pieces: list[np.ndarray] = []
    for r in dict.fromkeys(run[first : last + 1].tolist()):
        own = xy[first : last + 1][run[first : last + 1] == r]
        if len(own) < 2:
            continue
        a, b = own[:-1], own[1:]
        start, step = place(a), place(b) - place(a)
        qa, qb, qc = (step**2).sum(axis=2), 2 * (start * step).sum(axis=2), (start**2).sum(axis=2) - reach**2
        inner = qb**2 - 4 * qa * qc
        with np.errstate(invalid="ignore", divide="ignore"):
            root = np.sqrt(np.where((inner > 0) & (qa > 0), inner, np.nan))
            cuts = np.concatenate([(-qb - root) / (2 * qa), (-qb + root) / (2 * qa)], axis=1)
        seg, col = np.nonzero((cuts > 0) & (cuts < 1))
        # Every leg falls into parts at its cuts; a part is hidden if its middle is.
        where = np.concatenate([np.arange(len(own), dtype=float), seg + cuts[seg, col]])
        where = np.unique(where)
        leg = np.minimum(where.astype(int), len(a) - 1)
        points = a[leg] + (b - a)[leg] * (where - leg)[:, None]
        middle = (where[:-1] + where[1:]) / 2
        m_leg = middle.astype(int)
        shown = ~hidden(a[m_leg] + (b - a)[m_leg] * (middle - m_leg)[:, None])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], shown, [False]]).astype(int)))
        pieces += [points[i : j + 1] for i, j in zip(edge[::2], edge[1::2], strict=True)]
    return pieces

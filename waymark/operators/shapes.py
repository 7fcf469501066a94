"""Sequential operators on one trace: elevation gain, simplifying, level split, density points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waymark.functions.geo import DEGREE_M, cumulative
from waymark.operators.packed import packed, traces


def elevation_gain(ele: np.ndarray, window: int = 11, noise: float = 3.0) -> float:
    """Climb in metres: centred rolling medians (from window values on), then a baseline that only moves by noise or
    more. NaN are passed over; fewer than three values climb nothing."""
    ele = np.asarray(ele, float)
    ele = ele[~np.isnan(ele)]
    if len(ele) < 3:
        return 0.0
    if len(ele) >= window:
        half = window // 2
        held = np.concatenate([np.full(half, np.nan), ele, np.full(half, np.nan)])
        ele = np.nanmedian(np.lib.stride_tricks.sliding_window_view(held, window), axis=1)
    gain, base = 0.0, ele[0]
    for e in ele[1:]:
        if abs(e - base) >= noise:
            gain += max(0.0, e - base)
            base = e
    return float(gain)


def simplify(lon: np.ndarray, lat: np.ndarray, ele: np.ndarray | None = None, tolerance: float = 2.0, ele_tolerance: float = 5.0, plane: bool = False) -> np.ndarray:
    """Indexes that Douglas-Peucker keeps, by distance to segments in a plane at the mean latitude; with elevations,
    ele_tolerance metres of height weigh as much as tolerance metres of ground. plane: distances and tolerance in degrees."""
    n = len(lon)
    if n <= 2:
        return np.arange(n)
    axes = [np.asarray(lon, float), np.asarray(lat, float)] if plane else [np.asarray(lon) * DEGREE_M * np.cos(np.radians(np.mean(lat))), np.asarray(lat) * DEGREE_M]
    p = np.stack(axes, axis=1)
    high = None if ele is None else np.asarray(ele, float) * tolerance / ele_tolerance
    keep, todo = np.zeros(n, bool), [(0, n - 1)]
    keep[[0, -1]] = True
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        inner, along = p[i + 1 : j] - p[i], p[j] - p[i]
        length = along @ along
        t = np.clip(inner @ along / length, 0, 1) if length else np.zeros(len(inner))
        off = ((inner - t[:, None] * along) ** 2).sum(axis=1)
        if high is not None:  # heights are compared where the point meets the segment on the ground
            off += (high[i + 1 : j] - (high[i] + t * (high[j] - high[i]))) ** 2
        k = int(np.argmax(off))
        if off[k] > tolerance**2:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return np.flatnonzero(keep)


def level_pieces(passes: np.ndarray, eff: np.ndarray, travelled: np.ndarray, least: float = 200.0) -> list[tuple[int, int]]:
    """First and last index of the pieces of a run: a piece ends where either value has moved by a factor of two
    from the piece's first and stays so for least metres; neighbours share the vertex between them."""
    n = len(passes)
    if n < 2:
        return [(0, n - 1)]
    out, begin, seen = [], 0, 0
    while True:
        p, e = passes[begin], eff[begin]
        at, width, since, cut = seen + 1, 64, None, None  # what made the last cut is behind us
        while at < n and cut is None:  # a window at a time, so that a run is looked at about once for all its cuts
            part = slice(at, min(n, at + width))
            away = (passes[part] >= 2 * p) | (2 * passes[part] <= p) | (eff[part] >= 2 * e) | (2 * eff[part] <= e)
            for a, z in _stretches(away):
                if a > 0 or since is None:
                    since = at + a
                stays = np.flatnonzero(travelled[at + a : at + z] - travelled[since - 1] >= least)
                if len(stays):
                    cut, seen = since, at + a + int(stays[0])
                    break
                if at + z < part.stop:
                    since = None
            if len(away) and not away[-1]:
                since = None
            at, width = part.stop, 2 * width
        if cut is None:
            return [*out, (begin, n - 1)]
        out.append((begin, cut))
        begin = cut


def _stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """[first, end) of the runs of set flags."""
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def density_points(lon: np.ndarray, lat: np.ndarray, every: float = 20.0) -> np.ndarray:
    """Indexes of points set about every so many metres: the first, then each at which the way since the last set
    point reaches it."""
    out, since, way = [0], 0.0, np.diff(cumulative(lon, lat))
    for i, d in enumerate(way, 1):
        since += d
        if since >= every:
            out.append(i)
            since = 0.0
    return np.array(out[: len(lon)])


def by_trace(fixes: DataFrame, tolerance: float = 20.0, every: float = 100.0) -> DataFrame:
    """activity_id, climb_m, kept (points after simplifying), density (points about every so many metres)."""

    def run(batches):
        for b in batches:
            rows = [(key, elevation_gain(ele), len(simplify(lon, lat, tolerance=tolerance)), len(density_points(lon, lat, every))) for key, lon, lat, ele in traces(b)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], names=["activity_id", "climb_m", "kept", "density"])

    return packed(fixes, "lon", "lat", "ele").mapInArrow(run, "activity_id long, climb_m double, kept int, density int")

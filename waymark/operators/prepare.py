"""What the community map may know of traces: clipped, freed of strays, broken at jumps, masked and only then densified.

The order is a privacy rule. The mask defines start and end on recorded fixes, and nothing is counted that it hides.
One trace is the unit of work and one Arrow pass does all of it, so a trace is shuffled once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waymark.functions.geo import metres
from waymark.operators import ragged
from waymark.operators.packed import packed

DENSE = "activity_id long, user_id long, sport string, run int, point int, lon double, lat double"


def clipped(lon: np.ndarray, lat: np.ndarray, box: tuple[float, float, float, float] | None) -> np.ndarray:
    """Which points are within west, south, east, north; all if there is no box."""
    if box is None:
        return np.ones(len(lon), bool)
    west, south, east, north = box
    return (lon >= west) & (lon <= east) & (lat >= south) & (lat <= north)


def near_median(lon: np.ndarray, lat: np.ndarray, far_km: float = 300.0) -> np.ndarray:
    """Which points lie within far_km of the (upper) median position; all of fewer than two, or if far_km isn't positive."""
    n = len(lon)
    if n < 2 or far_km <= 0:
        return np.ones(n, bool)
    return metres(np.sort(lon)[n // 2], np.sort(lat)[n // 2], lon, lat) <= far_km * 1000


def runs_of(lon: np.ndarray, lat: np.ndarray, jump_m: float = 2500.0) -> np.ndarray:
    """The number of each point's run; a jump of more than jump_m begins a new one."""
    if not len(lon):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum(metres(lon[:-1], lat[:-1], lon[1:], lat[1:]) > jump_m)])


def densified(line: np.ndarray, gap: float = 3.0, jump_m: float = 2500.0) -> list[np.ndarray]:
    """Points [n, (lon, lat)] at most nearly twice gap apart. Steps below a decimetre are left out, and jumps part."""
    d = metres(line[:-1, 0], line[:-1, 1], line[1:, 0], line[1:, 1])
    legs = np.flatnonzero(d >= 0.1)
    n = np.where(d[legs] > jump_m, 1, np.maximum(1, (d[legs] / gap).astype(np.int64)))
    leg = np.repeat(legs, n)
    k = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1) / np.repeat(n, n)
    points = line[leg] + (line[leg + 1] - line[leg]) * k[:, None]
    points = np.concatenate([line[:1], points])
    cuts = 1 + np.cumsum(n)[d[legs] > jump_m] - 1
    return np.split(points, cuts)


def prepare_traces(fixes: DataFrame, box: tuple[float, float, float, float] | None = None, far_km: float = 300.0, jump_m: float = 2500.0, radius: float = 200.0, gap: float = 3.0) -> DataFrame:
    """activity_id, user_id, sport, run, point, lon, lat of what may be counted and drawn of fixes (activity_id, user_id,
    sport, seq, lon, lat). Runs are numbered within a trace; those of one point are left out, as are fixes without a
    position. A trace is one row of some 100 000 fixes at most."""

    def run(batches):
        for b in batches:
            for rows, ends, (user, sport, lon, lat) in ragged.groups(b):
                ends, user, sport, lon, lat = ragged.select(clipped(lon, lat, box), ends, user, sport, lon, lat)
                if far_km > 0:
                    near = metres(ragged.medians(ends, lon), ragged.medians(ends, lat), lon, lat) <= far_km * 1000
                    ends, user, sport, lon, lat = ragged.select(near | (np.repeat(np.diff(ends), np.diff(ends)) < 2), ends, user, sport, lon, lat)
                trace, piece, x, y = ragged.densified(*ragged.masked(ends, lon, lat, runs_of(lon, lat, jump_m), radius), gap)
                keep, run_no, point = ragged.numbered(trace, piece)
                trace = trace[keep]
                first = ends[:-1][trace]  # one user and sport a trace
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(trace)), pa.array(user[first], pa.int64()), pa.array(sport[first], pa.string()), pa.array(run_no, pa.int32()), pa.array(point, pa.int32()), pa.array(x[keep]), pa.array(y[keep])], names=[c.split(" ")[0] for c in DENSE.split(", ")])

    return packed(fixes.dropna(subset=["lon", "lat"]), "user_id", "sport", "lon", "lat").mapInArrow(run, DENSE)


MASKED = "activity_id long, piece int, point int, lon double, lat double"


def mask_traces(fixes: DataFrame, radius: float = 200.0) -> DataFrame:
    """activity_id, piece, point, lon, lat of what may be shown of fixes (activity_id, seq, run_id, lon, lat).

    Traces of fewer than two fixes, and traces that never leave their end zones, have no rows."""

    def run(batches):
        for b in batches:
            for rows, ends, (lon, lat, runs) in ragged.groups(b):
                trace, piece, x, y = ragged.masked(ends, lon, lat, runs, radius)
                keep, number, point = ragged.numbered(trace, piece)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(trace[keep])), pa.array(number, pa.int32()), pa.array(point, pa.int32()), pa.array(x[keep]), pa.array(y[keep])], names=[c.split(" ")[0] for c in MASKED.split(", ")])

    return packed(fixes.dropna(subset=["lon", "lat"]), "lon", "lat", "run_id").mapInArrow(run, MASKED)

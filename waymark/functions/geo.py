"""Geodesy on arrays, for operators that work a trace at a time."""

from __future__ import annotations

import numpy as np

EARTH_M = 6_371_000.0
DEGREE_M = EARTH_M * np.pi / 180


def metres(lon1, lat1, lon2, lat2):
    """Great-circle metres between points or arrays of points."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
    return 2 * EARTH_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def cumulative(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Metres travelled up to each point."""
    return np.concatenate([[0.0], np.cumsum(metres(lon[:-1], lat[:-1], lon[1:], lat[1:]))])[: len(lon)]


def hilbert_tile_id(z: int, x: int, y: int) -> int:
    """Place of a tile along the Hilbert curves of all zooms, coarsest first."""
    before, d, s = ((1 << (2 * z)) - 1) // 3, 0, (1 << z) >> 1
    while s:
        rx, ry = int((x & s) > 0), int((y & s) > 0)
        d += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = s - 1 - (x & (s - 1)), s - 1 - (y & (s - 1))
            x, y = y, x
        x, y, s = x & (s - 1), y & (s - 1), s >> 1
    return before + d


def hilbert_tile_ids(z: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """hilbert_tile_id of arrays."""
    z, x, y = (np.asarray(v, np.int64).copy() for v in (z, x, y))
    before, d = ((np.int64(1) << (2 * z)) - 1) // 3, np.zeros(len(z), np.int64)
    for k in range(int(z.max(initial=0)) - 1, -1, -1):
        s = np.int64(1) << k
        on = z > k
        rx, ry = (x >> k) & 1, (y >> k) & 1
        d += np.where(on, s * s * ((3 * rx) ^ ry), 0)
        x, y = np.where(on, x & (s - 1), x), np.where(on, y & (s - 1), y)
        flip = on & (ry == 0) & (rx == 1)
        x, y = np.where(flip, s - 1 - x, x), np.where(flip, s - 1 - y, y)
        turn = on & (ry == 0)
        x, y = np.where(turn, y, x), np.where(turn, x, y)
    return before + d


def tile_of_hilbert_id(tile: int) -> tuple[int, int, int]:
    """(z, x, y) of a place along the Hilbert curves; the inverse of hilbert_tile_id."""
    z = 0
    while tile >= 1 << (2 * z):
        tile -= 1 << (2 * z)
        z += 1
    x = y = 0
    for k in range(z):
        s = 1 << k
        rx, ry = (tile >> 1) & 1, ((tile >> 1) ^ tile) & 1
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y, tile = x + s * rx, y + s * ry, tile >> 2
    return z, x, y

"""Which way is the same line as a track: Hausdorff distance and overlap on candidates found by an equality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import DEGREE_M
from waymark.operators.partof import closest_whole

#: Metres about a way within which a track overlaps it.
BUFFER_M = 30.0


def to_line(points: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Metres from each point to the nearest of a line (planar)."""
    if len(line) == 1:
        return np.hypot(*(points - line[0]).T)
    a, d = line[:-1], np.diff(line, axis=0)
    length = (d**2).sum(axis=1)
    best = np.full(len(points), np.inf)
    for k in range(0, len(points), 256):  # bounds the matrix by 256 times the line
        p = points[k : k + 256, None, :] - a[None]
        t = np.clip((p * d).sum(axis=2) / np.where(length > 0, length, 1), 0, 1)
        best[k : k + 256] = np.sqrt(((p - t[..., None] * d) ** 2).sum(axis=2)).min(axis=1)
    return best


def closeness(track: np.ndarray, way: np.ndarray, buffer_m: float = BUFFER_M, step: float = 1.0, directed: bool = False, limit: float = np.inf) -> tuple[float, float]:
    """Hausdorff metres between the vertices of each and the other line (directed: of the track's vertices only, so that
    the way may go on beyond it), and the share of the track within buffer_m of the way, sampled every step metres (0 unsampled, where the distance reaches the limit)."""
    scale = DEGREE_M * np.array([np.cos(np.radians(track[:, 1].mean())), 1.0])
    a, b = track * scale, way * scale
    far = to_line(a, b).max() if directed else max(to_line(a, b).max(), to_line(b, a).max())
    if far <= buffer_m:
        return float(far), 1.0
    if far >= limit:
        return float(far), 0.0
    legs = np.hypot(*np.diff(a, axis=0).T)
    n = np.maximum(1, np.ceil(legs / step)).astype(int)
    leg = np.repeat(np.arange(len(legs)), n)
    t = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 0.5) / n[leg]
    near = to_line(a[leg] + np.diff(a, axis=0)[leg] * t[:, None], b) <= buffer_m
    total = legs.sum()
    return float(far), float((legs[leg] / n[leg] * near).sum() / total) if total else 0.0


def match_lines(tracks: DataFrame, ways: DataFrame, hausdorff_m: float = 30.0, overlap: float = 0.7, directed: bool = False) -> DataFrame:
    """track_id, way_id, hausdorff_m and overlap of the closest way of each track (way_id null: none is closer than
    hausdorff_m and overlaps enough; ties: the smaller id), of tracks (track_id, coords) and ways (way_id, coords).

    Lines closer than hausdorff_m have boxes that agree to it on all sides, so candidates meet by the grid cell of
    their south-west corners, that of the track and its neighbours. Directed, a track may be any part of a way: then the
    ways that pass near its points are told by bits (partof). Ways of one geometry are measured once. Lines without
    points match nothing.
    """
    if directed:
        found = closest_whole(tracks, ways, closeness, hausdorff_m, overlap, BUFFER_M)
        return tracks.select("track_id").distinct().join(found, "track_id", "left").select("track_id", "way_id", "hausdorff_m", "overlap")
    side = lambda f, k: f(F.transform("coords", lambda p: F.get(p, F.lit(k))))
    boxes = lambda d: d.withColumns({"w": side(F.array_min, 0), "s": side(F.array_min, 1), "e": side(F.array_max, 0), "n": side(F.array_max, 1)}).filter("w IS NOT NULL AND s IS NOT NULL")
    tall = hausdorff_m / DEGREE_M * 1.01
    row = lambda c: F.floor(F.col(c) / tall)
    # A row of cells has one width, wide enough at its poleward neighbour for the distance.
    wide = lambda r: tall / F.greatest(F.cos(F.radians(F.abs(r * tall) + 2 * tall)), F.lit(1e-6))
    t = boxes(tracks).select("track_id", F.col("coords").alias("track"), *[F.col(c).alias(f"t{c}") for c in "wsen"])
    t = t.withColumn("gy", F.explode(F.array(*[row("ts") + k for k in (-1, 0, 1)])))
    t = t.withColumn("gx", F.explode(F.array(*[F.floor(F.col("tw") / wide(F.col("gy"))) + k for k in (-1, 0, 1)])))
    w = boxes(ways.groupBy("coords").agg(F.min("way_id").alias("way_id"))).withColumn("gy", row("s")).withColumn("gx", F.floor(F.col("w") / wide(F.col("gy"))))
    lon_gap = tall / F.greatest(F.cos(F.radians(F.greatest(F.abs("tn"), F.abs("ts")) + tall)), F.lit(1e-6))
    close = (F.abs(F.col("ts") - F.col("s")) <= tall) & (F.abs(F.col("tn") - F.col("n")) <= tall) & (F.abs(F.col("tw") - F.col("w")) <= lon_gap) & (F.abs(F.col("te") - F.col("e")) <= lon_gap)
    pairs = t.join(w, ["gy", "gx"]).filter(close).select("track_id", "way_id", "track", F.col("coords").alias("way"))

    return _closest(tracks, pairs, hausdorff_m, overlap)


def _closest(tracks: DataFrame, pairs: DataFrame, hausdorff_m: float, overlap: float) -> DataFrame:
    @F.pandas_udf("hausdorff_m double, overlap double")
    def measured(track: pd.Series, way: pd.Series) -> pd.DataFrame:
        both = [closeness(np.array([p[:2] for p in a], float), np.array([p[:2] for p in b], float), limit=hausdorff_m) for a, b in zip(track, way, strict=True)]
        return pd.DataFrame(both, columns=["hausdorff_m", "overlap"])

    good = pairs.withColumn("m", measured("track", "way")).filter((F.col("m.hausdorff_m") < hausdorff_m) & (F.col("m.overlap") >= overlap))
    best = good.groupBy("track_id").agg(F.min(F.struct("m.hausdorff_m", "way_id", "m.overlap")).alias("b"))
    return tracks.select("track_id").distinct().join(best, "track_id", "left").select("track_id", "b.way_id", "b.hausdorff_m", "b.overlap")

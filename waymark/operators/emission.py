"""What leaves the library for maps and files: density points, compact display lines, masked share lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.packed import packed, traces
from waymark.operators.prepare import near_median, runs_of
from waymark.operators.privacy import masked_pieces
from waymark.operators.shapes import density_points, simplify

#: The kernel's radius in CSS pixels by zoom, straight between them; the largest share of it that points
#: may be apart; the slack of densified points; the layer's lowest zoom.
RADIUS_PX = ((6, 3.0), (8, 4.5), (10, 5.5), (13, 8.0), (16, 10.0), (18, 12.0))
GAP_SHARE, SLACK_M, LAYER_ZOOM, ZOOMS = 0.75, 3.0, 6, 23
CIRCUMFERENCE_M, TILE_PX = 40_075_016.686, 512


def point_levels(lat: float, every: float = 20.0) -> np.ndarray:
    """For each zoom the level at which every 2 ** level-th point of a run is near enough to the next; never rising."""
    z = np.arange(ZOOMS)
    radius = np.interp(z, *zip(*RADIUS_PX)) * CIRCUMFERENCE_M * np.cos(np.radians(lat)) / (TILE_PX * 2.0**z)
    fits = GAP_SHARE * radius / (every + SLACK_M)
    return np.minimum.accumulate(np.where(fits > 1, np.floor(np.log2(np.maximum(fits, 1))), 0)).astype(np.int64)


def lowest_zooms(n: int, levels: np.ndarray) -> np.ndarray:
    """The first zoom that shows each of n points of a run."""
    return np.argmax(np.arange(n)[:, None] % (1 << levels)[None] == 0, axis=1)


def heat_points(points: DataFrame, top: float | None = None, every: float = 20.0) -> DataFrame:
    """activity_id, run, number, sport, lon, lat (5 decimals), w, minzoom of the density points of runs of points
    (activity_id, run, seq, sport, lon, lat, eff): the first of a run and then one each time the way since the last has
    reached every metres. w is the point's own heat on the scale of top effective passes, by default the 99.9th
    percentile of eff."""
    if top is None:
        top = points.agg(F.expr("greatest(1, percentile_disc(0.999) WITHIN GROUP (ORDER BY eff))")).first()[0] or 1
    scale = float(np.log1p(float(top)))

    def run(batches):
        for b in batches:
            out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, str),) + (np.zeros(0),) * 3 + (np.zeros(0, np.int64),) * 2]
            for key, runs, sport, lon, lat, eff in traces(b):
                for r in np.unique(runs):
                    own = np.flatnonzero(runs == r)
                    at = own[density_points(lon[own], lat[own], every)]
                    w = np.round(np.minimum(1.0, np.log1p(eff[at].astype(float)) / scale), 3)
                    out.append((np.full(len(at), key), np.full(len(at), r), np.full(len(at), sport[0]), np.round(lon[at], 5), np.round(lat[at], 5), w, np.arange(len(at)), lowest_zooms(len(at), point_levels(lat[own[0]], every))))
            key, r, sport, lon, lat, w, number, zoom = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(r, pa.int64()), pa.array(number, pa.int32()), pa.array(sport.tolist(), pa.string()), pa.array(lon), pa.array(lat), pa.array(w), pa.array(zoom, pa.int32())], names=["activity_id", "run", "number", "sport", "lon", "lat", "w", "minzoom"])

    return packed(points.dropna(subset=["lon", "lat"]), "run", "sport", "lon", "lat", "eff").mapInArrow(run, "activity_id long, run long, number int, sport string, lon double, lat double, w double, minzoom int")


def point_features(points: DataFrame) -> DataFrame:
    """value: a GeoJSON line for each of heat_points(); minzoom is told where it is above the layer's lowest zoom."""
    body = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct("w", "sport").alias("properties"), F.when(F.col("minzoom") > LAYER_ZOOM, F.struct("minzoom")).alias("tippecanoe"))
    return points.select("activity_id", "run", "number", F.to_json(body, {"ignoreNullFields": "true"}).alias("value"))


def parts_of(lon: np.ndarray, lat: np.ndarray, jump_m: float = 2500.0) -> list[np.ndarray]:
    """Indexes of the parts of a line between jumps; parts of one point are left out, unless none can be drawn."""
    runs = runs_of(lon, lat, jump_m)
    parts = [np.flatnonzero(runs == r) for r in np.unique(runs)]
    drawable = [p for p in parts if len(p) >= 2]
    return drawable or [np.arange(len(lon))]


def compact_line(lon: np.ndarray, lat: np.ndarray, ele: np.ndarray | None, tolerance: float = 2.0, jump_m: float = 2500.0) -> list[list[list[float]]]:
    """Parts of a line as it is shown: parted at jumps, simplified with heights where every point of a part has one,
    rounded to 5 decimals (heights to 1)."""
    out = []
    for p in parts_of(lon, lat, jump_m):
        high = None if ele is None or np.isnan(ele[p]).any() else ele[p]
        keep = p[simplify(lon[p], lat[p], high, tolerance)]
        out.append([[round(float(lon[k]), 5), round(float(lat[k]), 5), *([] if ele is None or np.isnan(ele[k]) else [round(float(ele[k]), 1)])] for k in keep])
    return out


def display_geometry(fixes: DataFrame, tolerance: float = 2.0, jump_m: float = 2500.0) -> DataFrame:
    """activity_id, kind (LineString or MultiLineString), parts (arrays of [lon, lat] or [lon, lat, height]) and points of
    fixes (activity_id, seq, lon, lat, ele); traces of fewer than two points are left out."""

    def run(batches):
        for b in batches:
            rows = []
            for key, lon, lat, ele in traces(b):
                if len(lon) >= 2:
                    parts = compact_line(lon, lat, np.asarray(ele, float), tolerance, jump_m)
                    rows.append((key, "LineString" if len(parts) == 1 else "MultiLineString", parts, sum(map(len, parts))))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.list_(pa.list_(pa.list_(pa.float64()))), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["activity_id", "kind", "parts", "points"])

    return packed(fixes.dropna(subset=["lon", "lat"]), "lon", "lat", "ele").mapInArrow(run, "activity_id long, kind string, parts array<array<array<double>>>, points int")


def share_lines(fixes: DataFrame, radius: float = 200.0, tolerance: float = 2.0, jump_m: float = 2500.0, far_km: float = 300.0) -> DataFrame:
    """activity_id, sport, parts ([lon, lat] to 5 decimals) of what a share may show of fixes (activity_id, sport, seq, lon,
    lat): strays out, broken at jumps, masked on recorded fixes, then simplified; what is wholly masked has no row."""

    def run(batches):
        for b in batches:
            rows = []
            for key, sport, lon, lat in traces(b):
                near = near_median(lon, lat, far_km)
                lon, lat = lon[near], lat[near]
                parts = []
                for p in masked_pieces(lon, lat, runs_of(lon, lat, jump_m), radius):
                    keep = p[simplify(p[:, 0], p[:, 1], tolerance=tolerance)]
                    if len(keep) >= 2:
                        parts.append(np.round(keep, 5).tolist())
                if parts:
                    rows.append((key, sport[0], parts))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.list_(pa.list_(pa.list_(pa.float64())))), strict=True)], names=["activity_id", "sport", "parts"])

    return packed(fixes.dropna(subset=["lon", "lat"]), "sport", "lon", "lat").mapInArrow(run, "activity_id long, sport string, parts array<array<array<double>>>")


def share_features(lines: DataFrame) -> DataFrame:
    """value: a GeoJSON line of each of share_lines(), which tells the sport and nothing else."""
    body = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("MultiLineString").alias("type"), F.col("parts").alias("coordinates")).alias("geometry"), F.struct(F.coalesce("sport", F.lit("road")).alias("sport")).alias("properties"))
    return lines.select(F.to_json(body).alias("value"))


def outline(fixes: DataFrame, degrees: float = 1e-4) -> DataFrame:
    """activity_id and coords ([lon, lat] to 5 decimals): lines simplified in degrees, ends kept, as databases do."""

    def run(batches):
        for b in batches:
            rows = []
            for key, lon, lat in traces(b):
                if len(lon) >= 2:
                    keep = simplify(lon, lat, tolerance=degrees, plane=True)
                    rows.append((key, np.round(np.column_stack([lon[keep], lat[keep]]), 5).tolist()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.list_(pa.float64())))], names=["activity_id", "coords"])

    return packed(fixes.dropna(subset=["lon", "lat"]), "lon", "lat").mapInArrow(run, "activity_id long, coords array<array<double>>")


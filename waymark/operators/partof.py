"""Which way a track is a part of, where many tracks and many ways run along one road.

What passes near a point of a track is a row of bits, one a way; ways that pass near all of a track's points are the
conjunction of such rows, 64 ways an operation. Only these are measured, and of those alike near the track only the
first. Small distances are tried first: a track that lies on a way never meets the ways beside it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from waymark.functions.geo import DEGREE_M
from waymark.session import ensure_checkpoint_dir

#: Tracks and ways of a block, points of a track that are looked up, bytes of bits and pairs held at once.
TRACKS, WAYS, LOOKED_UP, HELD = 8192, 16384, 16, 1 << 25
#: The distances tried, as parts of the greatest.
PARTS = (1 / 64, 1 / 8, 1.0)
#: A region's side in times the greatest distance, and the longest step along a way in the same.
SIDE, STEP = 64, 8


def _spans(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... (n of them) of each, one after the other."""
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def _gaps(points: np.ndarray, a: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Metres from points to legs that begin at a and go d."""
    square = (d**2).sum(axis=-1)
    t = np.clip(((points - a) * d).sum(axis=-1) / np.where(square > 0, square, 1), 0, 1)
    return np.hypot(*np.moveaxis(points - a - t[..., None] * d, -1, 0))


def _near(points: np.ndarray, a: np.ndarray, d: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Points and legs within reach of each other, in order of the points. Legs are found by their samples' grid cells:
    samples are a cell's side apart, and reach is half of one at most."""
    length = np.hypot(*d.T)
    side = max(2 * reach, length.sum() / (1 << 20))
    n = np.ceil(length / side).astype(np.int64) + 1
    leg = np.repeat(np.arange(len(a)), n + 1)
    t = _spans(np.zeros(len(n), np.int64), n + 1) / n[leg]
    cell = lambda p: np.clip(np.floor(p / side), -(1 << 29), 1 << 29).astype(np.int64)
    key = lambda c: c[:, 0] * (1 << 31) + c[:, 1]
    keys = key(cell(a[leg] + d[leg] * t[:, None]))
    order = np.lexsort((leg, keys))
    keys, leg = keys[order], leg[order]
    first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (leg[1:] != leg[:-1])])
    keys, leg, own, found = keys[first], leg[first], key(cell(points)), []
    for step in (x * (1 << 31) + y for x in (-1, 0, 1) for y in (-1, 0, 1)):
        lo, hi = np.searchsorted(keys, own + step, "left"), np.searchsorted(keys, own + step, "right")
        ends = np.cumsum(hi - lo)
        k = 0
        while k < len(points):
            z = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + (HELD >> 6), "right")))
            p, m = np.repeat(np.arange(k, z), hi[k:z] - lo[k:z]), leg[_spans(lo[k:z], hi[k:z] - lo[k:z])]
            near = _gaps(points[p], a[m], d[m]) <= reach
            found.append(p[near] * len(a) + m[near])
            k = z
    return np.divmod(np.unique(np.concatenate(found)), len(a))


class Lines:
    """Lines as ragged arrays: line k has the points from ends[k] up to ends[k + 1]."""

    def __init__(self, ends: np.ndarray, points: np.ndarray):
        self.ends, self.points = ends, points

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, k: int) -> np.ndarray:
        return self.points[self.ends[k] : self.ends[k + 1]]

    def part(self, a: int, z: int) -> Lines:
        return Lines(self.ends[a : z + 1] - self.ends[a], self.points[self.ends[a] : self.ends[z]])


def _distinct(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, back = np.unique(points[:, 0] + 1j * points[:, 1], return_inverse=True)
    return np.stack([at.real, at.imag], axis=1), back


def _legs(ways: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ways [n, (lon, lat)] of the distinct legs, where each way's begin, and these as numbers of legs. A way of
    one point has one leg, which goes nowhere."""
    at, back = _distinct(ways.points)
    n = np.diff(ways.ends)
    of = _spans(ways.ends[:-1], np.maximum(1, n - 1))
    to = np.where(np.repeat(n, np.maximum(1, n - 1)) > 1, of + 1, of)
    legs, own = np.unique(back[of] * len(at) + back[to.clip(max=len(back) - 1)], return_inverse=True)
    a, b = np.divmod(legs, len(at))
    return at[a], at[b] - at[a], np.concatenate([[0], np.cumsum(np.maximum(1, n - 1))]), own


def candidates(tracks: Lines, ways: Lines, radius: float, alike: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """A track and the numbers of ways (ascending) that may pass within radius metres of all its points; none that does is
    missing but, if alike, those that are like an earlier one near the track."""
    starts, gone, begins, own = _legs(ways)
    if len(starts) * len(ways) // 8 > HELD and len(ways) > 64:
        half = len(ways) // 2
        for a, z in ((0, half), (half, len(ways))):
            yield from ((k, found + a) for k, found in candidates(tracks, ways.part(a, z), radius, alike))
        return
    # Each track has a scale of its own; in the least of them no distance is longer than in its own.
    means = np.add.reduceat(tracks.points[:, 1], tracks.ends[:-1]) / np.diff(tracks.ends)
    scale = DEGREE_M * np.array([np.abs(np.cos(np.radians(means))).min() * (1 - 1e-9), 1.0])
    a, d, reach = starts * scale, gone * scale, radius * (1 + 1e-6) + 1e-5
    bits = np.zeros((len(a), -(-len(ways) // 64) * 8), np.uint8)
    way = np.repeat(np.arange(len(ways)), np.diff(begins))
    np.bitwise_or.at(bits, (own, way >> 3), np.left_shift(1, way & 7).astype(np.uint8))
    bits = bits.view(np.uint64)
    at, back = _distinct(tracks.points)
    n = np.diff(tracks.ends)
    looked = back[tracks.ends[:-1, None] + (np.linspace(0, 1, LOOKED_UP) * (n - 1)[:, None]).astype(np.int64)]
    asked, looked = np.unique(looked, return_inverse=True)
    looked = looked.reshape(len(tracks), LOOKED_UP)
    p, m = _near(at[asked] * scale, a, d, reach)
    # Points that the same legs pass have one row of bits.
    lo = np.searchsorted(p, np.arange(len(asked) + 1))
    rows, legs_of = {}, []
    row = np.empty(len(asked), np.int64)
    for k in range(len(asked)):
        legs = m[lo[k] : lo[k + 1]]
        row[k] = rows.setdefault(legs.tobytes(), len(rows))
        if row[k] == len(legs_of):
            legs_of.append(legs)
    looked = row[looked]
    step = max(1, HELD // (LOOKED_UP * bits.shape[1] * 8))
    for k in range(0, len(tracks), step):
        used, inner = np.unique(looked[k : k + step], return_inverse=True)
        inner = inner.reshape(-1, LOOKED_UP)
        passing = np.stack([np.bitwise_or.reduce(bits[legs_of[r]], axis=0) for r in used])
        both = passing[inner[:, 0]]
        for c in range(1, LOOKED_UP):
            both &= passing[inner[:, c]]
        for i in np.flatnonzero(both.any(axis=1)):
            met = np.flatnonzero(np.unpackbits(both[i].view(np.uint8), bitorder="little"))
            yield int(k + i), _first_alike(tracks[k + i] * scale, met, begins, own, a, d, reach) if alike else met


def _first_alike(track: np.ndarray, met: np.ndarray, begins: np.ndarray, own: np.ndarray, a: np.ndarray, d: np.ndarray, reach: float) -> np.ndarray:
    """The first of those ways that have the same legs within reach of the track's points: where all points are within
    reach of a way, no other leg tells its distance."""
    if len(met) < 2:
        return met
    n = begins[met + 1] - begins[met]
    legs, back = np.unique(own[_spans(begins[met], n)], return_inverse=True)
    box = np.minimum(a[legs], a[legs] + d[legs]), np.maximum(a[legs], a[legs] + d[legs])
    near = (box[0] <= track.max(axis=0) + reach).all(axis=1) & (box[1] >= track.min(axis=0) - reach).all(axis=1)
    close = np.flatnonzero(near)
    near[:] = False
    step = max(1, (HELD >> 6) // max(1, len(close)))
    for k in range(0, len(track), step):
        near[close] |= (_gaps(track[k : k + step, None], a[legs[close]][None], d[legs[close]][None]) <= reach).any(axis=0)
    kept = near[back]
    ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(n)])]
    back, firsts = back[kept], {}
    for k in range(len(met)):
        firsts.setdefault(back[ends[k] : ends[k + 1]].tobytes(), met[k])
    return np.array(list(firsts.values()), np.int64)


def _lines(rows: pa.Table) -> Lines:
    x, y = (rows[c].combine_chunks() for c in ("x", "y"))
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return Lines(ends, np.stack([c.flatten().to_numpy(zero_copy_only=False) for c in (x, y)], axis=1))


def _by_id(rows: pa.Table, name: str) -> pa.Table:
    """In order of a column as Spark has it: nulls first, structs field by field."""
    keys = rows.select([name])
    while any(pa.types.is_struct(c.type) for c in keys.columns):
        keys = keys.flatten()
    keys = keys.rename_columns([str(k) for k in range(keys.num_columns)])
    return rows.take(pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names], null_placement="at_start"))


def _found(tracks: DataFrame, ways: DataFrame, radius: float, good: Callable, buffer_m: float) -> DataFrame:
    """digest, way_id, hausdorff_m and overlap of a block's closest way, for tracks that have a good one within radius."""
    spark, region = tracks.sparkSession, ["ry", "rx"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    sizes = tracks.groupBy(region).agg(F.ceil(F.count("*") / TRACKS).alias("ps")).join(ways.groupBy(region).agg(F.ceil(F.count("*") / WAYS).alias("qs")), region)
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    t = tracks.join(sizes, region).withColumn("p", dealt("digest", "ps")).withColumn("q", every("qs")).withColumn("is_track", F.lit(True))
    w = ways.join(sizes, region).withColumn("q", dealt("way_id", "qs")).withColumn("p", every("ps")).withColumn("is_track", F.lit(False))
    both = t.unionByName(w, allowMissingColumns=True).select(*region, "p", "q", "is_track", "digest", "way_id", "x", "y")
    types = {s.name: s.dataType for s in both.schema}
    schema = StructType([StructField(c, types[c]) for c in ("digest", "way_id")] + [StructField(c, DoubleType()) for c in ("hausdorff_m", "overlap")])

    def block(rows: pa.Table) -> pa.Table:
        own = rows.filter(rows["is_track"])
        others = _by_id(rows.filter(pc.invert(rows["is_track"])), "way_id")
        lines, roads, best = _lines(own), _lines(others), {}
        if len(lines) and len(roads):
            # Within the buffer the overlap is whole; beyond it, legs that are not near the points tell it too.
            for k, near in candidates(lines, roads, radius, radius <= buffer_m):
                for j in near:
                    far, share = good(lines[k], roads[j])
                    if far < radius:
                        best[k] = min(best.get(k, (np.inf, 0, 0.0)), (far, j, share))
        far, way, share = zip(*best.values()) if best else ((), (), ())
        ids = own["digest"].take(pa.array(list(best), pa.int64())), others["way_id"].take(pa.array(way, pa.int64()))
        return pa.table([*ids, pa.array(far, pa.float64()), pa.array(share, pa.float64())], names=schema.names)

    return both.repartition(parts, *region, "p", "q").groupBy(*region, "p", "q").applyInArrow(block, schema)


def _about_first(lines: Lines, tall: float) -> tuple[np.ndarray, ...]:
    """Lines and boxes (west, south, east, north): what a track's first point has within tall degrees of latitude, in the
    track's own scale."""
    x, y = lines.points[lines.ends[:-1]].T
    means = np.add.reduceat(lines.points[:, 1], lines.ends[:-1]) / np.diff(lines.ends)
    gap = tall / np.maximum(np.abs(np.cos(np.radians(means))), 1e-6)
    return np.arange(len(lines)), x - gap, y - tall, x + gap, y + tall


def _along(lines: Lines, tall: float) -> tuple[np.ndarray, ...]:
    """Lines and boxes about samples of their legs, which hold all of a line."""
    half, n = STEP * tall / 2, np.diff(lines.ends)
    of = _spans(lines.ends[:-1], np.maximum(1, n - 1))
    to = np.where(np.repeat(n, np.maximum(1, n - 1)) > 1, of + 1, of).clip(max=len(lines.points) - 1)
    a, d = lines.points[of], lines.points[to] - lines.points[of]
    steps = np.ceil(np.abs(d).max(axis=1) / (2 * half)).astype(np.int64) + 1
    leg = np.repeat(np.arange(len(a)), steps + 1)
    x, y = (a[leg] + d[leg] * (_spans(np.zeros(len(a), np.int64), steps + 1) / steps[leg])[:, None]).T
    return np.repeat(np.repeat(np.arange(len(lines)), np.maximum(1, n - 1)), steps + 1), x - half, y - half, x + half, y + half


def _regions(d: DataFrame, boxes: Callable, tall: float) -> DataFrame:
    """A row for each region (ry, rx) that a box of the line x, y of a row reaches. A row of regions has one width."""
    side = SIDE * tall

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            row, w, s, e, n = boxes(_lines(pa.Table.from_batches([b])), tall)
            lo, many = np.floor(s / side).astype(np.int64), (np.floor(n / side) - np.floor(s / side)).astype(np.int64) + 1
            row, w, e, ry = np.repeat(row, many), np.repeat(w, many), np.repeat(e, many), _spans(lo, many)
            wide = side / np.maximum(np.cos(np.radians(np.abs(ry * side) + 2 * side)), 1e-6)
            lo, many = np.floor(w / wide).astype(np.int64), (np.floor(e / wide) - np.floor(w / wide)).astype(np.int64) + 1
            row, ry, rx = np.unique(np.stack([np.repeat(row, many), np.repeat(ry, many), _spans(lo, many)]), axis=1)
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(row)).columns, pa.array(ry), pa.array(rx)], names=[*b.schema.names, "ry", "rx"])

    return d.mapInArrow(run, StructType([*d.schema.fields, StructField("ry", LongType()), StructField("rx", LongType())]))


def closest_whole(tracks: DataFrame, ways: DataFrame, measure: Callable, hausdorff_m: float, overlap: float, buffer_m: float) -> DataFrame:
    """track_id, way_id, hausdorff_m and overlap of the closest way of each track that has one (ties: the smaller id);
    a track may be any part of a way. measure gives both of a track and a way; the overlap is 1 up to buffer_m.

    Tracks and ways of one geometry are measured once. They meet in regions, that of a track's first point and those that a
    way runs through, and there in blocks of tracks and of ways. A track whose closest way is nearer than a small distance
    is done with when that has been tried."""
    ensure_checkpoint_dir(tracks.sparkSession)
    tall = hausdorff_m / DEGREE_M * 1.01
    known = F.forall("coords", lambda p: (F.abs(F.get(p, F.lit(0))) < float("inf")) & (F.abs(F.get(p, F.lit(1))) < float("inf")))
    line = [F.transform("coords", lambda p: F.get(p, F.lit(0))).alias("x"), F.transform("coords", lambda p: F.get(p, F.lit(1))).alias("y")]
    lines = lambda d: d.filter((F.size("coords") > 0) & known)

    # 128 bits of digest name a geometry, so that points are shuffled once.
    digest = F.struct(F.xxhash64("coords").alias("a"), F.xxhash64(F.lit(1), "coords").alias("b")).alias("digest")
    own = lines(tracks).select("track_id", digest, *line).checkpoint()
    todo = _regions(own.groupBy("digest").agg(F.first("x").alias("x"), F.first("y").alias("y")), _about_first, tall).checkpoint()
    roads = lines(ways.dropna(subset=["way_id"])).groupBy("coords").agg(F.min("way_id").alias("way_id")).select("way_id", *line)
    roads = _regions(roads, _along, tall).checkpoint()

    def good(track: np.ndarray, way: np.ndarray) -> tuple[float, float]:
        far, share = measure(track, way, directed=True, limit=hausdorff_m)
        return (far, share) if share >= overlap else (np.inf, share)

    best = None
    for part in PARTS:
        found = _found(todo, roads, part * hausdorff_m, good, buffer_m)
        found = found.groupBy("digest").agg(F.min(F.struct("hausdorff_m", "way_id", "overlap")).alias("b")).checkpoint()
        best = found if best is None else best.unionByName(found)
        todo = todo.join(found.select("digest"), "digest", "left_anti").checkpoint()
        if todo.isEmpty():
            break
    told = own.select("track_id", "digest").join(best, "digest").groupBy("track_id").agg(F.min("b").alias("b"))
    return told.select("track_id", "b.way_id", "b.hausdorff_m", "b.overlap")

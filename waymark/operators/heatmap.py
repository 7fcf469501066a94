"""From gated points to graded, directed pieces of trail: what the community map draws.

Smoothing and splitting are sequential in one run, so they work through packed traces in Arrow batches; values of
cells, directions and heat are joins and aggregates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import cumulative
from waymark.operators.packed import packed, traces
from waymark.operators.shapes import level_pieces, simplify

PIECES = "activity_id long, sport string, run long, piece int, terminal boolean, pass_count long, user_count long, eff long, lon array<double>, lat array<double>"
DEGREES = 0.0001


def lower_median(values: np.ndarray) -> int:
    return int(np.sort(values)[(len(values) - 1) >> 1])


def rolling_lower_median(values: np.ndarray, travelled: np.ndarray, metres: float = 50.0, points: int = 256) -> np.ndarray:
    """The lower median of each point's neighbours within so many metres of way and so many points."""
    if not len(values) or values.min() == values.max():
        return np.asarray(values, np.int64)
    at = np.arange(len(values))
    first = np.maximum(np.searchsorted(travelled, travelled - metres, "left"), at - points)
    last = np.minimum(np.searchsorted(travelled, travelled + metres, "right"), at + points + 1)
    return np.array([lower_median(values[a:b]) for a, b in zip(first, last, strict=True)], dtype=np.int64)


def graded_pieces(points: DataFrame, metres: float = 50.0, least: float = 200.0) -> DataFrame:
    """The pieces of each run, of points (activity_id, run, seq, sport, lon, lat, pass_count, user_count, eff).

    Neighbouring pieces share a vertex; it counts for the later one only. Runs of one point have no piece; points
    without a position are passed over."""

    def run(batches):
        for b in batches:
            out = []
            for key, runs, sport, lon, lat, *series in traces(b):
                for r in np.unique(runs):
                    own = runs == r
                    if own.sum() < 2:
                        continue
                    x, y = lon[own], lat[own]
                    way = cumulative(x, y)
                    passes, users, eff = (rolling_lower_median(s[own], way, metres) for s in series)
                    cuts = level_pieces(passes, eff, way, least)
                    for k, (i, j) in enumerate(cuts):
                        end = j + 1 if k == len(cuts) - 1 else j
                        out.append((key, sport[0], int(r), k, k == len(cuts) - 1, lower_median(passes[i:end]), lower_median(users[i:end]), lower_median(eff[i:end]), x[i : j + 1].tolist(), y[i : j + 1].tolist()))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split(" ")[0] for c in PIECES.split(", ")])

    return packed(points.dropna(subset=["lon", "lat"]), "run", "sport", "lon", "lat", "pass_count", "user_count", "eff").mapInArrow(run, PIECES)


def directed(pieces: DataFrame, cells: DataFrame) -> DataFrame:
    """pieces with oneway_score, forward_count and backward_count, their points turned to run with the main flow.

    cells: sport, ilat, ilon, passes, rx, ry, rw (sums of metres eastward, northward and in all) and forward and
    backward. A piece whose cells know no direction scores 0 and stays as it is."""
    key = ["activity_id", "run", "piece"]
    cell = lambda c: F.floor(F.col(c) / DEGREES).cast("long")
    n = F.size("lon") - F.when(F.col("terminal"), 0).otherwise(1)
    legs = pieces.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1))).select(*key, "sport", "i", n.alias("n"), F.col("pass_count").alias("typical"), *[F.get(c, F.col("i") + k).alias(f"{c}{k}") for c in ("lon", "lat") for k in (0, 1)])
    met = legs.withColumn("ilat", cell("lat0")).withColumn("ilon", cell("lon0")).join(cells, ["sport", "ilat", "ilon"])
    met = met.withColumn("ux", F.expr("radians(lon1 - lon0) * cos(radians((lat0 + lat1) / 2))")).withColumn("uy", F.expr("radians(lat1 - lat0)")).withColumn("u", F.expr("CASE WHEN i + 1 < n THEN sqrt(ux * ux + uy * uy) END"))
    flow = met.groupBy(*key).agg(F.sum(F.expr("CASE WHEN u * 6371000 >= 2 THEN (rx * ux + ry * uy) / u END")).alias("flow"))
    seen = met.groupBy(*key, "ilat", "ilon", "typical", "passes", "rx", "ry", "rw", "forward", "backward").agg(F.min("i").alias("first"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.abs(F.col("passes") - F.col("typical")), (F.col("forward") + F.col("backward")).desc(), "first"))
    told = seen.withColumn("rk", rank).groupBy(*key).agg(F.round(F.avg(F.expr("sqrt(rx * rx + ry * ry) / rw")), 3).alias("oneway"), F.max(F.expr("CASE WHEN rk = 1 THEN forward END")).alias("f"), F.max(F.expr("CASE WHEN rk = 1 THEN backward END")).alias("b"))
    back = F.coalesce(F.col("flow") < 0, F.lit(False))
    turned = {c: F.when(back, F.reverse(c)).otherwise(F.col(c)) for c in ("lon", "lat")}
    found = pieces.join(told, key, "left").join(flow, key, "left").withColumns(turned)
    return found.select(*pieces.columns, F.coalesce("oneway", F.lit(0.0)).alias("oneway_score"), F.coalesce(F.greatest("f", "b"), F.lit(0)).alias("forward_count"), F.coalesce(F.least("f", "b"), F.lit(0)).alias("backward_count"))


def stripped(pieces: DataFrame, metres: float = 1e-4) -> DataFrame:
    """pieces without the points that lie on the straight line between others, as densifying has set them."""
    at = [pieces.columns.index(c) for c in ("lon", "lat")]

    def run(batches):
        for b in batches:
            lists = [b.column(k) for k in at]
            ends = np.cumsum([0, *lists[0].value_lengths().to_pylist()])
            lon, lat = (c.flatten().to_numpy(zero_copy_only=False) for c in lists)
            keep = [i + simplify(lon[i:j], lat[i:j], tolerance=metres) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            flat, size = np.concatenate([np.zeros(0, np.int64), *keep]), np.cumsum([0, *map(len, keep)])
            columns = list(b.columns)
            for k, values in zip(at, (lon, lat), strict=True):
                columns[k] = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(values[flat]))
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return pieces.mapInArrow(run, pieces.schema)


def heated(pieces: DataFrame, lattice: DataFrame) -> DataFrame:
    """pieces with heat_score on the scale of the lattice's 99.9th percentile of effective passes; that is one row."""
    top = lattice.agg(F.greatest(F.lit(1), F.expr("percentile_disc(0.999) WITHIN GROUP (ORDER BY eff)")).alias("top"))
    return pieces.crossJoin(F.broadcast(top)).withColumn("heat_score", F.expr("round(least(1D, ln(1 + eff) / ln(1 + top)), 3)")).drop("top")

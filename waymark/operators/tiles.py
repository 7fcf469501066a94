"""Map tiles of popular lines, vector and raster.

Lines are put on each tile's own grid before anything is shuffled, and what falls on the same two grid points is
merged by an aggregate with map-side combining. So a tile's legs are bounded by its grid, however many traces cross it,
and a tile is small enough to be one group, the hottest and coarsest included.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = ["z", "x", "y"]
ENDS = ["x0", "y0", "x1", "y1"]
VALUES = ["user_count", "pass_count", "heat_score"]
#: Colours of the popularity buckets (1-2, 3-5, 6-15, 16-50, 51 and more passes) and their line widths.
COLOURS = {1: (255, 200, 120), 2: (255, 160, 80), 3: (255, 110, 50), 4: (230, 50, 40), 5: (170, 10, 60)}
WIDTHS = {1: 1, 2: 1, 3: 2, 4: 3, 5: 3}


def _merged(legs: DataFrame) -> DataFrame:
    """Legs with world positions wx0 … wy1 in grid steps, dealt to the tiles they cross, equal ones merged.

    A leg is sampled at quarter tiles, so a corner cut shorter than that may be missed."""
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.expr("wx1 - wx0")), F.abs(F.expr("wy1 - wy0"))) * 4 / F.col("grid")))
    at = lambda axis: f"CAST(floor((w{axis}0 + (w{axis}1 - w{axis}0) * k / steps) / grid) AS BIGINT)"
    crossed = F.expr(f"array_distinct(transform(sequence(0, CAST(steps AS INT)), k -> named_struct('x', {at('x')}, 'y', {at('y')})))")
    dealt = legs.withColumn("steps", steps).withColumn("t", F.explode(crossed)).select("z", "t.x", "t.y", "sport", *[F.expr(f"CAST(w{c} - t.{c[0]} * grid AS INT)").alias(c) for c in ENDS], *VALUES)
    return dealt.groupBy(*TILE, "sport", *ENDS).agg(*[F.max(v).alias(v) for v in VALUES])


def tile_legs(lines: DataFrame, zooms: list[int], grid: int = 512) -> DataFrame:
    """z, x, y, sport, leg ends on the tile's grid (0 to grid, beyond it where a leg leaves) and the largest
    user_count, pass_count and heat_score of the lines on the leg, of lines (sport, lon, lat arrays and these three).

    Lines without two different grid points at a zoom are not in it; a line with a null position is left out."""
    world = F.pow(F.lit(2.0), F.col("z")) * grid
    siny = lambda p: F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), F.sin(F.radians(p))))
    points = F.arrays_zip("lon", "lat")
    put = F.transform(points, lambda p: F.struct(F.floor((p["lon"] + 180) / 360 * world).alias("x"), F.floor((0.5 - F.log((1 + siny(p["lat"])) / (1 - siny(p["lat"]))) / (4 * np.pi)) * world).alias("y")))
    whole = ~F.exists("lon", lambda v: v.isNull()) & ~F.exists("lat", lambda v: v.isNull())
    q = lines.filter(whole & (F.size("lon") == F.size("lat"))).withColumn("z", F.explode(F.array(*[F.lit(z) for z in zooms]))).withColumn("q", put)
    q = q.withColumn("q", F.expr("filter(q, (p, i) -> i = 0 OR p <> q[i - 1])")).filter("size(q) >= 2")
    leg = q.withColumn("leg", F.explode(F.expr("transform(sequence(1, size(q) - 1), i -> named_struct('a', least(q[i - 1], q[i]), 'b', greatest(q[i - 1], q[i])))")))
    return _merged(leg.select("z", "sport", F.lit(grid).alias("grid"), *[F.col(f"leg.{e}.{c}").alias(f"w{c}{k}") for k, e in enumerate("ab") for c in "xy"], *VALUES))


def in_box(legs: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """The legs of the tiles that a box touches, for a tile file of a region."""
    column = lambda lon: F.floor((F.lit(lon) + 180) / 360 * F.pow(F.lit(2.0), F.col("z")))
    siny = lambda lat: max(-0.9999, min(0.9999, float(np.sin(np.radians(lat)))))
    row = lambda lat: F.floor((0.5 - F.lit(float(np.log((1 + siny(lat)) / (1 - siny(lat))))) / (4 * np.pi)) * F.pow(F.lit(2.0), F.col("z")))
    return legs.filter(F.col("x").between(column(west), column(east)) & F.col("y").between(row(north), row(south)))


def overzoom(legs: DataFrame, levels: int, grid: int = 512) -> DataFrame:
    """The legs of the tiles so many zooms further in, as coarse as they are."""
    up = 1 << levels
    return _merged(legs.select((F.col("z") + levels).alias("z"), "sport", F.lit(grid).alias("grid"), *[((F.col(c[0]) * grid + F.col(c)) * up).alias(f"w{c}") for c in ENDS], *VALUES))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, data: bytes | int) -> bytes:
    return _varint(number << 3) + _varint(data) if isinstance(data, int) else _varint(number << 3 | 2) + _varint(len(data)) + data


def encode_tile(rows: list[tuple], grid: int, layer: str = "trails") -> bytes:
    """A vector tile of rows (sport, x0, y0, x1, y1, user_count, pass_count, heat_score); legs that agree in all their
    properties are one feature."""
    alike: dict[tuple, list] = {}
    for sport, x0, y0, x1, y1, *values in sorted(rows):
        alike.setdefault((sport, *values), []).append((x0, y0, x1, y1))
    names, known, features = ["sport", *VALUES], {}, []
    zig = lambda d: _varint(d << 1 if d >= 0 else (-d << 1) - 1)
    for props, legs in alike.items():
        tags, commands, x, y = b"", b"", 0, 0
        for k, v in enumerate(props):
            data = _field(1, v.encode()) if isinstance(v, str) else _field(5, v) if isinstance(v, int) else _varint(3 << 3 | 1) + struct.pack("<d", v)
            tags += _varint(k) + _varint(known.setdefault(data, len(known)))
        for x0, y0, x1, y1 in legs:
            commands += _varint(1 << 3 | 1) + zig(x0 - x) + zig(y0 - y) + _varint(1 << 3 | 2) + zig(x1 - x0) + zig(y1 - y0)
            x, y = x1, y1
        features.append(_field(2, _field(2, tags) + _field(3, 2) + _field(4, commands)))
    body = _field(15, 2) + _field(1, layer.encode()) + b"".join(features) + b"".join(_field(3, n.encode()) for n in names) + b"".join(_field(4, v) for v in known) + _field(5, grid)
    return _field(3, body)


def _tiles_in(batch: pa.RecordBatch):
    for row in batch.to_pylist():
        yield [row[c] for c in TILE], [tuple(leg.values()) for leg in row["legs"]]


def vector_tiles(legs: DataFrame, grid: int = 512, most_bytes: int = 500_000) -> DataFrame:
    """z, x, y, legs, dropped, tile. A tile has a size limit by definition: the least used legs are left out of one that
    would be larger than most_bytes, and counted in dropped."""
    grouped = legs.groupBy(*TILE).agg(F.sort_array(F.collect_list(F.struct(-F.col("pass_count"), -F.col("user_count"), F.struct("sport", *ENDS, *VALUES).alias("leg")))).alias("legs"))
    grouped = grouped.withColumn("legs", F.col("legs.leg"))

    def run(batches):
        for b in batches:
            out = []
            for t, rows in _tiles_in(b):
                found = len(rows)
                tile = encode_tile(rows, grid)
                while len(tile) > most_bytes and len(rows) > 1:
                    rows = rows[: min(len(rows) - 1, int(len(rows) * 0.98 * most_bytes / len(tile)) or 1)]
                    tile = encode_tile(rows, grid)
                out.append((*t, len(rows), found - len(rows), tile))
            yield pa.RecordBatch.from_pylist([dict(zip([*TILE, "legs", "dropped", "tile"], r, strict=True)) for r in out], schema=pa.schema([("z", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("legs", pa.int64()), ("dropped", pa.int64()), ("tile", pa.binary())]))

    return grouped.mapInArrow(run, "z int, x long, y long, legs long, dropped long, tile binary")


def bucket(passes: int) -> int:
    return 1 + sum(passes > most for most in (2, 5, 15, 50))


def draw(rows: list[tuple], size: int) -> np.ndarray:
    """Bucket of each pixel (0: none), of rows (bucket, x0, y0, x1, y1); the more popular is painted over the less."""
    image = np.zeros((size, size), np.uint8)
    for b, x0, y0, x1, y1 in sorted(rows):
        n = max(abs(x1 - x0), abs(y1 - y0), 1)
        k = np.arange(n + 1) / n
        px, py = np.rint(x0 + (x1 - x0) * k).astype(int), np.rint(y0 + (y1 - y0) * k).astype(int)
        for dx in range(WIDTHS[b]):
            for dy in range(WIDTHS[b]):
                ok = (px + dx >= 0) & (px + dx < size) & (py + dy >= 0) & (py + dy < size)
                image[py[ok] + dy, px[ok] + dx] = b
    return image


def png(image: np.ndarray) -> bytes:
    """A bucket image as PNG with a palette, transparent where there is nothing."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = image.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), image], axis=1).tobytes()
    palette = bytes([0, 0, 0, *[v for b in sorted(COLOURS) for v in COLOURS[b]]])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 3, 0, 0, 0)) + chunk(b"PLTE", palette) + chunk(b"tRNS", bytes([0] + [255] * len(COLOURS))) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def raster_tiles(legs: DataFrame, size: int = 256, sport: str | None = None) -> DataFrame:
    """z, x, y, lit (pixels), top (highest bucket), png of legs on a grid of size; of one sport or of all."""
    rows = legs if sport is None else legs.filter(F.col("sport") == sport)
    marked = rows.withColumn("bucket", F.expr("CASE WHEN pass_count <= 2 THEN 1 WHEN pass_count <= 5 THEN 2 WHEN pass_count <= 15 THEN 3 WHEN pass_count <= 50 THEN 4 ELSE 5 END"))
    one = marked.groupBy(*TILE, *ENDS).agg(F.max("bucket").alias("bucket"))
    grouped = one.groupBy(*TILE).agg(F.collect_list(F.struct("bucket", *ENDS)).alias("legs"))

    def run(batches):
        for b in batches:
            out = []
            for tile, found in _tiles_in(b):
                image = draw(found, size)
                out.append(dict(zip([*TILE, "lit", "top", "png"], (*tile, int((image > 0).sum()), int(image.max()), png(image)), strict=True)))
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("z", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("lit", pa.int64()), ("top", pa.int32()), ("png", pa.binary())]))

    return grouped.mapInArrow(run, "z int, x long, y long, lit long, top int, png binary")


def coverage(legs: np.ndarray, width: float, size: int) -> np.ndarray:
    """How much of each pixel lines of that width with round ends cover, 0 to 1; legs are (x0, y0, x1, y1) in pixels and
    may lie outside. Where legs meet or cross, the most that one covers counts, so joints are as smooth as ends."""
    out = np.zeros((size, size), np.float32)
    reach = width / 2 + 1
    for x0, y0, x1, y1 in legs:
        left, right = max(0, int(min(x0, x1) - reach)), min(size, int(max(x0, x1) + reach) + 1)
        top, bottom = max(0, int(min(y0, y1) - reach)), min(size, int(max(y0, y1) + reach) + 1)
        if left >= right or top >= bottom:
            continue
        x, y = np.arange(left, right) + 0.5 - x0, (np.arange(top, bottom) + 0.5 - y0)[:, None]
        dx, dy = x1 - x0, y1 - y0
        t = np.clip((x * dx + y * dy) / max(dx * dx + dy * dy, 1e-12), 0, 1)
        covered = np.clip(width / 2 + 0.5 - np.hypot(x - t * dx, y - t * dy), 0, 1)
        np.maximum(out[top:bottom, left:right], covered, out=out[top:bottom, left:right])
    return out


def draw_smooth(rows: list[tuple], grid: int, size: int = 256, finer: int = 2) -> np.ndarray:
    """Colour and opacity [size, size, 4] of rows (bucket, x0, y0, x1, y1) on a grid, drawn so many times finer and then
    brought down by a box filter; the more popular is painted over the less."""
    image, scale = np.zeros((size * finer, size * finer, 4), np.float32), size * finer / grid
    for b in sorted({r[0] for r in rows}):
        legs = np.array([r[1:] for r in rows if r[0] == b], float) * scale
        own = coverage(legs, WIDTHS[b] * finer, size * finer)[..., None]
        image = image * (1 - own) + np.array([*COLOURS[b], 255], np.float32) * own  # colours times opacity
    image = image.reshape(size, finer, size, finer, 4).mean(axis=(1, 3))
    opacity = image[..., 3:]
    colour = np.divide(image[..., :3] * 255, opacity, out=np.zeros_like(image[..., :3]), where=opacity > 0)
    return np.rint(np.concatenate([colour, opacity], axis=2)).clip(0, 255).astype(np.uint8)


def png_rgba(image: np.ndarray) -> bytes:
    """An image of colour and opacity as PNG."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w, _ = image.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * 4)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def smooth_tiles(legs: DataFrame, grid: int = 512, size: int = 256, finer: int = 2) -> DataFrame:
    """z, x, y, covered (the pixels' opacity added up, in whole pixels), top, png of smooth lines; legs as tile_legs or
    overzoom have them, on that grid. A tile's legs are bounded by its grid."""
    one = legs.withColumn("bucket", F.expr("CASE WHEN pass_count <= 2 THEN 1 WHEN pass_count <= 5 THEN 2 WHEN pass_count <= 15 THEN 3 WHEN pass_count <= 50 THEN 4 ELSE 5 END")).groupBy(*TILE, *ENDS).agg(F.max("bucket").alias("bucket"))
    grouped = one.groupBy(*TILE).agg(F.collect_list(F.struct("bucket", *ENDS)).alias("legs"))

    def run(batches):
        for b in batches:
            out = []
            for tile, found in _tiles_in(b):
                image = draw_smooth(found, grid, size, finer)
                out.append(dict(zip([*TILE, "covered", "top", "png"], (*tile, float(image[..., 3].sum()) / 255, max(r[0] for r in found), png_rgba(image)), strict=True)))
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("z", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("covered", pa.float64()), ("top", pa.int32()), ("png", pa.binary())]))

    return grouped.mapInArrow(run, "z int, x long, y long, covered double, top int, png binary")

"""Tile archives and vector tiles from elsewhere, read through Spark's binary source."""

from __future__ import annotations

import gzip
import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.geo import tile_of_hilbert_id


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def directory(data: bytes) -> list[tuple[int, int, int, int]]:
    """(tile id, run length, offset, length) of a directory's entries; a run of 0 points to a leaf."""
    n, at = _varint(data, 0)
    columns: list[list[int]] = []
    for _ in range(4):
        column = []
        for _ in range(n):
            value, at = _varint(data, at)
            column.append(value)
        columns.append(column)
    ids, runs, lengths, places = columns
    out, tile, after = [], 0, 0
    for i in range(n):
        tile += ids[i]
        offset = after if places[i] == 0 and i else places[i] - 1
        after = offset + lengths[i]
        out.append((tile, runs[i], offset, lengths[i]))
    return out


def tiles_of(content: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(z, x, y, unpacked tile) of a version 3 archive. ValueError: another format, or cut short."""
    if len(content) < 127 or content[:7] != b"PMTiles" or content[7] != 3:
        raise ValueError("not a version 3 tile archive")
    root, root_n, _, _, leaf, _, data, _ = struct.unpack_from("<8Q", content, 8)
    inner, outer = content[97], content[98]
    unpack = lambda raw, how: gzip.decompress(raw) if how == 2 else raw
    todo = [(root, root_n)]
    try:
        while todo:
            start, n = todo.pop()
            for tile, run, offset, length in directory(unpack(content[start : start + n], inner)):
                if run == 0:
                    todo.append((leaf + offset, length))
                    continue
                if data + offset + length > len(content):
                    raise ValueError("cut short")
                body = unpack(content[data + offset : data + offset + length], outer)
                for k in range(run):
                    yield *tile_of_hilbert_id(tile + k), body
    except (IndexError, EOFError, OSError) as e:
        raise ValueError(f"cut short: {e}") from None


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            n, at = _varint(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def lines_of(tile: bytes) -> list[tuple[int, list[list[tuple[int, int]]]]]:
    """The grid and the lines (and rings) of each layer of a vector tile; what breaks off keeps its beginning."""
    out = []
    for number, layer in _fields(tile):
        if number != 3:
            continue
        grid, lines = 4096, []
        for k, v in _fields(layer):
            if k == 5:
                grid = v
            elif k == 2:
                said = dict(_fields(v))
                if said.get(3) not in (2, 3):
                    continue
                raw, at, x, y, own = said.get(4, b""), 0, 0, 0, []
                while at < len(raw):
                    head, at = _varint(raw, at)
                    if head & 7 == 7:
                        own[-1].append(own[-1][0])
                        continue
                    for _ in range(head >> 3):
                        if at >= len(raw):
                            break
                        dx, at = _varint(raw, at)
                        dy, at = _varint(raw, at)
                        x, y = x + (dx >> 1 ^ -(dx & 1)), y + (dy >> 1 ^ -(dy & 1))
                        if head & 7 == 1:
                            own.append([])
                        own[-1].append((x, y))
                lines += [line for line in own if len(line) >= 2]
        out.append((grid, lines))
    return out


def read_tile_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, z, x, y, tile and error of the .pmtiles files under path; a broken file adds a row with error."""

    def run(batches):
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                part = []
                try:
                    for t in tiles_of(bytes(content)):
                        part.append((p, *t, None))
                        if len(part) == 256:
                            yield pd.DataFrame(part, columns=names)
                            part = []
                except ValueError as e:
                    part.append((p, None, None, None, None, str(e)))
                if part:
                    yield pd.DataFrame(part, columns=names).astype({"z": "Int32", "x": "Int64", "y": "Int64"})

    names = ["archive", "z", "x", "y", "tile", "error"]
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pmtiles").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, "archive string, z int, x long, y long, tile binary, error string")


def write_lines(features: DataFrame, path: str, by: str | None = None) -> None:
    """GeoJSON lines, gzip, of features (properties struct, coordinates array); by: a folder for each of its values."""
    body = F.to_json(F.struct(F.lit("Feature").alias("type"), "properties", F.struct(F.lit("LineString").alias("type"), F.col("coordinates")).alias("geometry"))).alias("value")
    rows = features.select(body, *([by] if by else []))
    out = rows.write.option("compression", "gzip").mode("overwrite")
    (out.partitionBy(by) if by else out).text(path)


def mbtiles(tiles: DataFrame, data: str, kind: str, below: int = 5) -> DataFrame:
    """z, px, py, n, content: SQLite tile files, one for each zoom and ancestor tile so many zooms above, of tiles
    (z, x, y and a binary column data). A file holds at most 4 ** below tiles, so it is small enough to be made in one
    piece; rows run from the south, as the format has it. kind: png or pbf."""

    def made(key, group: pd.DataFrame) -> pd.DataFrame:
        db = sqlite3.connect(":memory:")
        db.execute("CREATE TABLE metadata (name text, value text)")
        db.execute("CREATE TABLE tiles (zoom_level integer, tile_column integer, tile_row integer, tile_data blob)")
        db.execute("CREATE UNIQUE INDEX tile_index ON tiles (zoom_level, tile_column, tile_row)")
        db.executemany("INSERT INTO metadata VALUES (?, ?)", [("format", kind), ("minzoom", str(key[0])), ("maxzoom", str(key[0]))])
        db.executemany("INSERT INTO tiles VALUES (?, ?, ?, ?)", [(int(z), int(x), (1 << int(z)) - 1 - int(y), bytes(t)) for z, x, y, t in sorted(zip(group["z"], group["x"], group["y"], group[data], strict=True))])
        db.commit()
        return pd.DataFrame({"z": [key[0]], "px": [key[1]], "py": [key[2]], "n": [len(group)], "content": [db.serialize()]})

    placed = tiles.select("z", "x", "y", data, F.expr(f"shiftright(x, least(z, {below}))").alias("px"), F.expr(f"shiftright(y, least(z, {below}))").alias("py")).dropna()
    return placed.groupBy("z", "px", "py").applyInPandas(made, "z int, px long, py long, n long, content binary")


def write_pyramid(tiles: DataFrame, root: str, data: str = "png") -> None:
    """A file root/z/x/y.png for each of tiles (z, x, y and a binary column), written by the tasks themselves to any file
    system that Arrow knows by its URI (or a path that all machines share). A task that runs again writes the same."""

    def put(rows):
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(root)
        made = set()
        for r in rows:
            folder = f"{top}/{r['z']}/{r['x']}"
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(f"{folder}/{r['y']}.{data}") as out:
                out.write(bytes(r[data]))

    tiles.select("z", "x", "y", data).foreachPartition(put)


def purge_pyramid(tiles: DataFrame, root: str, data: str = "png") -> int:
    """Deletes the files of root that are no tile of tiles; how many there were. The listing and the comparison are
    Spark's, and the tasks delete."""
    path = F.regexp_extract("path", rf"/(\d+/\d+/\d+)\.{data}$", 1)
    held = tiles.sparkSession.read.format("binaryFile").option("pathGlobFilter", f"*.{data}").option("recursiveFileLookup", "true").load(root).select(path.alias("tile"))
    stale = held.filter("tile <> ''").join(tiles.select(F.concat_ws("/", "z", "x", "y").alias("tile")), "tile", "left_anti")

    def remove(batches):
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(root)
        for b in batches:
            for tile in b["tile"]:
                if system.get_file_info(f"{top}/{tile}.{data}").type != fs.FileType.NotFound:
                    system.delete_file(f"{top}/{tile}.{data}")
            yield pd.DataFrame({"n": [len(b)]})

    return int(stale.mapInPandas(remove, "n long").agg(F.sum("n")).first()[0] or 0)


def tile_json(tiles: DataFrame, url: str, bounds: tuple[float, float, float, float], name: str, attribution: str) -> dict:
    """The document that describes a pyramid: zooms of tiles, bounds west, south, east, north to 5 decimals."""
    low, high = tiles.agg(F.min("z"), F.max("z")).first()
    west, south, east, north = (round(v, 5) for v in bounds)
    return {"tilejson": "2.2.0", "name": name, "version": "1.0.0", "scheme": "xyz", "tiles": [url], "minzoom": low, "maxzoom": high, "bounds": [west, south, east, north], "center": [round((west + east) / 2, 5), round((south + north) / 2, 5), None if low is None else min(low + 4, high)], "attribution": attribution}

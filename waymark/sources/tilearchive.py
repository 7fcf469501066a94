"""Version 3 tile archives of any size: written in parts by many tasks, and looked up by ranges of bytes.

Tiles are dealt out by ranges of their place along the Hilbert curve. Each task writes its tiles' bytes as one part and
hands on their directory entries (runs of equal neighbours share one); prefix sums of the parts' sizes turn places in a
part into places in the archive, a second pass packs the leaf directories, and sums of their sizes give the one root
directory, which has an entry per leaf and fits the first 16 KiB. So no task and not the driver ever holds more than a
part or a leaf. A folder holds the parts and manifest.json, which names them in order: one after another they are the
archive. A task that runs again writes a part of another name, and only parts that the manifest names count.

Paths are URIs of a file system that Arrow knows, shared by all machines.
"""

from __future__ import annotations

import gzip
import json
import struct
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.geo import hilbert_tile_id, hilbert_tile_ids, tile_of_hilbert_id
from waymark.session import ensure_checkpoint_dir
from waymark.sources.tilefiles import directory

#: Fixed values of the format: header length, bytes that hold header and root, codes of compressions and tile kinds.
HEADER, FIRST = 127, 16_384
COMPRESSION = {"none": 1, "gzip": 2}
KINDS = {"mvt": 1, "png": 2, "jpeg": 3, "webp": 4}
#: Bytes of a part about, entries of a leaf at least, parts and leaves about at most (the root has an entry each).
PART_BYTES, LEAF_ENTRIES, MOST_PARTS, MOST_LEAVES = 256 << 20, 4096, 800, 800


def packed_directory(ids: np.ndarray, runs: np.ndarray, lengths: np.ndarray, offsets: np.ndarray) -> bytes:
    """A directory of entries in order of their ids, compressed; a run of 0 points to a leaf."""
    follows = np.concatenate([[False], offsets[1:] == offsets[:-1] + lengths[:-1]])[: len(ids)]
    said = np.concatenate([[len(ids)], np.diff(ids, prepend=0), runs, lengths, np.where(follows, 0, offsets + 1)]).astype(np.uint64)
    out = bytearray()
    for v in said.tolist():
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return gzip.compress(bytes(out), mtime=0)


def _entries(rows: Iterator[tuple[int, bytes]], put) -> Iterator[tuple[int, int, int, int]]:
    """(tile id, run, offset in the part, length) of tiles in order of their ids, whose bytes go to put. Of tiles of one
    id the first counts; neighbours of one content share an entry."""
    now, body, run, at, size = None, None, 0, 0, 0
    for tile, content in rows:
        if now is not None and tile < now + run:
            continue
        if now is not None and tile == now + run and content == body:
            run += 1
            continue
        if now is not None:
            yield now, run, at, size
        now, body, run, at, size = tile, content, 1, at + size, len(content)
        put(content)
    if now is not None:
        yield now, run, at, size


def write_archive(tiles: DataFrame, folder: str, data: str = "tile", kind: str = "mvt", compression: str = "gzip", metadata: dict | None = None, part_bytes: int = PART_BYTES, leaf_entries: int = LEAF_ENTRIES) -> dict:
    """Writes tiles (z, x, y and a binary column) to the folder as one archive and returns its manifest.

    A row with a null is passed over, a tile outside the world is an error (its id would be another's); of rows of one tile the least content counts. Content is stored compressed by
    `compression`. An empty table makes an archive without tiles."""
    spark = tiles.sparkSession
    ensure_checkpoint_dir(spark)
    rows = tiles.select("z", "x", "y", F.col(data).alias("body")).dropna()
    total, size, low, high = rows.agg(F.count(F.lit(1)), F.sum(F.length("body")), F.min("z"), F.max("z")).first()
    parts = max(1, min(MOST_PARTS, -(-(size or 0) // part_bytes)))
    leaf = max(leaf_entries, -(-total // MOST_LEAVES))

    def placed(batches):
        for b in batches:
            z, x, y = (b.column(k).to_numpy() for k in range(3))
            if ((z < 0) | (z > 26) | (np.minimum(x, y) < 0) | (np.maximum(x, y) >> np.clip(z, 0, 26) > 0)).any():
                raise ValueError("a tile is outside the world")
            yield pa.RecordBatch.from_arrays([pa.array(hilbert_tile_ids(z, x, y)), b.column(3)], names=["tile", "body"])

    ordered = rows.selectExpr("CAST(z AS LONG)", "CAST(x AS LONG)", "CAST(y AS LONG)", "body").mapInArrow(placed, "tile long, body binary").repartitionByRange(parts, "tile").sortWithinPartitions("tile", "body")

    def stored(batches):
        """Writes the part, then hands on its entries, a leaf a row."""
        system, top = fs.FileSystem.from_uri(folder)
        system.create_dir(top, recursive=True)
        at = TaskContext.get()
        name = f"tiles-{at.partitionId():05d}-{at.taskAttemptId()}"
        pack = gzip.compress if compression == "gzip" else bytes
        with system.open_output_stream(f"{top}/{name}") as out:
            bodies = ((t, pack(c, mtime=0) if compression == "gzip" else c) for b in batches for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            held = []
            for entry in _entries(bodies, out.write):
                held.append(entry)
                if len(held) == leaf:
                    yield row(at, name, held)
                    held = []
        if held:
            yield row(at, name, held)

    def row(at, name, held):
        ids, runs, offsets, lengths = (list(c) for c in zip(*held))
        return pa.RecordBatch.from_pydict({"pid": pa.array([at.partitionId()], pa.int32()), "file": [name], "first": [ids[0]], "bytes": [sum(l for _, _, _, l in held)], "ids": [ids], "runs": [runs], "offsets": [offsets], "lengths": [lengths]})

    entries = ordered.mapInArrow(stored, "pid int, file string, first long, bytes long, ids array<long>, runs array<long>, offsets array<long>, lengths array<long>").checkpoint()
    along = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    sums = entries.groupBy("pid", "file").agg(F.sum("bytes").alias("bytes"), F.sum(F.size("ids")).alias("entries"), F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda a, b: a + b)).alias("tiles"))
    bases = sums.withColumn("base", F.coalesce(F.sum("bytes").over(along), F.lit(0)))

    def leaves(batches):
        system, top = fs.FileSystem.from_uri(folder)
        at = TaskContext.get()
        name = f"leaves-{at.partitionId():05d}-{at.taskAttemptId()}"
        made, size = [], 0
        with system.open_output_stream(f"{top}/{name}") as out:
            for b in batches:
                for r in b.to_pylist():
                    raw = packed_directory(*(np.array(r[c], np.int64) for c in ("ids", "runs", "lengths")), np.array(r["offsets"], np.int64) + r["base"])
                    out.write(raw)
                    made.append((name, r["first"], size, len(raw)))
                    size += len(raw)
        columns = list(zip(*made)) if made else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["file", "first", "at", "bytes"])

    packed = entries.join(F.broadcast(bases.select("pid", "base")), "pid").repartitionByRange(max(1, min(parts, 64)), "first").sortWithinPartitions("first")
    made = packed.mapInArrow(leaves, "file string, first long, at long, bytes long").checkpoint()
    leaf_rows = made.orderBy("first").collect()  # one per leaf: about MOST_LEAVES + MOST_PARTS
    part_rows = bases.orderBy("pid").collect()
    held = np.array([(r["first"], 0, r["bytes"]) for r in leaf_rows], np.int64).reshape(-1, 3)
    offsets = np.concatenate([[0], np.cumsum(held[:, 2])])
    root = packed_directory(held[:, 0], held[:, 1], held[:, 2], offsets[:-1])
    if HEADER + len(root) > FIRST:
        raise ValueError("the root directory doesn't fit the first 16 KiB: raise leaf_entries")
    said = gzip.compress(json.dumps(metadata or {}).encode(), mtime=0)
    sizes = [len(root), len(said), int(offsets[-1]), sum(r["bytes"] for r in part_rows)]
    starts = np.cumsum([HEADER, *sizes]).tolist()
    counts = [sum(r[c] for r in part_rows) for c in ("tiles", "entries", "entries")]
    head = b"PMTiles\x03" + struct.pack("<11Q", *[v for pair in zip(starts, sizes) for v in pair], *counts)
    head += bytes([1, COMPRESSION["gzip"], COMPRESSION[compression], KINDS[kind], low or 0, high or 0]) + struct.pack("<4i", -1_800_000_000, -850_511_290, 1_800_000_000, 850_511_290) + bytes([low or 0]) + struct.pack("<2i", 0, 0)
    system, top = fs.FileSystem.from_uri(folder)
    system.create_dir(top, recursive=True)
    with system.open_output_stream(f"{top}/head") as out:
        out.write(head + root + said)
    files = [("head", len(head) + len(root) + len(said))]
    by_leaf_file: OrderedDict[str, int] = OrderedDict()
    for r in leaf_rows:
        by_leaf_file[r["file"]] = by_leaf_file.get(r["file"], 0) + r["bytes"]
    files += [*by_leaf_file.items(), *((r["file"], r["bytes"]) for r in part_rows)]
    manifest = {"parts": [{"file": f, "start": int(s), "bytes": int(n)} for (f, n), s in zip(files, np.cumsum([0, *[n for _, n in files]]))], "tiles": counts[0], "entries": counts[1]}
    with system.open_output_stream(f"{top}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    named = {"manifest.json", *(f for f, _ in files)}
    for info in system.get_file_info(fs.FileSelector(top)):  # what attempts that were run again have left
        if info.base_name not in named:
            system.delete_file(info.path)
    return manifest


class Archive:
    """One archive, a file or a folder of parts, read by ranges. Directories read are kept, the oldest let go first."""

    def __init__(self, uri: str, keep_entries: int = 1 << 20):
        self.system, top = fs.FileSystem.from_uri(uri)
        if self.system.get_file_info(top).type == fs.FileType.Directory:
            with self.system.open_input_stream(f"{top}/manifest.json") as f:
                self.parts = [(p["start"], p["bytes"], f"{top}/{p['file']}") for p in json.loads(f.read())["parts"] if p["bytes"]]
        else:
            self.parts = [(0, self.system.get_file_info(top).size, top)]
        self.keep, self.kept, self.leaves, self.reads = keep_entries, 0, OrderedDict(), 0
        self.opened: OrderedDict[str, pa.NativeFile] = OrderedDict()
        first = self.read(0, min(FIRST, sum(n for _, n, _ in self.parts)))
        if len(first) < HEADER or first[:8] != b"PMTiles\x03":
            raise ValueError("not a version 3 tile archive")
        v = struct.unpack_from("<11Q", first, 8)
        self.leaf_at, self.data_at, self.tiles = v[4], v[6], v[8]
        self.inner, self.outer, self.low, self.high = first[97], first[98], first[100], first[101]
        self.root = self._directory(first[v[0] : v[0] + v[1]] if v[0] + v[1] <= len(first) else self.read(v[0], v[1]))
        self.metadata = json.loads(self._unpack(self.read(v[2], v[3]), self.inner) or b"{}")

    def read(self, start: int, n: int) -> bytes:
        """n bytes of the archive, from whichever parts hold them. ValueError if it ends before."""
        out = []
        self.reads += 1
        k = int(np.searchsorted([p[0] for p in self.parts], start, "right")) - 1
        while n and 0 <= k < len(self.parts):
            at, size, path = self.parts[k]
            take = min(n, at + size - start)
            if take > 0:
                out.append(self._file(path).read_at(take, start - at))
                start, n = start + take, n - take
            k += 1
        if n:
            raise ValueError("cut short")
        return b"".join(out)

    def _file(self, path: str) -> pa.NativeFile:
        if path not in self.opened:
            if len(self.opened) >= 16:
                self.opened.popitem(last=False)[1].close()
            self.opened[path] = self.system.open_input_file(path)
        return self.opened[path]

    def _unpack(self, raw: bytes, how: int) -> bytes:
        return gzip.decompress(raw) if how == COMPRESSION["gzip"] else raw

    def _directory(self, raw: bytes) -> np.ndarray:
        return np.array(directory(self._unpack(raw, self.inner)), np.int64).reshape(-1, 4)

    def _leaf(self, offset: int, n: int) -> np.ndarray:
        if offset not in self.leaves:
            found = self._directory(self.read(self.leaf_at + offset, n))
            self.leaves[offset] = found
            self.kept += len(found)
            while self.kept > self.keep and len(self.leaves) > 1:
                self.kept -= len(self.leaves.popitem(last=False)[1])
        self.leaves.move_to_end(offset)
        return self.leaves[offset]

    def tile(self, z: int, x: int, y: int) -> bytes | None:
        """The unpacked tile, None if the archive has none there or there is no such place."""
        if not (0 <= z <= 26 and 0 <= x < 1 << z and 0 <= y < 1 << z):
            return None
        wanted, entries = hilbert_tile_id(z, x, y), self.root
        while len(entries):
            k = int(np.searchsorted(entries[:, 0], wanted, "right")) - 1
            if k < 0:
                return None
            first, run, offset, n = (int(v) for v in entries[k])
            if run:
                return self._unpack(self.read(self.data_at + offset, n), self.outer) if wanted < first + run else None
            entries = self._leaf(offset, n)
        return None

    def entries(self, offset: int | None, n: int = 0) -> np.ndarray:
        """Entries of the leaf at an offset, or of the root; leaves are followed to their own leaves."""
        found = self.root if offset is None else self._leaf(offset, n)
        below = found[found[:, 1] == 0]
        if offset is None or not len(below):
            return found[found[:, 1] > 0] if offset is None else found
        return np.concatenate([found[found[:, 1] > 0], *[self.entries(int(e[2]), int(e[3])) for e in below]])


TILES = "z int, x long, y long, tile binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["z", "x", "y", "tile"])


def read_archive(spark: SparkSession, uri: str, rows: int = 256) -> DataFrame:
    """z, x, y, tile of all tiles, a task working through some of the leaf directories. Only the root is read here."""
    archive = Archive(uri)
    leaves = [(int(e[2]), int(e[3])) for e in archive.root if e[1] == 0]
    plan = [(None, 0), *leaves] if len(archive.entries(None)) else leaves
    asked = spark.createDataFrame(plan, "at long, bytes long").repartition(max(1, min(len(plan), 4 * spark.sparkContext.defaultParallelism)))

    def run(batches):
        own, held = Archive(uri), []
        for b in batches:
            for at, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for first, run, offset, size in own.entries(at, n).tolist():
                    body = own._unpack(own.read(own.data_at + offset, size), own.outer)
                    for k in range(run):
                        held.append((*tile_of_hilbert_id(first + k), body))
                        if len(held) == rows:
                            yield _batch(held)
                            held = []
        yield _batch(held)

    return asked.mapInArrow(run, TILES)


def look_up(asked: DataFrame, uri: str) -> DataFrame:
    """z, x, y, tile (null if there is none) for each different z, x, y of asked. Requests are dealt out along the
    curve, so a task reads few directories, each once."""
    places = asked.selectExpr("CAST(z AS LONG) AS z", "CAST(x AS LONG) AS x", "CAST(y AS LONG) AS y").dropna().distinct()
    inside = F.expr("z BETWEEN 0 AND 26 AND x >= 0 AND y >= 0 AND x < shiftleft(1L, CAST(least(z, 26) AS INT)) AND y < shiftleft(1L, CAST(least(z, 26) AS INT))")

    def placed(batches):
        for b in batches:
            z, x, y, ok = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.where(ok, hilbert_tile_ids(*(np.where(ok, v, 0) for v in (z, x, y))), -1))], names=["z", "x", "y", "at"])

    def run(batches):
        own = Archive(uri)
        for b in batches:
            yield _batch([(z, x, y, own.tile(z, x, y)) for z, x, y in zip(*(b.column(k).to_pylist() for k in range(3)))])

    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = places.withColumn("ok", inside).mapInArrow(placed, "z long, x long, y long, at long").repartitionByRange(n, "at").sortWithinPartitions("at")
    return ordered.mapInArrow(run, TILES)


def joined(uri: str, target: str, block: int = 8 << 20) -> None:
    """The parts of a folder copied into one file, a block at a time: for archives that one machine can copy."""
    archive = Archive(uri)
    system, path = fs.FileSystem.from_uri(target)
    with system.open_output_stream(path) as out:
        for at, size, _ in archive.parts:
            for k in range(at, at + size, block):
                out.write(archive.read(k, min(block, at + size - k)))

"""Zip archives of recordings: a row per member, faults as rows, bounded in members and bytes."""

from __future__ import annotations

import csv
import gzip
import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources.ranged import can_seek, opened

DIRECTORY = "archive string, member string, kind string, size long, packed long, error string"
LISTING = "archive string, root string, filename string, type string, name string, complete boolean"
MAX_TOTAL, MAX_NESTED, BYTES_A_MEMBER = 2 << 30, 256 << 20, 100 << 10
SCHEMA = "archive string, member string, kind string, content binary, error string"
MAX_MEMBERS, MAX_BYTES = 50_000, 64 << 20
#: Packed bytes of an archive that a task unpacks about.
TASK_BYTES = 32 << 20


def member_kind(name: str) -> str:
    """activity, route, archive, junk, unsafe (leaves the archive) or other, by the member's name."""
    parts = [p for p in name.replace("\\", "/").split("/") if p]
    if name.startswith("/") or ".." in parts:
        return "unsafe"
    if not parts or "__MACOSX" in parts or parts[-1].startswith("."):
        return "junk"
    base = parts[-1].lower().removesuffix(".gz")
    if base.endswith(".zip"):
        return "archive"
    if not base.endswith((".gpx", ".fit")):
        return "other"
    return "route" if "routes" in [p.lower() for p in parts[:-1]] else "activity"


def members(archive: str, content: bytes, nested: bool = True):
    """(archive, member, kind, content, error) of each file; nothing but activities and routes is unpacked.

    Archives inside the archive are opened one level deep, their members named outer.zip/inner; deeper ones are rows
    without content."""
    try:
        packed = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        yield archive, None, None, None, f"not an archive: {e}"
        return
    found = [i for i in packed.infolist() if not i.is_dir()]
    if len(found) > MAX_MEMBERS:
        yield archive, None, None, None, "too many members"
        return
    for info in found:
        yield from _member(packed, info, archive, nested)


def _member(packed: zipfile.ZipFile, info: zipfile.ZipInfo, archive: str, nested: bool):
    """The rows of one member."""
    kind = member_kind(info.filename)
    if kind not in ("activity", "route") and not (kind == "archive" and nested):
        yield archive, info.filename, kind, None, None
        return
    try:
        with packed.open(info) as f:
            data = f.read(MAX_BYTES + 1)
        if info.filename.lower().endswith(".gz") and len(data) <= MAX_BYTES:
            with gzip.open(io.BytesIO(data)) as f:
                data = f.read(MAX_BYTES + 1)
        if len(data) > MAX_BYTES:
            raise ValueError("too large")
        if kind == "archive":
            for _, name, *rest in members(archive, data, nested=False):
                yield archive, info.filename if name is None else f"{info.filename}/{name}", *rest
            return
        yield archive, info.filename, kind, data, None
    except (OSError, EOFError, ValueError, RuntimeError, zipfile.BadZipFile) as e:
        yield archive, info.filename, kind, None, str(e)


def _batches(rows, names: list[str], most_rows: int = 64, most_bytes: int = 16 << 20):
    """Rows in frames of bounded rows and bytes of content."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += sum(len(v) for v in row if isinstance(v, bytes))
        if len(part) == most_rows or held >= most_bytes:
            yield pd.DataFrame(part, columns=names)
            part, held = [], 0
    if part:
        yield pd.DataFrame(part, columns=names)


def _chunks(archive: str, task_bytes: int):
    """(archive, first entry, entry after the last, packed bytes, error) of stretches of an archive's directory of some
    task_bytes; the directory alone is read."""
    try:
        with opened(archive) as f:
            found = zipfile.ZipFile(f).infolist()
    except (zipfile.BadZipFile, OSError) as e:
        yield archive, 0, 0, 0, f"not an archive: {e}"
        return
    if sum(not i.is_dir() for i in found) > MAX_MEMBERS:
        yield archive, 0, 0, 0, "too many members"
        return
    first, held = 0, 0
    for k, i in enumerate(found):
        held += i.compress_size
        if held >= task_bytes or k == len(found) - 1:
            yield archive, first, k + 1, held, None
            first, held = k + 1, 0


def read_archives(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The members of all .zip files under path.

    Tasks are planned from the archives' directories, which are read by seeking, as are the members: an archive of any
    size is dealt out over many tasks, each of which holds one member at a time. Where Arrow can't open the file system,
    an archive is one task's and held whole."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    if not can_seek(path):
        return files.select("path", "content").mapInPandas(lambda bs: (f for b in bs for a, c in zip(b["path"], b["content"], strict=True) for f in _batches(members(a, bytes(c)), names)), SCHEMA)
    plan = ["archive", "first", "after", "packed", "error"]

    def planned_chunks(batches):
        for b in batches:
            yield from _batches((c for archive in b["path"] for c in _chunks(archive, task_bytes)), plan, 10_000)

    def run(batches):
        for b in batches:
            for archive, first, after, _, error in b.itertuples(index=False):
                if error is not None:
                    yield pd.DataFrame([(archive, None, None, None, error)], columns=names)
                    continue
                with opened(archive) as f:
                    packed = zipfile.ZipFile(f)
                    yield from _batches((row for i in packed.infolist()[first:after] if not i.is_dir() for row in _member(packed, i, archive, True)), names)

    chunks = files.select("path").mapInPandas(planned_chunks, "archive string, first long, after long, packed long, error string")
    dealt = chunks.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    return dealt.mapInPandas(run, SCHEMA)


def member_key(c: Column) -> Column:
    """What a listing's file name and a member's path have in common: lower case, / only, nothing before it, no .gz."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"\\", "/"))), r"^/*(\./)?", ""), r"\.gz$", "")


def listed(found: DataFrame, listing: DataFrame, file_col: str = "filename", sport_col: str = "sport") -> DataFrame:
    """Members with the listing's sport, and whether they are listed at all: a listed member may have no sport."""
    rows = listing.select(member_key(F.col(file_col)).alias("_key"), F.col(sport_col).alias("csv_sport"), F.lit(True).alias("_listed")).dropDuplicates(["_key"])
    return found.withColumn("_key", member_key(F.col("member"))).join(rows, "_key", "left").withColumn("csv_listed", F.coalesce("_listed", F.lit(False))).drop("_key", "_listed")


def _archives(spark: SparkSession, path: str, rows, schema: str) -> DataFrame:
    """What rows(archive, content) yields of each .zip file under path; a file is held whole while it is read."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            for archive, content in zip(b["path"], b["content"], strict=True):
                part = []
                for row in rows(archive, bytes(content)):
                    part.append(row)
                    if len(part) == 10_000:
                        yield pd.DataFrame(part, columns=names)
                        part = []
                if part:
                    yield pd.DataFrame(part, columns=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, schema)


def directory_of(archive: str, content):
    """The entries of an archive's directory, from its bytes or an open file; nothing is unpacked."""
    try:
        packed = zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content)
    except zipfile.BadZipFile as e:
        yield archive, None, None, None, None, f"not an archive: {e}"
        return
    for i in packed.infolist():
        if not i.is_dir():
            yield archive, i.filename, member_kind(i.filename), i.file_size, i.compress_size, None


def listing_of(archive: str, content: bytes):
    """The rows of the listing that lies least deep in an archive, then one without a file name that says whether all of
    it was read; its folder is the archive's root. No rows: there is no listing."""
    from waymark.sources.listings import ACCENTS, HEADERS, MAX_FIELD

    try:
        packed = zipfile.ZipFile(io.BytesIO(content))
        found = [i for i in packed.infolist() if i.filename.replace("\\", "/").rsplit("/", 1)[-1].lower() == "activities.csv" and i.file_size <= MAX_BYTES and member_kind(i.filename) != "junk"]
        if not found:
            return
        own = min(found, key=lambda i: (i.filename.count("/"), i.filename))
    except zipfile.BadZipFile:
        return
    root = own.filename[: own.filename.rfind("/") + 1]
    csv.field_size_limit(MAX_FIELD)
    plain = lambda c: "".join(x for x in c.lstrip("\ufeff").lower().translate(str.maketrans(*ACCENTS)) if x.isascii() and x.isalnum())
    complete = False
    try:
        with packed.open(own) as f:
            reader = csv.reader(io.TextIOWrapper(f, "utf-8-sig", "replace", newline=""))
            header = [plain(c) for c in next(reader, [])]
            at = {k: next((header.index(a) for a in names if a in header), None) for k, names in HEADERS.items()}
            if at["filename"] is not None and at["type"] is not None:
                for row in reader:
                    said = lambda k, row=row: row[at[k]].strip() if at[k] is not None and at[k] < len(row) else ""
                    if said("filename"):
                        yield archive, root, said("filename"), said("type"), said("name"), None
                complete = True
    except (csv.Error, OSError, EOFError, RuntimeError, zipfile.BadZipFile):
        pass
    yield archive, root, None, None, None, complete


def read_directories(spark: SparkSession, path: str) -> DataFrame:
    """The directories of all .zip files under path, read by seeking where that can be done."""
    if not can_seek(path):
        return _archives(spark, path, directory_of, DIRECTORY)
    names = [c.split(" ")[0] for c in DIRECTORY.split(", ")]

    def entries(archive: str):
        with opened(archive) as f:
            yield from directory_of(archive, f)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path")
    return files.mapInPandas(lambda bs: (f for b in bs for a in b["path"] for f in _batches(entries(a), names, 10_000)), DIRECTORY)


def read_archive_listings(spark: SparkSession, path: str) -> DataFrame:
    """The listings within all .zip files under path."""
    return _archives(spark, path, listing_of, LISTING)


def planned(directory: DataFrame, listing: DataFrame) -> DataFrame:
    """What is to be done with each member: archive, member, size, packed, lookup (its path below the root, as
    listings have it), listed and plan: activity, route (planned, of an archive with a listing), unlisted (in activities/
    but not in a listing that was read whole), archive (opened one level deep), or none. error: the archive is refused,
    for a path that leaves it, too many members or too many bytes."""
    wanted = F.col("kind").isin("activity", "route")
    faults = directory.groupBy("archive").agg(F.max(F.when(F.col("kind") == "unsafe", F.lit("a path that leaves the archive"))).alias("unsafe"), F.sum(F.when(wanted, 1).otherwise(0)).alias("n"), F.sum(F.when(wanted, F.col("size"))).alias("bytes"), F.max("error").alias("broken"))
    faults = faults.select("archive", F.coalesce("broken", "unsafe", F.when(F.col("n") > MAX_MEMBERS, F.lit("too many members")), F.when(F.col("bytes") > MAX_TOTAL, F.lit("too large"))).alias("refused"))
    roots = listing.groupBy("archive").agg(F.max("root").alias("root"), F.max("complete").alias("complete"), F.count("filename").alias("rows"))
    known = listing.filter("filename IS NOT NULL").select("archive", member_key(F.col("filename")).alias("lookup"), F.lit(True).alias("is_listed")).distinct()
    below = F.when(F.startswith(F.lower("member"), F.lower("root")), F.substring("member", F.length("root") + 1, F.length("member"))).otherwise(F.col("member"))
    d = directory.filter("member IS NOT NULL").join(faults, "archive", "left").join(roots, "archive", "left").withColumn("lookup", member_key(F.coalesce(below, F.col("member")))).join(known, ["archive", "lookup"], "left")
    route = F.col("root").isNotNull() & F.startswith("lookup", F.lit("routes/"))
    dropped = F.col("complete") & (F.col("rows") > 0) & F.startswith("lookup", F.lit("activities/")) & F.col("is_listed").isNull()
    plan = F.when(F.col("refused").isNotNull() | F.col("kind").isin("junk", "other", "unsafe"), "none").when(F.col("kind") == "archive", "archive").when(route, "route").when(F.coalesce(dropped, F.lit(False)), "unlisted").otherwise("activity")
    return d.select("archive", "member", "size", "packed", "lookup", F.coalesce("is_listed", F.lit(False)).alias("listed"), plan.alias("plan"), F.col("refused").alias("error"))


def estimated_members(plans: DataFrame) -> DataFrame:
    """archive and members: activities, and for each archive within as many as its packed bytes make, one at least."""
    inner = F.when((F.col("plan") == "archive") & (F.col("size") <= MAX_NESTED), F.greatest(F.lit(1), F.floor(F.col("packed") / BYTES_A_MEMBER)))
    return plans.groupBy("archive").agg(F.sum(F.when(F.col("plan") == "activity", 1).otherwise(F.coalesce(inner, F.lit(0)))).cast("long").alias("members"))

"""GPX files: read through Spark's binary source, parsed a file at a time, bad files reported as rows."""

from __future__ import annotations

import hashlib
import math
import re
import xml.etree.ElementTree as ET

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.geo import metres
from waymark.operators.shapes import elevation_gain
from waymark.plans.kinds import classified

SCHEMA = "path string, file_hash string, name string, kind string, seq int, lon double, lat double, ele double, ts string, error string"
MAX_POINTS, MAX_TAGS = 100_000, 2_000_000
_LOCAL = re.compile(r"^\{[^}]*\}")


def _tag(e: ET.Element) -> str:
    return _LOCAL.sub("", e.tag)


def _number(s: str | None) -> float | None:
    try:
        x = float(s)
    except (TypeError, ValueError):
        return None
    return x if math.isfinite(x) else None


def parse_gpx(content: bytes) -> tuple[str | None, str | None, list[tuple]]:
    """Name, type and points (lon, lat, ele, time) of the tracks of a GPX file, or of its routes if no track has a
    point; points out of range are dropped.

    ValueError: a document type or entity, too many points or tags, or no well-formed XML."""
    if re.search(rb"<!(DOCTYPE|ENTITY)", content, re.I):
        raise ValueError("document types are refused")
    if content.count(b"<trkpt") > MAX_POINTS or content.count(b"<") > MAX_TAGS:
        raise ValueError("too large")
    try:
        root = ET.fromstring(content)
    except ET.ParseError as e:
        raise ValueError(f"malformed: {e}") from None
    name = kind = None
    points: list[tuple] = []
    for line, point in (("trk", "trkpt"), ("rte", "rtept")):
        for track in [e for e in root.iter() if _tag(e) == line]:
            for child in track:
                if _tag(child) == "name" and name is None:
                    name = child.text
                elif _tag(child) == "type" and kind is None:
                    kind = child.text
            for p in (e for e in track.iter() if _tag(e) == point):
                said = {_tag(c): c.text for c in p}
                lon, lat, ele = _number(p.get("lon")), _number(p.get("lat")), _number(said.get("ele"))
                if lon is None or lat is None or abs(lat) > 90 or abs(lon) > 180 or (ele is not None and not -500 <= ele <= 9000):
                    continue
                points.append((lon, lat, ele, said.get("time")))
        if points:
            break
    return name, kind, points


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """A row per point of the files under path; a file that can't be read is one row with error."""

    def run(batches):
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"], strict=True):
                digest = hashlib.sha256(content).hexdigest()
                try:
                    name, kind, points = parse_gpx(bytes(content))
                except ValueError as e:
                    rows.append((p, digest, None, None, None, None, None, None, None, str(e)))
                    continue
                rows += [(p, digest, name, kind, i, *q, None) for i, q in enumerate(points)]
            out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])
            yield out.astype({"seq": "Int32", "lon": float, "lat": float, "ele": float})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gpx").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def recordings(points: DataFrame) -> DataFrame:
    """path, file_hash, name, sport, skip, generic, distance_m (with heights where every point has one), climb_m, started and n
    of each file, of read_gpx's rows; a file that can't be read keeps its error."""
    held = points.groupBy("path", "file_hash").agg(F.max("name").alias("name"), F.max("kind").alias("kind"), F.max("error").alias("error"), F.min(F.try_to_timestamp("ts")).alias("started"), F.sort_array(F.collect_list(F.when(F.col("seq").isNotNull(), F.struct("seq", "lon", "lat", "ele")))).alias("f"))

    @F.pandas_udf("distance_m double, climb_m double, n int")
    def measured(f: pd.Series) -> pd.DataFrame:
        rows = []
        for points in f:
            lon, lat = (np.array([p[k] for p in points], float) for k in ("lon", "lat"))
            ele = np.array([np.nan if p["ele"] is None else p["ele"] for p in points], float)
            legs = metres(lon[:-1], lat[:-1], lon[1:], lat[1:])
            if len(ele) and not np.isnan(ele).any():
                legs = np.hypot(legs, np.diff(ele))
            rows.append((float(legs.sum()), elevation_gain(ele), len(lon)))
        return pd.DataFrame(rows, columns=["distance_m", "climb_m", "n"])

    return classified(held.withColumn("m", measured("f")), "kind").select("path", "file_hash", "name", "sport", "skip", "generic", "m.distance_m", "m.climb_m", "started", "m.n", "error")


def curated(points: DataFrame, kinds: dict[str, str], longest_km: float = 2000.0) -> DataFrame:
    """path, name, sport and km of curated files, of read_gpx's rows. The sport is that of the longest prefix of the
    file's name among kinds (null: none); broken files and those longer than longest_km are left out."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    sport = F.coalesce(*[F.when(F.startswith(stem, F.lit(p)), F.lit(s)) for p, s in sorted(kinds.items(), key=lambda k: -len(k[0]))], F.lit(None).cast("string"))
    before = Window.partitionBy("path").orderBy("seq")
    leg = F.expr("CASE WHEN lat0 IS NOT NULL THEN 2 * 6371 * asin(least(1D, sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2)))) END")
    legs = points.filter("error IS NULL").withColumn("lat0", F.lag("lat").over(before)).withColumn("lon0", F.lag("lon").over(before)).withColumn("leg", leg)
    lines = legs.groupBy("path").agg(F.max("name").alias("title"), F.coalesce(F.sum("leg"), F.lit(0.0)).alias("km")).filter(F.col("km") <= longest_km)
    return lines.select("path", F.coalesce(F.nullif(F.trim("title"), F.lit("")), stem).alias("name"), sport.alias("sport"), "km")

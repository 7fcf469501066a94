"""Heights from terrain rasters: square grids of signed 16-bit numbers, one file a degree, named like N43E003.hgt.

A raster becomes one row a line of it, so a lookup is an equality join on tile and line, and the sample is cut out of
the line's bytes by an expression; no task ever needs a set of whole rasters.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDES = (1201, 3601)  # fixed values: samples a side of the two resolutions
VOID = -32768


def read_terrain(spark: SparkSession, path: str) -> DataFrame:
    """tile, side, line, samples of the .hgt files under path; files of another size are left out."""

    def run(batches):
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                side = math.isqrt(len(content) // 2)
                if side not in SIDES or len(content) != side * side * 2:
                    continue
                name = p.rsplit("/", 1)[-1].rsplit(".", 1)[0].upper()
                yield pd.DataFrame({"tile": name, "side": side, "line": range(side), "samples": [content[i : i + 2 * side] for i in range(0, len(content), 2 * side)]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, "tile string, side int, line int, samples binary")


def with_height(points: DataFrame, terrain: DataFrame) -> DataFrame:
    """points (lon, lat) with height, in metres: the sample north-west of the point; null where there is none.

    Raster sizes of a tile must agree, or a point has a row for each. Columns of points named tile, side, line or
    samples are not allowed."""
    sides = terrain.groupBy("tile").agg(F.collect_set("side").alias("sides"))
    part = lambda c, pos, neg, n: F.format_string(f"%s%0{n}d", F.when(F.floor(c) >= 0, pos).otherwise(neg), F.abs(F.floor(c)))
    named = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.concat(part("lat", "N", "S", 2), part("lon", "E", "W", 3)))
    placed = points.withColumn("tile", named).join(sides, "tile", "left").withColumn("side", F.explode_outer("sides")).drop("sides")
    at = lambda share: F.greatest(F.lit(0), F.least(F.col("side") - 1, F.floor(share * (F.col("side") - 1)))).cast("int")
    placed = placed.withColumn("line", at(1 - (F.col("lat") - F.floor("lat")))).withColumn("column", at(F.col("lon") - F.floor("lon")))
    found = placed.join(terrain, ["tile", "side", "line"], "left")
    raw = F.conv(F.hex(F.substring("samples", F.col("column") * 2 + 1, F.lit(2))), 16, 10).cast("int")
    signed = F.when(raw >= 32768, raw - 65536).otherwise(raw)
    return found.withColumn("height", F.when(signed != VOID, signed.cast("double"))).select(*points.columns, "height")

"""A change feed: updates that say what they changed, kept as versions from which the table can be had again.

A feed row has the key, the kind of change and the row before and after it. Versions are Parquet folders beside one
another; a table at a version is the base and, for each key, the last change up to it, found by map-side combining.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def update(table: DataFrame, key: str, where: Column, values: dict[str, Column], expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """table with `values` set where the condition holds, and the feed of the rows that this changed.

    With expected (key and some columns as they were when the update was planned), a row is left alone unless it is
    still the same in them. Rows on which the values change nothing are no change."""
    rows = table.withColumn("_before", F.struct(*table.columns))
    if expected is not None:
        seen = [c for c in expected.columns if c != key]
        rows = rows.join(expected.select(F.col(key).alias("_key"), F.struct(*seen).alias("_seen")), F.col(key) == F.col("_key"), "left")
        where = where & F.col("_seen").isNotNull() & F.col("_seen").eqNullSafe(F.struct(*[F.col(c) for c in seen]))
    set_now = {c: F.when(where, v).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, v in values.items()}
    moved = rows.withColumn("_after", F.struct(*[set_now.get(c, F.col(c)).alias(c) for c in table.columns]))
    new = moved.select("_after.*")
    feed = moved.filter(~F.col("_before").eqNullSafe(F.col("_after"))).select(F.col(key).alias("key"), F.lit("update").alias("kind"), F.col("_before").alias("before"), F.col("_after").alias("after"))
    return new, feed


def difference(before: DataFrame, after: DataFrame, key: str, watched: list[str] | None = None) -> DataFrame:
    """The feed that leads from one state of a table to the next: inserts, deletes, and updates of watched columns (all,
    if none are given). Keys are unique and not null."""
    names = before.columns
    watched = watched or names
    a = before.select(F.col(key).alias("key"), F.struct(*names).alias("before"))
    b = after.select(F.col(key).alias("key"), F.struct(*names).alias("after"))
    both = a.join(b, "key", "full")
    kind = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    same = F.struct(*[F.col(f"before.{c}") for c in watched]).eqNullSafe(F.struct(*[F.col(f"after.{c}") for c in watched]))
    return both.filter(F.col("before").isNull() | F.col("after").isNull() | ~same).select("key", kind.alias("kind"), "before", "after")


def append(feed: DataFrame, path: str, version: int) -> None:
    """Keeps the feed as a version; one that is there already is replaced as a whole, so a retry changes nothing."""
    feed.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version:019d}")


def feeds(spark: SparkSession, path: str, since: int = 0, upto: int | None = None) -> DataFrame:
    """The changes of versions after `since` up to `upto`, with their version; other versions' files aren't read."""
    rows = spark.read.parquet(path).withColumn("version", F.col("version").cast("long")).filter(F.col("version") > since)
    return rows if upto is None else rows.filter(F.col("version") <= upto)


def replayed(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base after the changes (a feed with version), in any order of rows."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("kind", "after"), "version").alias("last"))
    kept = base.join(last, F.col(key) == F.col("key"), "left_anti").select(base.columns)
    return kept.unionByName(last.filter("last.kind <> 'delete'").select("last.after.*").select(base.columns))

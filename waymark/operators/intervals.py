"""Joins on nearness in time without a nested loop: the tolerance becomes buckets, and buckets an equality."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import ensure_checkpoint_dir


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def bucketed_interval_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, seconds: float, on: list[str] | None = None) -> DataFrame:
    """All pairs at most seconds apart (and equal in on). Columns of right must not clash with left's but for on.

    Rows of left are probed in their own bucket and both neighbours; null times match nothing. A hot bucket is split
    by Spark's skew join, as both sides are dealt by an equality."""
    width = int(seconds * 1_000_000)
    l = left.withColumn("_bucket", F.explode(F.array(*[F.floor(_micros(F.col(left_ts)) / width) + k for k in (-1, 0, 1)])))
    r = right.withColumn("_bucket", F.floor(_micros(F.col(right_ts)) / width))
    near = F.abs(_micros(F.col(left_ts)) - _micros(F.col(right_ts))) <= width
    return l.join(r, [*(on or []), "_bucket"]).filter(near).drop("_bucket")


def nearest_in_time(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_ts: str, right_ts: str, seconds: float, on: list[str] | None = None) -> DataFrame:
    """left_id and the one right_id nearest to it within seconds; two different ones equally near are no match, rows of
    one id are one. Null times and keys match nothing.

    No pairs are made. Rows of both sides become classes, one for each key and time, with the least and greatest
    right_id: a second that holds a third of all rows is one class, made by map-side combining. A range exchange along
    key and time deals the classes out evenly, windows within a partition give each the class before and after it, and
    what a partition lacks at its ends is carried to it from its neighbours, a row a partition. Only the classes that
    have a match meet left's rows again, by an equality that Spark splits where it is skewed."""
    width = int(seconds * 1_000_000)
    spark = left.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [f"_k{i}" for i in range(len(on or []))]
    named = lambda df, ts: [*[F.col(c).alias(k) for c, k in zip(on or [], keys)], _micros(F.col(ts)).alias("_t")]
    sides = right.select(*named(right, right_ts), F.col(right_id).alias("_v"), F.lit(False).alias("_asks")).dropna()
    asking = left.select(*named(left, left_ts), F.lit(None).cast(dict(right.dtypes)[right_id]).alias("_v"), F.lit(True).alias("_asks")).dropna(subset=[*keys, "_t"])
    classes = sides.unionByName(asking).groupBy(*keys, "_t").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.bool_or("_asks").alias("_asks"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = F.when(F.col("_lo").isNotNull(), F.struct(*keys, "_t", "_lo", "_hi"))
    dealt = classes.repartitionByRange(n, *keys, "_t").select("*", F.spark_partition_id().alias("_pid"), own.alias("_own")).checkpoint()
    ends = dealt.groupBy("_pid").agg(F.min("_own").alias("_first"), F.max("_own").alias("_last"))
    over = lambda c, *by: F.last(c, ignorenulls=True).over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("_pid", over("_last", "_pid").alias("_earlier"), over("_first", F.desc("_pid")).alias("_later"))  # a row a partition
    inside = Window.partitionBy("_pid", *keys)
    around = dealt.withColumn("_before", F.last("_own", ignorenulls=True).over(inside.orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)))
    around = around.withColumn("_after", F.last("_own", ignorenulls=True).over(inside.orderBy(F.desc("_t")).rowsBetween(Window.unboundedPreceding, -1)))
    met = around.filter("_asks").join(F.broadcast(carried), "_pid")
    same = lambda c: F.when(F.lit(True) if not keys else functools.reduce(lambda a, b: a & b, [F.col(f"{c}.{k}") == F.col(k) for k in keys]), F.col(c))
    met = met.withColumn("_before", F.coalesce("_before", same("_earlier"))).withColumn("_after", F.coalesce("_after", same("_later")))
    gaps = met.withColumn("_b", F.col("_t") - F.col("_before._t")).withColumn("_a", F.col("_after._t") - F.col("_t")).withColumn("_gap", F.least("_b", "_a"))
    side = lambda f, c: f(F.when(F.col("_b") == F.col("_gap"), F.col(f"_before.{c}")), F.when(F.col("_a") == F.col("_gap"), F.col(f"_after.{c}")))
    found = gaps.filter(F.col("_gap") <= width).select(*keys, "_t", side(F.least, "_lo").alias("_lo"), side(F.greatest, "_hi").alias("_hi")).filter("_lo = _hi")
    asked = left.select(F.col(left_id), *named(left, left_ts))
    return asked.join(found, [*keys, "_t"]).select(left_id, F.col("_lo").alias(right_id))

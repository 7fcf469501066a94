"""Contiguous shards of equal bytes from global prefix sums; DataFrame operations only.

Documents are put in an order: that of the given columns, or a hash of the text and the id, so that equal texts stand
side by side. A range exchange deals that order out; each partition's bytes and rows are added up to one total per
partition, the totals are summed along the partitions, and within a partition a window goes on from its total. No
window holds more than one partition, or one row per partition. The last key of the order is the row's place in the
input, so a group of rows alike, however large, is spread over as many partitions as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

PARTITION_ROWS = 250_000


def shard_by_bytes(docs: DataFrame, id_col="doc_id", text_col="text", shards: int = 24, overhead: int = 8, order: list[Column] | None = None) -> DataFrame:
    """One row per row of docs: id, size (UTF-8 bytes of the text, 0 for null, plus overhead), text_crc32, law
    ('bytes'), shard, slot (0, 1, ... within the shard, without gaps) and grown_shard (null under this law).

    A document is in the shard in whose share of the bytes it begins, so shards differ by one document at most; slots
    follow the order. Rows alike in the order's columns get slots of their own; null ids come first; other columns are
    ignored; an empty table gives an empty result."""
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PARTITION_ROWS))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = dict(enumerate(order if order is not None else [F.xxhash64(text), F.col(id_col)]))
    by = [*[f"k{i}" for i in keys], "place"]
    narrow = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), *[c.alias(f"k{i}") for i, c in keys.items()], F.monotonically_increasing_id().alias("place"))
    dealt = checkpointed(narrow.repartitionByRange(n, *by).withColumn("pid", F.spark_partition_id()))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = dealt.groupBy("pid").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("r"))
    bases = totals.select("pid", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("rows_before"), F.sum("b").over(every).alias("all_bytes"))
    inside = Window.partitionBy("pid").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("bytes_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("rows_inside", F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0)))
    placed = summed.join(F.broadcast(bases), "pid")  # one row per partition of the exchange
    placed = placed.withColumn("row", F.col("rows_before") + F.col("rows_inside")).withColumn("shard", F.expr(f"cast(least({shards} - 1, (bytes_before + bytes_inside) * {shards} div all_bytes) as int)"))
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(first), "shard").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))  # one row per shard

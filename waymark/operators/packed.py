"""Traces as one row each, so that a task works through many traces in an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(fixes: DataFrame, *columns: str) -> DataFrame:
    """activity_id and an array of each column in the order of seq. A trace is bounded (parsers refuse more than
    100 000 fixes), so its row is.

    Traces are dealt out over a stated number of partitions: what follows takes milliseconds a trace and multiplies its
    bytes, so partitions must not be merged for being small."""
    spark = fixes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    rows = fixes.repartition(parts, "activity_id").groupBy("activity_id").agg(F.sort_array(F.collect_list(F.struct("seq", *columns))).alias("f"))
    return rows.select("activity_id", *[F.col(f"f.{c}").alias(c) for c in columns])


def traces(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The id and the arrays of each trace of a batch of packed()."""
    ids = batch.column(0).to_pylist()
    lists = [batch.column(k) for k in range(1, batch.num_columns)]
    values = [c.flatten().to_numpy(zero_copy_only=False) for c in lists]
    ends = np.cumsum([0, *lists[0].value_lengths().to_pylist()])
    for i, key in enumerate(ids):
        yield key, *[v[ends[i] : ends[i + 1]] for v in values]

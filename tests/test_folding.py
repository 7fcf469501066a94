"""Folding keeps few texts in Python at a time, however long a batch is."""

import pyarrow as pa
from pyspark.sql import functions as F

from waymark.functions import text


def test_a_batch_is_worked_off_in_parts():
    before = ["Śłōw Ride", None, "", "ﬁ", "x" * 10_000] * 50
    got = text._folded.func(pa.array(before, pa.string()))
    assert isinstance(got, pa.Array) and got.to_pylist() == [text.fold(t) for t in before]
    assert len(text._folded.func(pa.array([], pa.string()))) == 0


def test_as_a_column(spark):
    df = spark.range(200).select(F.when(F.col("id") % 7 != 0, F.concat(F.lit("Á-"), F.col("id").cast("string"))).alias("t"))
    assert all(r["f"] == text.fold(r["t"]) for r in df.select("t", text.folded("t").alias("f")).collect())

"""Nearest in time without pairs, against a walk: ties, dense seconds, carried edges, keys, nulls."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators.intervals import nearest_in_time


def walk(left, right, seconds, keyed):
    out = []
    for i, k, t in left:
        near = [(abs(t - u), v) for v, q, u in right if t is not None and u is not None and abs(t - u) <= seconds and (not keyed or (k is not None and k == q))]
        best = {v for g, v in near if g == min(g for g, _ in near)}
        if len(best) == 1:
            out.append((i, *best))
    return sorted(out)


def frames(spark, left, right):
    at = F.expr("timestamp_seconds(s)")
    return spark.createDataFrame(left, "lid long, k string, s long").withColumn("lt", at), spark.createDataFrame(right, "rid long, k string, s long").withColumn("rt", at).drop("s")


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("span", [300, 5000])
def test_equals_a_walk(spark, keyed, span):
    r = random.Random(span + keyed)
    key = lambda: r.choice(["a", "b", "b", "b", None])
    left = [(i, key(), r.choice([r.randrange(span), None, 77])) for i in range(150)]
    right = [(r.randrange(90), key(), r.choice([r.randrange(span), None, 77, 90])) for _ in range(120)]
    l, m = frames(spark, left, right)
    got = nearest_in_time(l, m, "lid", "rid", "lt", "rt", 20, on=["k"] if keyed else None)
    assert sorted(map(tuple, got.collect())) == walk(left, right, 20, keyed)


def test_dense_second_makes_no_pairs(spark):
    """40 000 rows of one key and second on each side: their pairs would be 1.6 billion."""
    l = spark.range(40_000).selectExpr("id AS lid", "'u' AS k", "timestamp_seconds(id % 2) AS lt")
    one = spark.range(40_000).selectExpr("7L AS rid", "'u' AS k", "timestamp_seconds(0) AS rt")
    two = spark.range(40_000).selectExpr("id AS rid", "'u' AS k", "timestamp_seconds(0) AS rt")
    assert nearest_in_time(l, one, "lid", "rid", "lt", "rt", 60, on=["k"]).groupBy("rid").count().collect() == [(7, 40_000)]
    assert nearest_in_time(l, two, "lid", "rid", "lt", "rt", 60, on=["k"]).count() == 0


def test_edges_are_carried_over_partitions(spark):
    """One match far along: partitions between have none of their own."""
    l = spark.range(4000).selectExpr("id AS lid", "timestamp_seconds(id) AS lt")
    m = spark.sql("SELECT 1L AS rid, timestamp_seconds(10) AS rt UNION ALL SELECT 2L, timestamp_seconds(3990)")
    got = dict(nearest_in_time(l, m, "lid", "rid", "lt", "rt", 10_000).collect())
    assert got == {k: 1 if k < 2000 else 2 for k in range(4000) if k != 2000}


def test_empty_sides(spark):
    l, m = frames(spark, [], [])
    assert nearest_in_time(l, m, "lid", "rid", "lt", "rt", 60, on=["k"]).collect() == []
    l, m = frames(spark, [(1, "a", 5)], [])
    assert nearest_in_time(l, m, "lid", "rid", "lt", "rt", 60).collect() == []

"""Greedy one-to-one resolution of pairs in a fixed order, without walking through them one by one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.session import ensure_checkpoint_dir


def resolve_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs that a walk in order would take, of pairs (absorbed, survivor, rank, keep_absorbed).

    A survivor is taken once. An absorbed row is taken once too, unless it is the copy that is kept: then it may take
    further survivors. rank is a total order; a repeated pair counts at its first rank; a null end pairs with nothing.

    Each round takes every pair that nothing before it can still bar, then drops what those bar. That gives the walk's
    result in as many rounds as the longest chain of pairs that wait for each other. What is open is cut from its
    lineage by a reliable checkpoint each round; only a count goes to the driver.
    """
    ensure_checkpoint_dir(pairs.sparkSession)
    fixed = F.min_by("keep_absorbed", "rank").alias("keep_absorbed")
    todo = pairs.dropna(subset=["absorbed", "survivor"]).groupBy("absorbed", "survivor").agg(fixed, F.min("rank").alias("rank")).checkpoint()
    taken = todo.limit(0)
    while todo.count():
        first = todo.groupBy("survivor").agg(F.min("rank").alias("s"))
        bars = todo.filter("NOT keep_absorbed").groupBy("absorbed").agg(F.min("rank").alias("a"))
        ready = todo.join(first, "survivor").join(bars, "absorbed", "left").filter("rank = s AND (a IS NULL OR rank <= a)").select(*todo.columns).checkpoint()
        gone = ready.filter("NOT keep_absorbed").select("absorbed").distinct()
        todo = todo.join(ready.select("survivor").distinct(), "survivor", "left_anti").join(gone, "absorbed", "left_anti").select(*ready.columns).checkpoint()
        taken = taken.unionByName(ready).checkpoint()
    return taken


def _walk(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], seconds: int) -> tuple[list[int], list[int], list[bool]]:
    """Places in a and b (ids, times, own) of the pairs taken, and whether the one of a is kept. The first free one of b
    within the time comes from a tree of minima over b in order of time."""
    (ids, at, own), (others, there, theirs) = a, b
    n, by_id, by_time = len(others), np.argsort(others, kind="stable"), np.argsort(there, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_id] = np.arange(n)
    leaf = np.empty(n, np.int64)
    leaf[rank[by_time]] = np.arange(n) + n
    tree, leaf = [n] * n + rank[by_time].tolist(), leaf.tolist()
    for k in range(n - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    lo, hi = (np.searchsorted(there[by_time], at + d, side).tolist() for d, side in ((-seconds, "left"), (seconds, "right")))
    absorbed, survivor, kept = [], [], []
    for i in np.argsort(ids, kind="stable").tolist():
        keep = True
        while keep:
            first, x, z = n, lo[i] + n, hi[i] + n
            while x < z:
                if x & 1:
                    first, x = min(first, tree[x]), x + 1
                if z & 1:
                    z -= 1
                    first = min(first, tree[z])
                x, z = x >> 1, z >> 1
            if first == n:
                break
            keep = bool(own[i] and not theirs[by_id[first]])
            absorbed.append(i)
            survivor.append(int(by_id[first]))
            kept.append(keep)
            k = leaf[first]
            tree[k] = n
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])
    return absorbed, survivor, kept


def resolve_near(starts: DataFrame, seconds: int) -> DataFrame:
    """What resolve_pairs takes of all pairs within so many seconds of each other, in order of both ids, of starts (house,
    absorbed, id, at, own): in a house, those that are absorbed pair with those that aren't. An own one is kept where
    the survivor isn't own.

    The pairs of a house grow with the square of its starts, so none is a row before it is taken: a house is walked
    through by itself, in little more time than it takes to sort it. A house is two persons, so its starts are one row.
    """
    columns = ["absorbed", "id", "at", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            absorbed, *held = (b[c].flatten().to_numpy(zero_copy_only=False) for c in columns)
            ends = np.concatenate([[0], np.cumsum(b["id"].value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            found = []
            for x, z in zip(ends[:-1], ends[1:]):
                sides = [tuple(c[x:z][side] for c in held) for side in (absorbed[x:z], ~absorbed[x:z])]
                if len(sides[0][0]) and len(sides[1][0]):
                    i, j, kept = _walk(*sides, seconds)
                    found.append((sides[0][0][i], sides[1][0][j], np.array(kept, bool)))
            taken = [np.concatenate(c) for c in zip(*found)] if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(taken, (pa.int64(), pa.int64(), pa.bool_()))], names=["absorbed", "survivor", "keep_absorbed"])

    rows = starts.dropna(subset=["house", "id", "at"]).groupBy("house").agg(F.collect_list(F.struct(*columns)).alias("s"))
    both = rows.select(*[F.col(f"s.{c}").alias(c) for c in columns]).filter("exists(absorbed, x -> x) AND exists(absorbed, x -> NOT x)")
    taken = both.mapInArrow(run, "absorbed long, survivor long, keep_absorbed boolean")
    return taken.withColumn("rank", F.struct(F.col("absorbed").alias("a"), F.col("survivor").alias("b")))

"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared as distinct values only. Their tiles are keyed by the population counts of the four 16-bit
words: the sum of the differences of these counts never exceeds the number of differing bits, so tiles whose counts
differ by more than the radius in all are skipped, and no link is lost. Tiles that remain are compared in full with
numpy's exclusive-or and bit counts, a tile with one tile of each neighbouring cell at a time. A tile holds about
tile_rows fingerprints at most, so a task never has more than some 81 times as many in memory.
A task turns its links into a forest (one edge for each fingerprint it joins), so a group of copies never becomes
all its pairs; the forests are joined to components by alternating star contractions, each written to the shared
checkpoint folder.

The comparison is exact and therefore grows with the square of the number of distinct fingerprints, by a factor of
about a tenth of all pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, forget, fresh, join_hot, text_batches, written

BASE = 17  # a 16-bit word has 0 to 16 bits set


def simhash(text: bytes, shingle_words: int = 4) -> int:
    """64 bits; a bit is 1 if it is set in over half the XXH64 (seed 42) of the word shingles. No words: 0."""
    joined = b" ".join(text.lower().split())  # bytes: only A-Z are lowered, only ASCII white space splits
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    if len(starts) > shingle_words:
        starts, ends = starts[: len(starts) - shingle_words + 1], ends[shingle_words - 1 :]
    else:
        starts, ends = [0], [len(joined)]
    digest = xxhash.xxh64_digest
    view = memoryview(joined)
    hashes = b"".join([digest(view[a:b], 42) for a, b in zip(starts, ends)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(len(starts), 64)
    majority = np.add.reduce(bits, axis=0, dtype=np.int64) * 2 > len(starts)
    return int.from_bytes(np.packbits(majority).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", shingle_words: int = 4, keep: tuple = ()) -> DataFrame:
    """id (and the columns in keep, as they are) and fp, a signed 64-bit value; null texts count as empty."""
    text_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("__text"))

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([simhash(t or b"", shingle_words) for t in texts], pa.int64())], names=[*b.schema.names[:-1], "fp"])

    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def _offsets(radius: int) -> list[int]:
    """Differences of cell numbers for word counts that differ by radius in all, one of each two opposite ones."""
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d > (0, 0, 0, 0)]
    return sorted(d for d in steps)


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[i] and b[i], for all i."""
    while len(a):
        a, b = _roots(parent, a), _roots(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def forest(own: np.ndarray, others: np.ndarray, radius: int, within: bool = True, area: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what own's links with others (and, if within, among themselves) join; never more than nodes."""
    nodes = np.concatenate([own, others])
    parent = np.arange(len(nodes))
    step = max(1, area // max(1, len(nodes)))
    for at in range(0, len(own), step):
        for left in range(at if within else len(own), len(nodes), area):
            part = nodes[left : left + area]
            near = np.bitwise_count(own[at : at + step, None] ^ part[None, :]) <= radius
            i, j = np.nonzero(near)
            i, j = i + at, j + left
            later = j > i
            _join(parent, i[later], j[later])
    root = _roots(parent, np.arange(len(nodes)))
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def links(fps: DataFrame, radius: int = 4, tile_rows: int = 4096) -> DataFrame:
    """a, b: edges whose components are those of all pairs of distinct values of fps.fp within radius bits."""
    word = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)))
    celled = fps.select("fp").distinct().withColumn("cell", ((word(3) * BASE + word(2)) * BASE + word(1)) * BASE + word(0))
    counts = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / tile_rows).cast("int").alias("subs"))
    counts = checkpointed(counts)  # at most 17 ** 4 rows
    tiles = celled.join(F.broadcast(counts), "cell").groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int").alias("sub")).agg(F.collect_list("fp").alias("fps"))
    tiles = checkpointed(tiles)
    digits = [F.floor(F.col("cell") / BASE**k) % BASE for k in (3, 2, 1, 0)]
    steps = F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(d)]) for d in _offsets(radius)])
    split = counts.select("cell", "subs", *[d.alias(f"w{k}") for k, d in enumerate(digits)])
    stepped = split.withColumn("d", F.explode(steps))
    moved = [F.col(f"w{k}") + F.col(f"d.d{k}") for k in range(4)]
    inside = moved[0].between(0, 16) & moved[1].between(0, 16) & moved[2].between(0, 16) & moved[3].between(0, 16)
    target = counts.select(F.col("cell").alias("to_cell"), F.col("subs").alias("to_subs"))
    across = stepped.filter(inside).select("cell", "subs", (((moved[0] * BASE + moved[1]) * BASE + moved[2]) * BASE + moved[3]).cast("int").alias("to_cell")).join(F.broadcast(target), "to_cell")
    across = across.select("cell", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), "to_cell", "to_subs").select("cell", "sub", "to_cell", F.explode(F.sequence(F.lit(0), F.col("to_subs") - 1)).alias("to_sub"))
    within = counts.filter("subs > 1").select("cell", F.explode(F.sequence(F.lit(0), F.col("subs") - 2)).alias("sub"), "subs").select("cell", "sub", F.col("cell").alias("to_cell"), F.explode(F.sequence(F.col("sub") + 1, F.col("subs") - 1)).alias("to_sub"))
    # The tiles of one number, one of each neighbouring cell, make a group with the tile they are sent to: some 80 tiles.
    meet = checkpointed(across.unionByName(within))
    sent = tiles.join(meet, ["cell", "sub"]).select("to_cell", "to_sub", F.col("sub").alias("group"), F.lit(False).alias("own"), "fps")
    groups = meet.select("to_cell", "to_sub", F.col("sub").alias("group")).unionByName(counts.select(F.col("cell").alias("to_cell"), F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("to_sub"), F.lit(0).alias("group"))).distinct()
    own = groups.join(tiles.withColumnsRenamed({"cell": "to_cell", "sub": "to_sub"}), ["to_cell", "to_sub"]).select("to_cell", "to_sub", "group", F.lit(True).alias("own"), "fps")

    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf["own"].to_numpy(bool)
        gather = lambda xs: np.concatenate([np.zeros(0, np.uint64), *[np.asarray(x, np.int64).view(np.uint64) for x in xs]])
        a, b = forest(gather(pdf["fps"][rows]), gather(pdf["fps"][~rows]), radius, within=key[2] == 0)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return sent.unionByName(own).groupBy("to_cell", "to_sub", "group").applyInPandas(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for each node of edges a, b but the roots, by alternating large
    and small stars until nothing changes."""

    def star(e, large: bool, rows: int):
        """The edges, and what to delete once they are written; no group is gathered in one place."""
        if large:
            pairs = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            pairs = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least, path = written(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), rows)
        met = join_hot(pairs, least, "u")
        if large:
            return met.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), path
        return met.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(met.select("u", F.col("m").alias("v"))).distinct(), path

    spark = edges.sparkSession
    seen = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    e, path = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = seen(e)
    while before[0]:
        old = [path]
        for large in (True, False):
            next_e, spent = star(e, large, before[0])
            e, path = written(next_e, before[0])
            old += [spent, path]
        forget(spark, *old[:-1])
        if (now := seen(e)) == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle_words: int = 4, radius: int = 4, keep: tuple = ()) -> DataFrame:
    """One row per row of docs: id, the columns in keep, fp (signed), component_id (least id that links reach).

    Null and empty texts have fingerprint zero and link like any other; equal fingerprints link; a null id is
    passed over as component_id unless the component has no other. Only the named columns are used, and an empty
    table gives an empty result."""
    fps = checkpointed(fingerprints(docs, id_col, text_col, shingle_words, keep))
    known = checkpointed(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    joined = components(links(known, radius))
    rooted = checkpointed(known.join(joined, known["fp"] == joined["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", F.col("n").alias("copies")))
    ids = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    by_fp = checkpointed(join_hot(rooted, ids, "root").select("fp", "component_id", F.col("copies").alias("n")))
    return join_hot(fps, by_fp, "fp").select(F.col("id").alias(id_col), *keep, "fp", "component_id")


def one_of_each(docs: DataFrame, id_col="doc_id", text_col="text", **how) -> DataFrame:
    """docs with one document of each component: that of the least id, and of rows with that id the least by hash."""
    row, row_id, n = fresh(docs, "row_hash", "row_id", "row_n")
    hashed = docs.withColumn(row, F.xxhash64(*docs.columns))
    found = near_duplicates(hashed, id_col, text_col, keep=(row,), **how)
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(row))).alias("best"))
    best = best.select(F.col("best").getField(id_col).alias(row_id), F.col(f"best.{row}"))
    kept = hashed.join(best, hashed[id_col].eqNullSafe(best[row_id]) & (hashed[row] == best[row]), "left_semi")
    return kept.withColumn(n, F.row_number().over(Window.partitionBy(id_col, row).orderBy(F.lit(0)))).filter(F.col(n) == 1).select(docs.columns)

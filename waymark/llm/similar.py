"""Near duplicates by SimHash candidates and exact Jaccard similarity: the near-dedup stage of the pipeline.

A text is the set of its distinct shingles of five words (a shorter text is one shingle). Sets get SimHash
fingerprints of 256 bits; sets whose sizes allow the similarity and whose fingerprints differ in at most radius bits
are candidates. At a similarity of 0.8 a bit differs with probability of about arccos(0.889) / pi = 0.15 (up to 0.19
for sets of a few shingles), 39 to 48 bits in all with a deviation of 6, so that a radius of 76 is 4.5 deviations away
or more; bits of unrelated sets differ in 128 places, with a deviation of 8.

Sets are dealt to tiles by size class; only equal and adjacent classes can be similar, and such tiles meet in pairs,
two in memory at a time. A pair of tiles returns its candidates as a forest, one edge for each set joined, so they are
never written out pair by pair; the forests' components are clusters. Links are found inside clusters, by the exact
similarity of the whole sets, again as forests:

* small clusters, many to a task, all pairs of a cluster at once;
* a large cluster in blocks, each with its hub, the set with most close candidates: a group of edited copies, however
  large, mostly hangs together by it;
* if a large cluster is still in several parts, the pairs of its blocks that hold different parts. Blocks of one part
  don't meet again.

Within a size class the comparison of fingerprints is exact and grows with the square of their number.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, fresh, text_batches
from .simhash import _join, _roots, components

CELLS = 1 << 23  # of the filter that finds the rows of candidates; a full one only costs time


def shingle_digests(text: bytes, shingle_words: int = 5) -> np.ndarray:
    """[n, 2] words of 64 bits: XXH3-128 of the distinct shingles, in order of the first word."""
    joined = b" ".join(text.lower().split())  # bytes: only A-Z are lowered, only ASCII white space splits
    if not joined:
        return np.zeros((0, 2), np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    if len(starts) > shingle_words:
        starts, ends = starts[: len(starts) - shingle_words + 1], ends[shingle_words - 1 :]
    else:
        starts, ends = [0], [len(joined)]
    digest, view = xxhash.xxh3_128_digest, memoryview(joined)
    both = np.frombuffer(b"".join([digest(view[a:b], 42) for a, b in zip(starts, ends)]), np.uint64).reshape(-1, 2)
    return both[np.unique(both[:, 0], return_index=True)[1]]


WORDS = ("w0", "w1", "w2", "w3")  # of a fingerprint


def sketch(text: bytes, shingle_words: int = 5) -> tuple[int, ...]:
    """Key of the shingle set, the four words of its fingerprint (signed) and its size."""
    d = shingle_digests(text, shingle_words)
    if not len(d):
        return (0,) * 6
    more = (d ^ (d >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)  # two more words, by splitmix64's finish
    more = (more ^ (more >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    more ^= more >> np.uint64(31)
    bits = np.unpackbits(np.hstack([d, more]).view(np.uint8), axis=1)
    votes = np.add.reduce(bits, axis=0, dtype=np.int64) * 2
    print_ = np.packbits(np.where(votes == len(d), bits[0], votes > len(d))).view(np.int64)  # zeros for ties would make small sets alike
    key = int.from_bytes(xxhash.xxh64_digest(np.ascontiguousarray(d[:, 0]).tobytes(), 42), "big", signed=True)
    return key, *print_.tolist(), len(d)


def near_forest(own: dict, other: dict | None, radius: int, close: int, similarity: float, area: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates within own, or of own and other, as rows (a, b, n): the edges of a forest with n = 0, and for each
    set that has candidates at most close bits away itself twice and their number."""
    second = own if other is None else other
    keys = own["key"] if other is None else np.concatenate([own["key"], other["key"]])
    parent, degree = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    step = max(1, area // max(1, len(second["key"])))
    for at in range(0, len(own["key"]), step):
        apart = [(own[c][at : at + step, None] ^ second[c]).view(np.uint64) for c in WORDS]  # counts of signed values are those of their magnitude
        bits = sum(np.bitwise_count(x) for x in apart[1:]).astype(np.uint16) + np.bitwise_count(apart[0])
        i, j = np.nonzero(bits <= radius)
        near = bits[i, j] <= close
        i += at
        small, large = np.minimum(own["n"][i], second["n"][j]), np.maximum(own["n"][i], second["n"][j])
        both = small - (small == large)  # the most that different sets of these sizes can share
        ok = both >= similarity * (small + large - both) - 1e-9
        if other is None:
            ok &= i < j
        i, j, near = i[ok], j[ok] + (0 if other is None else len(own["key"])), near[ok]
        degree += np.bincount(i[near], minlength=len(keys)) + np.bincount(j[near], minlength=len(keys))
        _join(parent, i, j)
    root = _roots(parent, np.arange(len(keys)))
    child, busy = np.flatnonzero(root != np.arange(len(keys))), np.flatnonzero(degree)
    return np.concatenate([keys[child], keys[busy]]), np.concatenate([keys[root[child]], keys[busy]]), np.concatenate([np.zeros(len(child), np.int64), degree[busy]])


def candidates(sets: DataFrame, radius: int, close: int, similarity: float, tile_rows: int = 4096) -> DataFrame:
    """a, b, n: near_forest() of all pairs of tiles of sets (key, WORDS, n) that can hold candidates."""
    width = math.log(1 / similarity) * 1.0001  # sizes that allow the similarity are in equal or adjacent classes
    celled = sets.filter("n > 0").withColumn("cell", F.floor(F.log("n") / width).cast("int"))
    counts = checkpointed(celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("subs")))  # a few dozen rows
    fields = ("key", *WORDS, "n")
    tiles = celled.join(F.broadcast(counts), "cell").groupBy("cell", F.pmod(F.xxhash64("key"), F.col("subs")).cast("int").alias("sub")).agg(*[F.collect_list(c).alias(c) for c in fields])
    tiles = checkpointed(tiles)
    place = tiles.select("cell", "sub")
    there = place.select(F.col("cell").alias("to_cell"), F.col("sub").alias("to_sub"))
    pairs = place.withColumn("to_cell", F.explode(F.array(F.col("cell"), F.col("cell") + 1))).join(there, "to_cell").filter("to_cell > cell OR to_sub >= sub")
    pairs = checkpointed(pairs.select("cell", "sub", "to_cell", "to_sub"))
    first = pairs.join(tiles, ["cell", "sub"]).select(*pairs.columns, F.lit(True).alias("own"), *fields)
    second = pairs.filter("to_cell > cell OR to_sub > sub").join(tiles.withColumnsRenamed({"cell": "to_cell", "sub": "to_sub"}), ["to_cell", "to_sub"]).select(*pairs.columns, F.lit(False).alias("own"), *fields)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = {bool(r["own"]): {c: np.asarray(r[c], np.int64) for c in fields} for _, r in pdf.iterrows()}
        return pd.DataFrame(dict(zip("abn", near_forest(tile[True], tile.get(False), radius, close, similarity), strict=True)))

    return first.unionByName(second).groupBy(*pairs.columns).applyInPandas(compare, "a long, b long, n long")


def set_links(keys: np.ndarray, root: np.ndarray, grams: list[np.ndarray], left: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The forest of pairs of similar sets of different roots; left: only pairs of a left set and one that is not."""
    size = np.array([len(g) for g in grams], np.int64)
    ids = np.unique(np.concatenate(grams), return_inverse=True)[1]
    start = np.cumsum(size) - size
    mask, parent, n = np.zeros(len(ids), bool), np.arange(len(keys)), np.arange(len(keys))
    for i in range(len(keys)) if left is None else np.flatnonzero(left):
        able = (root != root[i]) & (np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]) - 1e-9) & (n > i if left is None else ~left)
        if able.any():
            own = ids[start[i] : start[i] + size[i]]
            mask[own] = True
            both = np.add.reduceat(mask[ids], start, dtype=np.int64)
            mask[own] = False
            j = np.flatnonzero(able & (both >= similarity * (size + size[i] - both) - 1e-9))
            _join(parent, np.full(len(j), i), j)
    top = _roots(parent, n)
    child = np.flatnonzero(top != n)
    return keys[child], keys[top[child]]


#: A group of sets that are compared in one task holds about so many sets and shingles at most.
BLOCK, MASS = 512, 2_000_000


def _blocks(count, mass):
    """Blocks that so many sets with so many shingles make."""
    return F.greatest(F.ceil(count / BLOCK), F.ceil(mass / MASS), F.lit(1)).cast("int")


def _compared(rows: DataFrame, whole: DataFrame, group: list[str], similarity: float) -> DataFrame:
    """a, b: links of rows (group columns, cluster, key, root, own) within each group and cluster; own: null, or
    which side of a pair of blocks the row is on."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64),) * 2]
        for _, part in pdf.groupby("cluster"):
            if len(part) > 1:
                left = None if part["own"].isna().any() else part["own"].to_numpy(bool)
                out.append(set_links(part["key"].to_numpy(np.int64), part["root"].to_numpy(np.int64), [np.asarray(g, np.int64) for g in part["grams"]], left, similarity))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip("ab", zip(*out, strict=True), strict=True)})

    return rows.join(whole, "key").groupBy(*group).applyInPandas(compare, "a long, b long")


def _whole_sets(docs: DataFrame, row: str, text_col: str, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """key and grams of the sets of wanted (key, row). Only their texts are cut into shingles again; they are found by
    a filter on their row's hash, so no text is shuffled."""
    cells = np.zeros(CELLS, bool)
    cells[wanted.select(F.pmod("row", F.lit(CELLS)).cast("int").alias("c")).distinct().toPandas()["c"].to_numpy(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(cells))

    def run(batches):
        maybe = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            b = b.filter(pa.array(maybe[b.column(0).to_numpy() % CELLS]))
            held = [shingle_digests(t or b"", shingle_words)[:, 0] for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            sets = [(int.from_bytes(xxhash.xxh64_digest(np.ascontiguousarray(h).tobytes(), 42), "big", signed=True), h) for h in held if len(h)]
            flat = np.concatenate([np.zeros(0, np.int64), *[np.ascontiguousarray(h).view(np.int64) for _, h in sets]])
            ends = np.cumsum([0, *[len(h) for _, h in sets]])
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["key", "grams"])

    found = docs.select(F.col(row), F.col(text_col)).mapInArrow(run, "key long, grams array<long>")
    return checkpointed(found.groupBy("key").agg(F.first("grams").alias("grams")))


def similar_links(sets: DataFrame, docs: DataFrame, row: str, text_col: str, shingle_words: int, similarity: float, radius: int, close: int) -> DataFrame:
    """a, b: edges whose components are those of all pairs of similar sets, of sets (key, WORDS, n, row)."""
    near = checkpointed(candidates(sets, radius, close, similarity))
    edges = near.filter("n = 0")
    found = components(edges)
    ends = edges.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    of_key = ends.join(found, ends["key"] == found["node"], "left").select("key", F.coalesce("root", "key").alias("cluster"))
    degree = near.filter("n > 0").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("degree"))
    members = checkpointed(of_key.join(sets.select("key", "n", "row"), "key").join(degree, "key", "left"))
    whole = _whole_sets(docs, row, text_col, members.select("row"), shingle_words)
    clusters = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("mass"), F.max(F.struct("degree", "key")).getField("key").alias("hub"))
    clusters = checkpointed(clusters.withColumn("subs", _blocks(F.col("sets"), F.col("mass"))))
    buckets = -(-(clusters.filter("subs = 1").agg(F.sum(F.greatest(F.col("mass"), F.col("sets") * (MASS // BLOCK)))).first()[0] or 1) // MASS)
    placed = members.join(clusters, "cluster")
    own = placed.select("cluster", "key", F.col("key").alias("root"), F.lit(None).cast("boolean").alias("own"), F.when(F.col("subs") == 1, F.pmod(F.xxhash64("cluster"), F.lit(buckets))).otherwise(F.col("cluster")).alias("g"), F.when(F.col("subs") == 1, -1).otherwise(F.pmod(F.xxhash64("key"), F.col("subs"))).cast("int").alias("h"))
    hubs = clusters.filter("subs > 1").select("cluster", F.col("hub").alias("key"), F.col("hub").alias("root"), F.lit(None).cast("boolean").alias("own"), F.col("cluster").alias("g"), F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("h"))
    links = checkpointed(_compared(own.unionByName(hubs).distinct(), whole, ["g", "h"], similarity))
    if not clusters.filter("subs > 1").head(1):
        return links
    found = components(links)
    large = placed.filter("subs > 1")
    large = checkpointed(large.join(found, large["key"] == found["node"], "left").select("cluster", "key", large["n"], F.coalesce("root", "key").alias("root")))
    parts = large.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("mass"))
    parts = checkpointed(parts.join(parts.groupBy("cluster").agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1"), "cluster"))
    # A part of some size has blocks of its own, and what is smaller is pooled.
    big = (F.col("m") >= BLOCK // 4) | (F.col("mass") >= MASS // 4)
    pools = parts.filter(~big).groupBy("cluster").agg(_blocks(F.sum("m"), F.sum("mass")).alias("pools"))
    parts = parts.join(pools, "cluster", "left").select("cluster", "root", F.when(big, F.col("root")).alias("pure"), F.when(big, _blocks(F.col("m"), F.col("mass"))).alias("subs"), F.when(~big, F.pmod(F.xxhash64("root"), F.col("pools"))).cast("int").alias("pool"))
    name = F.when(F.col("pure").isNull(), F.concat_ws(":", F.lit("pool"), "pool")).otherwise(F.concat_ws(":", "pure", F.pmod(F.xxhash64("key"), F.col("subs"))))
    blocked = checkpointed(large.join(parts, ["cluster", "root"]).select("cluster", "key", "root", "pure", name.alias("block")))
    each = checkpointed(blocked.select("cluster", "block", "pure").distinct())
    pairs = each.join(each.select("cluster", F.col("block").alias("to"), F.col("pure").alias("to_pure")), "cluster").filter("block < to AND coalesce(pure <> to_pure, TRUE) OR block = to AND pure IS NULL")
    pairs = checkpointed(pairs.select("cluster", "block", "to", (F.col("block") != F.col("to")).alias("two")))
    here = pairs.join(blocked, ["cluster", "block"]).select("cluster", "block", "to", "key", "root", F.when(F.col("two"), True).alias("own"))
    away = pairs.filter("two").join(blocked.withColumnRenamed("block", "to"), ["cluster", "to"]).select("cluster", "block", "to", "key", "root", F.lit(False).alias("own"))
    return links.unionByName(checkpointed(_compared(here.unionByName(away), whole, ["cluster", "block", "to"], similarity)))


def one_of_similar(docs: DataFrame, id_col="doc_id", text_col="text", shingle_words: int = 5, similarity: float = 0.8, radius: int = 76, close: int = 43) -> DataFrame:
    """docs with one document of each component of links: that of the least id, and of rows with that id the least by
    hash. Null and empty texts are one component; a null id is kept only if its component has no other."""
    text_batches(docs.sparkSession)
    row, row_id, n = fresh(docs, "row_hash", "row_id", "row_n")
    hashed = docs.withColumn(row, F.xxhash64(*docs.columns))
    narrow = hashed.select(F.col(id_col).alias("id"), F.col(row).alias("row"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            got = np.array([sketch(t or b"", shingle_words) for t in b.column(2).cast(pa.large_binary()).to_pylist()], np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(np.ascontiguousarray(got[:, k])) for k in range(6)]], names=["id", "row", "key", *WORDS, "n"])

    longs = [T.StructField(c, T.LongType()) for c in ("key", *WORDS, "n")]
    sketches = narrow.mapInArrow(run, T.StructType([*narrow.schema.fields[:2], *longs]))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    sets = checkpointed(sketches.groupBy("key").agg(*[F.min(c).alias(c) for c in WORDS], F.min("n").alias("n"), best))
    links = similar_links(sets.select("key", *WORDS, "n", "best.row"), hashed, row, text_col, shingle_words, similarity, radius, close)
    found = components(links)
    rooted = sets.join(found, sets["key"] == found["node"], "left").select("best", F.coalesce("root", "key").alias("root"))
    chosen = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.id").alias(row_id), F.col("best.row").alias(row))
    kept = hashed.join(chosen, row).filter(F.col(id_col).eqNullSafe(F.col(row_id)))  # dealt by row, as the window is: texts are shuffled once
    return kept.withColumn(n, F.row_number().over(Window.partitionBy(row, id_col).orderBy(F.lit(0)))).filter(F.col(n) == 1).select(docs.columns)

"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into blocks of about block_words words: a block is a range of the hash of id and text, so a row
knows its block where it is read. A source's blocks are permuted, pass after pass, and its quota is the number of
permuted blocks whose words make up its target; that is exact, for the words of every block are counted. The quotas
of all sources are split among the output shards by a binary tree: at each node the left half's share is one
multivariate-hypergeometric draw, seeded by the node, so every task finds the same tree without being told. A shard
so draws disjoint runs of each source's permuted blocks, and orders their documents by a hash of its own. Documents
are taken whole; the block in which a target is met gives its documents in the order of the hash up to the target.

Driver: one row per source (at most max_sources, else ValueError). A window holds one run of RUN blocks of a source,
the totals of these runs (BLOCKS / RUN at most), or the hashes of one block; no task holds a source.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, fresh, text_batches, word_counts

#: Blocks of a source at most, and those of one window; shards at most.
BLOCKS, RUN, SHARDS = 1 << 22, 1 << 7, 1 << 16
DRAWS = "array<struct<pass:int,block:long,position:long,shard:int,rank:long>>"


def targets(sizes: dict, weights: list[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> dict:
    """Words to take by source. Sources in code point order, null last, weigh as weights says, again and again;
    no target is above cap times its source's size, and what is over is shared anew by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, out, rest = share * sum(sizes.values()), {}, list(order)
    while rest:
        total = sum(weigh[s] for s in rest)
        full = [s for s in rest if left * weigh[s] / total > cap * sizes[s]]
        if not full:
            return out | {s: left * weigh[s] / total for s in rest}
        for s in full:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in full)
        rest = [s for s in rest if s not in out]
    return out


class SplittingTree:
    """The shard of each block position, by quotas split in halves of shards down to one."""

    def __init__(self, quotas: np.ndarray, shards: int, seed: int):
        self.quotas, self.shards, self.seed, self.cuts = np.asarray(quotas, np.int64), shards, seed, {}
        self.total = int(self.quotas.sum())

    def left(self, lo: int, hi: int, counts: np.ndarray) -> np.ndarray:
        """What the left half of shards lo to hi gets of counts."""
        if (lo, hi) not in self.cuts:
            start, mid, end = (self.total * k // self.shards for k in (lo, (lo + hi) // 2, hi))
            assert counts.sum() == end - start
            rng = np.random.Generator(np.random.PCG64([self.seed, lo, hi]))
            self.cuts[lo, hi] = rng.multivariate_hypergeometric(counts, mid - start, method="marginals")
        return self.cuts[lo, hi]

    def place(self, source: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Shards of the positions, below their source's quota, of blocks."""
        out = np.zeros(len(source), np.int32)

        def walk(lo, hi, counts, rows, pos):
            if not len(rows) or hi - lo == 1:
                out[rows] = lo
                return
            take = self.left(lo, hi, counts)
            at = take[source[rows]]
            go = pos < at
            walk(lo, (lo + hi) // 2, take, rows[go], pos[go])
            walk((lo + hi) // 2, hi, counts - take, rows[~go], (pos - at)[~go])

        walk(0, self.shards, self.quotas, np.arange(len(source)), position.astype(np.int64))
        return out


def stride(n: int, seed: int) -> tuple[int, int]:
    """a, c such that i -> (a * i + c) mod n permutes 0 to n - 1."""
    rng = np.random.Generator(np.random.PCG64([seed, n]))
    a = int(rng.integers(1, max(2, n)))
    while math.gcd(a, n) > 1:
        a += 1
    return a, int(rng.integers(0, max(1, n)))


def _sized(rows: DataFrame, text: str, size: str) -> DataFrame:
    """rows with the words of their texts in place of the texts."""
    text_batches(rows.sparkSession)
    at = rows.columns.index(text)
    others = [k for k in range(len(rows.columns)) if k != at]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in others], pa.array(word_counts(b.column(at)), pa.int64())], names=[*[b.schema.names[k] for k in others], size])

    return rows.mapInArrow(run, T.StructType([*[rows.schema.fields[k] for k in others], T.StructField(size, T.LongType())]))


class Plan:
    """What every task needs to know of a mix: of each source its blocks, permutation, quota and last hash."""

    def __init__(self, sources: list, blocks, strides, quotas, last, shards: int, passes: int, seed: int):
        self.sources, self.shards, self.passes, self.seed = sources, shards, passes, seed
        self.blocks, self.quotas, self.last = (np.array(x, np.int64) for x in (blocks, quotas, last))
        self.a, self.c = (np.array([s[k] for s in strides], np.int64) for k in (0, 1))
        self.tree = SplittingTree(self.quotas, shards, seed)

    def block(self, s: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Blocks of the hashes key of the sources numbered s: equal ranges of their upper 40 bits."""
        return ((key.view(np.uint64) >> np.uint64(24)).astype(np.int64) * self.blocks[s]) >> 40

    def draws(self, s: np.ndarray, key: np.ndarray) -> list[list[tuple]]:
        """For each row the passes that draw it: (pass, block, position, shard, rank)."""
        out: list[list[tuple]] = [[] for _ in s]
        block = self.block(s, key)
        at = (self.a[s] * block + self.c[s]) % np.maximum(1, self.blocks[s])
        for p in range(self.passes):
            position = at + p * self.blocks[s]
            quota = self.quotas[s]
            # The last block of a quota gives what comes up to its last hash.
            rows = np.flatnonzero((position < quota - 1) | ((position == quota - 1) & (key.view(np.uint64) <= self.last.view(np.uint64)[s])))
            shard = self.tree.place(s[rows], position[rows])
            with np.errstate(over="ignore"):
                rank = (key[rows] ^ (shard.astype(np.int64) + 1) * np.int64(0x2545F4914F6CDD1D)) * np.int64(0x5851F42D4C957F2D) + p
            for r, *d in zip(rows.tolist(), block[rows].tolist(), position[rows].tolist(), shard.tolist(), rank.tolist(), strict=True):
                out[r].append((p, *d))
        return out


def _plan(sized: DataFrame, weights, share, cap, shards, shard_words, block_words, seed, max_sources) -> tuple[Plan, list, dict]:
    """The plan, the sources' sizes and targets, of rows (__source, __key, __size)."""
    spark = sized.sparkSession
    rows = sized.groupBy("__source").agg(F.sum("__size").alias("n")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = {r[0]: int(r[1]) for r in rows}
    goal = targets(sizes, weights, share, cap)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    words = math.ceil(sum(goal.values()))
    block = max(block_words, -(-sum(sizes.values()) // BLOCKS))
    passes = math.ceil(cap)
    blocks = [-(-sizes[s] // block) for s in order]
    strides = [stride(n, seed + i) if n else (1, 0) for i, n in enumerate(blocks)]
    table = [(i, s, n, *st, sizes[s], float(goal[s])) for i, (s, n, st) in enumerate(zip(order, blocks, strides, strict=True)) if n]
    known = F.broadcast(spark.createDataFrame(table, "__sid int, __s string, __n long, __a long, __c long, __all long, __goal double"))  # one row per source
    placed = sized.join(known, F.col("__source").eqNullSafe(F.col("__s"))).filter("__size > 0").withColumn("__block", F.expr("shiftright(shiftrightunsigned(__key, 24) * __n, 40)"))
    counted = placed.groupBy("__sid", "__block").agg(F.sum("__size").alias("__words"))
    turned = checkpointed(counted.join(known, "__sid").withColumn("__at", F.expr("(__a * __block + __c) % __n")).withColumn("__run", F.expr(f"__at div {RUN}")).select("__sid", "__run", "__at", "__block", "__words", "__n", "__all", "__goal"))
    before = lambda by, at: F.coalesce(F.sum("__words").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = turned.groupBy("__sid", "__run").agg(F.sum("__words").alias("__words")).select("__sid", "__run", before(["__sid"], "__run").alias("__base"))
    starts = turned.withColumn("__inside", before(["__sid", "__run"], "__at")).join(runs, ["__sid", "__run"])
    passed = starts.withColumn("__pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("__start", F.expr("__base + __inside + __pass * __all")).filter("__start < __goal")
    last = checkpointed(passed.groupBy("__sid").agg(F.max(F.struct(F.expr("__pass * __n + __at").alias("position"), "__block", "__start")).alias("m")).select("__sid", "m.*"))
    # In the block in which a target is met, documents are taken in the order of the hash until the next would miss it by more.
    edge = placed.join(F.broadcast(last), ["__sid", "__block"]).withColumn("__order", F.col("__key").bitwiseXOR(F.lit(-(1 << 63)))).groupBy("__sid", "__order", "__start", "__goal").agg(F.sum("__size").alias("__words"))
    edge = edge.withColumn("__start", F.col("__start") + before(["__sid"], "__order")).filter("__start < __goal AND 2 * (__goal - __start) >= __words")
    cut = {r[0]: int(r[1]) for r in edge.groupBy("__sid").agg(F.max("__order")).collect()}
    found = {r["__sid"]: int(r["position"]) for r in last.collect()}
    quotas = [found.get(i, -1) + 1 for i in range(len(order))]
    ends = []
    for i, q in enumerate(quotas):  # a block of which nothing is taken is no part of the quota; a hash is kept as signed
        if q and i not in cut:
            quotas[i] -= 1
        ends.append(cut[i] ^ -(1 << 63) if i in cut else -1)
    n = shards or max(1, min(SHARDS, words // shard_words))
    return Plan(order, blocks, strides, quotas, ends, n, passes, seed), order, {s: (sizes[s], float(goal[s])) for s in order}


def _key(id_col: str, text_col: str, seed: int):
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def _drawn(plan: Plan, spark):
    """A column function of source number and hash: the draws."""
    shared = spark.sparkContext.broadcast(plan)

    @F.pandas_udf(DRAWS)
    def draws(s: pd.Series, key: pd.Series) -> pd.Series:
        found = shared.value.draws(s.to_numpy(np.int64), key.to_numpy(np.int64))
        return pd.Series([[dict(zip(("pass", "block", "position", "shard", "rank"), d, strict=True)) for d in row] for row in found])

    return draws


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(3, 1, 2), share=1.5, cap=2.0, shards=None, shard_words=1_000_000, block_words=4096, seed=17, max_sources=100_000) -> DataFrame:
    """One row per document: id, size (words), source_size, target (its source's, in words), taken (words the mix
    takes, repeats counted: size for each draw) and draws (pass, block, position among its source's permuted blocks,
    shard and rank in it, for each time it is taken).

    A source's words come within half a document of its target. shards: so many that each has about shard_words
    words, SHARDS at most, if not given. Null and empty texts have size 0 and are never taken; a null source is a
    source, last in order. Rows alike in id and text are taken or left together, null ids included. Columns other
    than those named are ignored, whatever their names; an empty table gives an empty result."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), _key(id_col, text_col, seed).alias("__key"), F.col(text_col).alias("__text"))
    sized = checkpointed(_sized(narrow, "__text", "__size"))
    plan, order, about = _plan(sized.select("__source", "__key", "__size"), weights, share, cap, shards, shard_words, block_words, seed, max_sources)
    facts = F.broadcast(spark.createDataFrame([(i, s, *about[s]) for i, s in enumerate(order)], "__sid int, __s string, source_size long, target double"))  # one row per source
    drawn = sized.join(facts, F.col("__source").eqNullSafe(F.col("__s"))).withColumn("draws", F.when(F.col("__size") > 0, _drawn(plan, spark)("__sid", "__key")).otherwise(F.array().cast(DRAWS)))
    return drawn.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), "source_size", "target", F.aggregate("draws", F.lit(0).cast("long"), lambda total, _: total + F.col("__size")).alias("taken"), "draws")


def mixed_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(3, 1, 2), share=1.5, cap=2.0, shards=None, shard_words=1_000_000, block_words=4096, seed=17, max_sources=100_000) -> DataFrame:
    """The mix itself, in the columns of docs: a row, as it is, for each time a document is taken. A partition of the
    result is an output shard, in the order of the shards, and shuffled within; texts are shuffled once, for that."""
    spark = docs.sparkSession
    columns = docs.columns
    key, words, sid, name, draw = fresh(docs, "mix_key", "mix_words", "mix_sid", "mix_source", "mix_draw")
    narrow = docs.select(F.col(source_col).alias("__source"), _key(id_col, text_col, seed).alias("__key"), F.col(text_col).alias("__text"))
    plan, order, _ = _plan(checkpointed(_sized(narrow, "__text", "__size")), weights, share, cap, shards, shard_words, block_words, seed, max_sources)
    numbers = F.broadcast(spark.createDataFrame([(i, s) for i, s in enumerate(order)], T.StructType([T.StructField(sid, T.IntegerType()), T.StructField(name, T.StringType())])))  # one row per source
    some = F.coalesce(F.col(text_col), F.lit("")).rlike("[^ \\t-\\r]")  # a text without a word is never taken
    keyed = docs.filter(some).withColumn(key, _key(id_col, text_col, seed)).join(numbers, F.col(source_col).eqNullSafe(F.col(name)))
    rows = keyed.withColumn(draw, F.explode(_drawn(plan, spark)(F.col(sid), F.col(key))))
    rows = rows.withColumn(sid, F.col(f"{draw}.shard")).withColumn(key, F.col(f"{draw}.rank"))
    return rows.repartitionById(plan.shards, F.col(sid)).sortWithinPartitions(key).select(columns)

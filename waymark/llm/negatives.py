"""Hard negatives for contrastive training, by a full sort of every anchor's scores.

Anchors are a stated query set and are scored against all rows, block by block: rows are packed into blocks of bounded
size where they are read, anchors into blocks of ANCHORS, and a copy of each anchor block goes to each slot of row
blocks, so every pair of blocks meets once. In a pair, integer scores are one exact matrix product; each anchor's
scores are sorted by score and id (one key that holds both, or numpy's lexsort where the key would not fit a long), an
upper limit is a binary search, and what is wanted follows it. A first pass finds each anchor's positives, a second the
negatives within the limits that their scores set. Pairs of one anchor block that follow one another are reduced in the
task, so a task sends on a few rows for each anchor; windows per anchor take the best of all.

The work is rows times anchors by definition; anchors are sent (rows / (SLOT_BLOCKS * BLOCK)) times, rows twice.
Nothing is broadcast and no label is gathered in one place, so one label may hold any share of the rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, text_batches

#: Rows and anchors of a block at most, and row blocks of a slot about.
BLOCK, ANCHORS, SLOT_BLOCKS = 8192, 1024, 16
#: A sort key holds the score above PLACE_BITS bits of the place in the block.
PLACE_BITS = 16
TOP = (1 << 63) - 1


def _clean(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: float) -> DataFrame:
    """id, label as text, fold (hash of label and vector, tells apart rows of one id) and whole components."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    narrow = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), vector.alias("raw"), F.coalesce(finite, F.lit(False)).alias("finite"))
    whole = F.transform("raw", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    taken = narrow.filter("id IS NOT NULL AND label IS NOT NULL AND finite").select("id", "label", whole.alias("whole"))
    return taken.select("id", "label", F.xxhash64("label", "whole").alias("fold"), "whole")


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[bytes]:
    """Blocks of at most so many rows, each sorted by id and fold and without repeated rows."""

    def block(parts):
        t = pa.Table.from_batches(parts)
        ids, folds = t["id"].to_numpy(), t["fold"].to_numpy()
        order = np.lexsort((folds, ids))
        keep = np.ones(len(order), bool)
        keep[1:] = (np.diff(ids[order]) != 0) | (np.diff(folds[order]) != 0)
        order = order[keep]
        column = t["whole"].combine_chunks()
        lengths = column.value_lengths().to_numpy()
        matrix = np.zeros((len(lengths), lengths.max(initial=0)), np.int64)  # shorter vectors go on with zeros
        matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = column.flatten().to_numpy()
        reach = max(abs(int(matrix.min(initial=0))), abs(int(matrix.max(initial=0))))
        kind = np.int16 if reach < 1 << 15 else np.int64
        return pickle.dumps((ids[order], folds[order], np.array(t["label"].to_pylist(), object)[order], matrix[order].astype(kind)), protocol=5)

    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, most):
            part = b.slice(at, most)
            if n + part.num_rows > most:
                yield block(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield block(held)


def _blocks(rows: DataFrame, most: int, slots: int) -> DataFrame:
    """slot, block: rows packed where they are."""

    def run(batches):
        at = TaskContext.get().partitionId() * 31
        for k, payload in enumerate(_packed(batches, most)):
            yield pa.RecordBatch.from_arrays([pa.array([(at + k) % slots], pa.int64()), pa.array([payload], pa.binary())], names=["slot", "block"])

    return rows.mapInArrow(run, "slot long, block binary")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b as longs, held at the ends of a long's range."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    reach = [max(abs(int(m.min(initial=0))), abs(int(m.max(initial=0)))) for m in (a, b)]
    most = d * reach[0] * reach[1]
    if most < 1 << 53:
        kind = np.float32 if most < 1 << 24 else np.float64
        return np.rint(a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -TOP, TOP).astype(np.int64)


def sorted_scores(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: places by falling score, equal ones in order of place, and minus the scores in that order."""
    places = np.arange(scores.shape[1], dtype=np.int64)
    if scores.size and max(abs(int(scores.min())), abs(int(scores.max()))) >= 1 << 62 - PLACE_BITS:
        order = np.lexsort((np.broadcast_to(places, scores.shape), -scores), axis=1)
        return order, -np.take_along_axis(scores, order, 1)
    keys = (-scores << PLACE_BITS) | places
    keys.sort(axis=1)
    return keys & (1 << PLACE_BITS) - 1, keys >> PLACE_BITS


def _first(found: list[tuple[np.ndarray, ...]], most: int) -> tuple[np.ndarray, ...]:
    """Of tuples (groups, scores, ids, folds), joined, the first `most` different rows of each group."""
    group, score, ids, folds = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((folds, ids, -score, group))
    group, score, ids, folds = group[order], score[order], ids[order], folds[order]
    fresh = np.ones(len(group), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (ids[1:] != ids[:-1]) | (folds[1:] != folds[:-1])
    group, score, ids, folds = group[fresh], score[fresh], ids[fresh], folds[fresh]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
    keep = rank < most
    return group[keep], score[keep], ids[keep], folds[keep]


def _positives(anchors, rows, most: int):
    """(anchor, score, id, fold) of each anchor's best rows of its own label in a block; its own id is no other row."""
    (a_ids, _, a_labels, a), (ids, folds, labels, m) = anchors, rows
    for label in set(a_labels):
        mine, same = np.flatnonzero(a_labels == label), np.flatnonzero(labels == label)
        if not len(same):
            continue
        order, minus = sorted_scores(products(a[mine], m[same]))
        own = ids[same][order] == a_ids[mine][:, None]
        take = ~own & (np.cumsum(~own, axis=1) <= most)
        i, j = np.nonzero(take)
        at = same[order[i, j]]
        yield mine[i], -minus[i, j], ids[at], folds[at]


def _negatives(anchors, limits, rows, most: int):
    """(limit, score, id, fold) of the first rows of another label at or below each limit's upper end that aren't below
    its lower end. limits are (anchor, lower, upper), ordered by anchor."""
    (_, _, a_labels, a), (ids, folds, labels, m) = anchors, rows
    of, lower, upper = limits
    span = np.arange(len(a_ids := anchors[0]) + 1)
    begins = np.searchsorted(of, span)
    for label in set(a_labels[of]):
        mine, other = np.flatnonzero(a_labels == label), np.flatnonzero(labels != label)
        mine = mine[begins[mine + 1] > begins[mine]]
        if not len(other):
            continue
        order, minus = sorted_scores(products(a[mine], m[other]))
        for i, anchor in enumerate(mine):
            which = np.arange(begins[anchor], begins[anchor + 1])
            start = np.searchsorted(minus[i], -upper[which], "left")
            at = start[:, None] + np.arange(most)
            inside = at < len(other)
            at = np.minimum(at, len(other) - 1)
            g, k = np.nonzero(inside & (-minus[i][at] >= lower[which][:, None]))
            if len(g):
                picked = other[order[i][at[g, k]]]
                yield which[g], -minus[i][at[g, k]], ids[picked], folds[picked]


def _meet(anchors: DataFrame, blocks: DataFrame, slots: int) -> DataFrame:
    """Each anchor block beside each row block, those of one anchor block one after another."""
    copies = anchors.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)).cast("array<bigint>"))).repartition(slots, "slot")
    return copies.join(blocks.repartition(slots, "slot").hint("shuffle_hash"), "slot").drop("slot")


def _limits(positives: list[dict], lower: int, upper: int):
    """(anchor, lower, upper) in whole scores, of positives ordered by anchor; held within a long's range."""
    score = [p["score"] for p in positives]
    return np.array([p["a"] for p in positives], np.int64), np.array([max(-TOP, min(TOP, -(-lower * s // 100))) for s in score], np.int64), np.array([max(-TOP, min(TOP, upper * s // 100)) for s in score], np.int64)


def mine(rows: DataFrame, anchor: Column, id_col="vec_id", vector_col="embedding", label: Column | None = None, positives: int = 5, negatives: int = 3, lower: int = 50, upper: int = 95, scale: float = 256, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the inner product of two rows. Anchors are the rows for which
    `anchor`, a condition on `id`, holds. An anchor's positives are its first `positives` rows of the same label by
    falling score, then id; for each of them come the first `negatives` rows of another label with
    lower * positive_score <= 100 * negative_score <= upper * positive_score. Fewer where there are no more.

    Rows with a null id, label, vector or component, or one that isn't finite, take no part. Repeated rows count once;
    rows that share an id but differ are rows of their own, though never each other's positive. A shorter vector goes on
    with zeros. Components and scores beyond a long are held at its ends. Other columns are ignored; an empty table
    gives an empty result."""
    spark = rows.sparkSession
    text_batches(spark)
    cleaned = _clean(rows, id_col, vector_col, F.col("label") if label is None else label, scale)
    total, asking = cleaned.agg(F.count(F.lit(1)), F.count_if(anchor)).first()
    cores = spark.sparkContext.defaultParallelism
    most = max(1, min(block, -(-total // (4 * cores)), 1 << PLACE_BITS))
    slots = max(4 * cores, -(-total // (SLOT_BLOCKS * most)) if most == block else 0)
    dealt = cleaned.filter(anchor).distinct().repartition(max(1, -(-asking // (ANCHORS // 2))), "id", "fold")

    def number(batches):
        at = TaskContext.get().partitionId()
        for k, payload in enumerate(_packed(batches, ANCHORS)):
            yield pa.RecordBatch.from_arrays([pa.array([(at << 32) + k], pa.int64()), pa.array([payload], pa.binary())], names=["set", "anchors"])

    anchors = checkpointed(dealt.mapInArrow(number, "set long, anchors binary"))
    blocks = _blocks(cleaned, most, slots)

    def best(batches):
        """The positives of each anchor among the row blocks that follow one another."""
        now, held, found = None, None, []

        def sent():
            a, score, ids, folds = _first(found, positives)
            return pa.RecordBatch.from_pydict({"set": np.full(len(a), now), "a": a, "score": score, "id": ids, "fold": folds})

        for b in batches:
            for n, a, r in zip(*(c.to_pylist() for c in (b["set"], b["anchors"], b["block"]))):
                if n != now:
                    if found:
                        yield sent()
                    now, held, found = n, pickle.loads(a), []
                found += _positives(held, pickle.loads(r), positives)
                found = [_first(found, positives)] if found else []
        if found:
            yield sent()

    def ranked(df, *group):
        once = df.repartition(*group).dropDuplicates([*group, "id", "fold"])
        return once.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "id", "fold")))

    own = ranked(_meet(anchors, blocks, slots).mapInArrow(best, "set long, a long, score long, id long, fold long"), "set", "a").filter(F.col("rank") <= positives)
    asked = own.groupBy("set").agg(F.array_sort(F.collect_list(F.struct("a", "rank", "id", "score"))).alias("positives"))  # of ANCHORS anchors
    asked = checkpointed(anchors.join(asked, "set"))

    def beyond(batches):
        """The negatives of each positive among the row blocks that follow one another."""
        now, held, limits, found = None, None, None, []

        def sent():
            g, score, ids, folds = _first(found, negatives)
            at = [held[1][k] for k in g.tolist()]
            return pa.RecordBatch.from_pydict({"set": np.full(len(g), now), "a": limits[0][g], "p": np.array([p["rank"] for p in at], np.int64), "anchor_id": held[0][0][limits[0][g]], "positive_id": np.array([p["id"] for p in at], np.int64), "positive_score": np.array([p["score"] for p in at], np.int64), "score": score, "id": ids, "fold": folds})

        for b in batches:
            for n, a, p, r in zip(*(c.to_pylist() for c in (b["set"], b["anchors"], b["positives"], b["block"]))):
                if n != now:
                    if found:
                        yield sent()
                    now, held, found = n, (pickle.loads(a), p), []
                    limits = _limits(p, lower, upper)
                found += _negatives(held[0], limits, pickle.loads(r), negatives)
                found = [_first(found, negatives)] if found else []
        if found:
            yield sent()

    hard = _meet(asked, blocks, slots).mapInArrow(beyond, "set long, a long, p long, anchor_id long, positive_id long, positive_score long, score long, id long, fold long")
    kept = ranked(hard, "set", "a", "p").filter(F.col("rank") <= negatives)
    return kept.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def duckdb_sql() -> str:
    """The rows of the query by a plain join and windows, for unique ids and components of moderate size."""
    return """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS k
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, k::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3
"""

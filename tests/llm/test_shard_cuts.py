"""Where shards are cut and which slots they give, against one walk over the documents in order."""

import random
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from waymark.llm import sharding

SF = "/root/testdata/sf0.001"


def walked(rows, shards, overhead=8):
    """(id, size, crc, shard, slot) by a walk in order of the text's hash (signed, seed 42) and the id, nulls first."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted(rows, key=lambda r: (signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)), r[0] is not None, r[0] or 0))
    total, before, next_slot, out = sum(len((t or "").encode()) + overhead for _, t in rows), 0, {}, []
    for i, t in order:
        data = (t or "").encode()
        shard = min(shards - 1, before * shards // total)
        slot = next_slot.get(shard, 0)
        next_slot[shard] = slot + 1
        out.append((i, len(data) + overhead, zlib.crc32(data), shard, slot))
        before += len(data) + overhead
    return sorted(out, key=repr)


def got(df, **how):
    rows = sharding.shard_by_bytes(df, **how).collect()
    assert {r["law"] for r in rows} <= {"bytes"} and all(r["grown_shard"] is None for r in rows)
    return sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rows), key=repr)


@pytest.mark.parametrize("shards", [1, 3, 24, 500])
def test_cuts_and_slots_equal_a_walk(spark, shards):
    r = random.Random(shards)
    rows = [(k if k % 9 else None, r.choice(["", None, "é" * r.randint(1, 50), "w " * r.randint(1, 400), "copy"])) for k in range(300)] + [(1000, "x" * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df, shards=shards) == walked(rows, shards)


def test_documents_equal_a_walk(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(df) == walked([(x["doc_id"], x["text"]) for x in df.collect()], 24)


def test_given_order_is_followed(spark):
    rows = [(k, "t" * (k % 7)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.shard_by_bytes(df, shards=4, order=[-F.col("doc_id")]).orderBy("shard", "slot").collect()
    assert [x["doc_id"] for x in found] == list(range(59, -1, -1))

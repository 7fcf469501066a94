"""The mix against independent counts of its quotas, its draws and what it takes."""

import math
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from waymark.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def words(t):
    return len((t or "").encode().split())


def test_targets_share_anew_what_is_over():
    got = mixing.targets({"a": 100, "b": 1000, None: 1000, "c": 0})
    assert got["a"] == 200 and got["c"] == 0
    assert abs(sum(got.values()) - 1.5 * 2100) < 1e-6 and all(v <= 2 * n + 1e-9 for v, n in ((got["b"], 1000), (got[None], 1000)))


def test_splitting_tree_is_a_partition():
    quotas = np.array([13, 0, 200, 77])
    tree = mixing.SplittingTree(quotas, 7, 3)
    s = np.repeat(np.arange(4), quotas)
    p = np.concatenate([np.arange(q) for q in quotas])
    shards = tree.place(s, p)
    assert np.bincount(shards, minlength=7).tolist() == [290 * (k + 1) // 7 - 290 * k // 7 for k in range(7)]
    assert (mixing.SplittingTree(quotas, 7, 3).place(s[::-1], p[::-1])[::-1] == shards).all()


def test_splitting_tree_is_multivariate_hypergeometric():
    """Over many seeds, a shard's counts have the mean and variance of drawing its blocks without replacement."""
    quotas, shards = np.array([30, 10, 60]), 4
    got = np.array([np.bincount(np.repeat(np.arange(3), quotas)[mixing.SplittingTree(quotas, shards, seed).place(np.repeat(np.arange(3), quotas), np.concatenate([np.arange(q) for q in quotas])) == 2], minlength=3) for seed in range(1500)])
    share = quotas / 100
    assert (got.sum(axis=1) == 25).all()
    assert abs(got.mean(axis=0) - 25 * share).max() < 0.25
    assert abs(got.var(axis=0) / (25 * share * (1 - share) * 75 / 99) - 1).max() < 0.15


@pytest.mark.parametrize("how", [{"block_words": 100, "shards": 5}, {"block_words": 777, "shards": 3}, {}])
def test_taken_is_what_the_tree_draws(documents, how):
    rows = mixing.mix(documents, **how).collect()
    text = {r["doc_id"]: (r["source"], words(r["text"])) for r in documents.collect()}
    sizes = Counter()
    for s, n in text.values():
        sizes[s] += n
    goal = mixing.targets(dict(sizes))
    taken, seen, longest = Counter(), {}, Counter()
    for r in rows:
        source, n = text[r["doc_id"]]
        assert (r["size"], r["source_size"], r["target"]) == (n, sizes[source], goal[source])
        assert r["taken"] == n * len(r["draws"]) <= 2 * n and len({d["pass"] for d in r["draws"]}) == len(r["draws"])
        taken[source] += r["taken"]
        longest[source] = max(longest[source], n)
        for d in r["draws"]:
            assert seen.setdefault((source, d["position"]), (d["block"], d["shard"], d["pass"])) == (d["block"], d["shard"], d["pass"])
    assert all(abs(taken[s] - goal[s]) <= longest[s] / 2 + 1 for s in goal)
    # Positions of a source are blocks, each once a pass; those of its quota are drawn whole, but for the last.
    block = how.get("block_words", 4096)
    quota = {s: max(p for t, p in seen if t == s) + 1 for s in goal}
    for (s, p), (b, _, k) in seen.items():
        assert p // math.ceil(sizes[s] / block) == k and 0 <= b < math.ceil(sizes[s] / block)
    assert len({(s, v[0], v[2]) for (s, _), v in seen.items()}) == len(seen)
    for r in rows:
        source, n = text[r["doc_id"]]
        blocks = {(v[0], v[2]): p for (s, p), v in seen.items() if s == source}
        mine = {b for b, _ in ((d["block"], 0) for d in r["draws"])}
        for b in mine:
            for k in (0, 1):
                p = blocks.get((b, k))
                assert p is None or p == quota[source] - 1 or any(d["position"] == p for d in r["draws"])
    # Shards get the same numbers of blocks, one more or less, as the tree deals positions out.
    total, shards = sum(quota.values()), max(v[1] for v in seen.values()) + 1
    assert {v[1] for v in seen.values()} <= set(range(how.get("shards", shards)))
    assert total >= len(seen)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(documents, **how).collect()))


def test_what_is_taken_depends_on_the_blocks(documents):
    a, b = ({r["doc_id"]: r["taken"] for r in mixing.mix(documents, block_words=n).collect()} for n in (100, 777))
    assert a != b


def test_query(spark):
    rows = queries.op1_mixing(spark, SF).collect()
    assert all(r["taken"] == len(r["shard"]) * r["size"] and len(r["rank"]) == len(r["block"]) == len(r["shard"]) for r in rows)


def test_stage_leaves_texts_as_they_are(spark, documents, odd, none):
    for docs in (documents, odd):
        texts = {tuple(r) for r in docs.collect()}
        df = corpus_pipeline.mix_sources(spark, docs, "")
        out = df.collect()
        assert df.columns == docs.columns and out and all(tuple(r) in texts for r in out)
        assert len(out) == sum(len(r["draws"]) for r in mixing.mix(docs).collect())
    assert corpus_pipeline.mix_sources(spark, none, "").collect() == [] == mixing.mix(none).collect()


def test_a_partition_is_a_shard(documents):
    from pyspark.sql import functions as F

    placed = {}
    for r in mixing.mix(documents, shards=5).collect():
        for d in r["draws"]:
            placed.setdefault(d["shard"], []).append((d["rank"], r["doc_id"]))
    rows = mixing.mixed_documents(documents, shards=5).select("doc_id", F.spark_partition_id().alias("p")).collect()
    for k in range(5):
        assert [r["doc_id"] for r in rows if r["p"] == k] == [i for _, i in sorted(placed.get(k, []))]

"""The pipeline's stages and run(), each against a plain version of what it should keep."""

import re

import corpus_pipeline
import pytest
from test_similar import brute_kept
from waymark.llm import decontam, mixing, toxicity

SF = "/root/testdata/sf0.001"


def size(t):
    return len((t or "").encode()) + 8


def check_shards(rows, texts, order=None):
    """Shards of equal bytes along the slots, without gaps; order: (doc_id, size) as they should stand."""
    rows = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    for k in {r["shard"] for r in rows}:
        assert [r["slot"] for r in rows if r["shard"] == k] == list(range(sum(r["shard"] == k for r in rows)))
    total, at = sum(r["size"] for r in rows), 0
    for r in rows:
        assert r["shard"] == min(23, at * 24 // total) and r["law"] == "bytes" and r["grown_shard"] is None
        at += r["size"]
    if order is not None:
        assert [(r["doc_id"], r["size"]) for r in rows] == order


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returns on the whole table, written and read as run() does."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((name, docs, after))
        docs = after
    return out


def test_filtering_stages(spark, kept):
    (_, docs, mild), (_, _, single), (_, _, clean) = kept[:3]
    assert docs.columns == mild.columns == single.columns == clean.columns
    scored = toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert {r["doc_id"] for r in mild.collect()} == {r["doc_id"] for r in scored if r["score"] < 0.5}
    assert {r["doc_id"] for r in single.collect()} == brute_kept([(r["doc_id"], r["text"]) for r in mild.collect()])
    plain = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).strip()
    items = [plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in single.collect() if any(len(i) >= 10 and i in plain(r["text"]) for i in items)}
    left = {r["doc_id"] for r in clean.collect()}
    assert leaks and not leaks & left
    found = decontam.matches(single, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert {r["doc_id"] for r in single.collect()} - left == {r["doc_id"] for r in found.collect()}


def test_mix_and_shards_keep_the_order_of_the_mix(kept):
    (_, clean, mixed), (_, _, shards) = kept[3:]
    placed = sorted((d["shard"], d["rank"], r["doc_id"]) for r in mixing.mix(clean).collect() for d in r["draws"])
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert mixed.columns == clean.columns
    assert sorted((r["doc_id"], r["text"]) for r in mixed.collect()) == sorted((i, text[i]) for *_, i in placed)
    check_shards(shards.collect(), text, [(i, size(text[i])) for *_, i in placed])


@pytest.mark.parametrize("which", ["odd", "none"])
def test_run_on_odd_and_empty_tables(spark, request, tmp_path, which):
    docs = request.getfixturevalue(which)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 1, 0), (5, 1, 1), (None, None, None)] if which == "odd" else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "une phrase en francais avec quelques mots dedans"), (None, None)] if which == "odd" else [], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert bool(rows) == (which == "odd") and all(r["doc_id"] in texts and r["doc_id"] != 8 for r in rows)
    check_shards(rows, texts)


def test_each_stage_takes_rows_that_are_no_file(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() > 0

"""Queries on ids far beyond one block of events: no arithmetic on ids may overflow or make two ids one."""

import pytest
from pyspark.sql import functions as F

from waymark import catalog
from waymark.operators import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=[104_000_000, 900_000_400_000])
def shifted(request, spark, tmp_path_factory):
    """Shifted by blocks that leave an activity's id modulo 13, which decides whether it is dated, as it is."""
    folder = str(tmp_path_factory.mktemp("shifted"))
    spark.read.parquet(f"{SF}/events.parquet").withColumn("event_id", F.col("event_id") + request.param).write.parquet(f"{folder}/events.parquet")
    return folder


def test_greedy_pairs_equal_a_walk(spark, shifted):
    pairs = queries._twins(spark, shifted).collect()
    assert len(pairs) > 10
    taken, spent, gone = [], set(), set()
    for p in sorted(pairs, key=lambda p: (p["absorbed"], p["survivor"])):
        if p["survivor"] in spent or p["absorbed"] in gone:
            continue
        spent.add(p["survivor"])
        if not p["keep_absorbed"]:
            gone.add(p["absorbed"])
        taken.append((p["absorbed"], p["survivor"]))
    assert sorted((r["absorbed"], r["survivor"]) for r in catalog.QUERIES["m04_greedy_pairs"](spark, shifted).collect()) == taken


@pytest.mark.parametrize("name,key", [("j20_line_match", "track_id"), ("j20_directed_line_match", "activity_id")])
def test_line_matches_do_not_change_with_ids(spark, shifted, name, key):
    """The block number is all that a shift changes in an activity's id."""
    plain = lambda rows: sorted((r[key] % 10_000_000_000, round(r["overlap"] or 0, 6)) for r in rows)
    got = catalog.QUERIES[name](spark, shifted).collect()
    assert got and plain(got) == plain(catalog.QUERIES[name](spark, SF).collect())

"""Hard negatives against a brute-force walk: ties, repeats, odd rows, large components, small blocks."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import negatives, queries

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def brute(rows, every, positives=5, wanted=3):
    """By the words of the contract, over different rows."""
    rows = [(i, lab, [min(max(int(np.floor(256.0 * x)) if abs(x) < 1e300 else int(x) * 256, -(2**63)), 2**63 - 1) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    rows = sorted({(i, lab, tuple(v)) for i, lab, v in rows})
    out = []
    for i, lab, v in rows:
        if i % every:
            continue
        scored = [(-max(-negatives.TOP, min(negatives.TOP, sum(x * y for x, y in zip(v, w)))), j, other) for j, other, w in rows if j != i]
        for minus, p, _ in sorted(x for x in scored if x[2] == lab)[:positives]:
            inside = sorted(x for x in scored if x[2] != lab and 50 * -minus <= 100 * -x[0] <= 95 * -minus)
            out += [(i, p, k, n, -minus, -m) for k, (m, n, _) in enumerate(inside[:wanted], 1)]
    return sorted(out)


def run(spark, rows, every, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS id", "2 AS slot", "3 AS block", "4 AS Score")
    return sorted(map(tuple, negatives.mine(df, anchor=F.col("id") % every == 0, **how).collect()))


@pytest.mark.parametrize("block", [4, 8192])
def test_equals_brute_force(spark, block):
    r = random.Random(block)
    near = lambda: [r.choice([0.5, 0.6, 0.7, 0.8, 1.0]) for _ in range(3)]  # few values: many ties
    rows = [(k, near(), r.randrange(3)) for k in range(120)] + [(k, [0.7, 0.7, 0.7], 1) for k in range(120, 160)]
    rows += [(3, near(), 2), (500, None, 1), (510, [1.0, None, 0.5], 1), (520, [NAN, 1.0, 1.0], 1), (530, [INF, 1.0, 1.0], 2), (540, near(), None), (None, near(), 1), (550, [], 0), (560, [0.9], 0)]
    rows += [rows[7], rows[20], rows[20], (-10, near(), 0), (570, [-0.5, -0.5, -0.5], 1)]
    assert run(spark, rows, 10, block=block) == brute(rows, 10)


def test_large_components(spark):
    r = random.Random(1)
    for reach in (200.0, 1e9, 1e17, 1e300):
        rows = [(k, [r.uniform(0.4, 1) * reach for _ in range(3)], k % 2) for k in range(40)]
        assert run(spark, rows, 5) == brute(rows, 5)


def test_scores_are_exact_and_sorted():
    g = np.random.default_rng(3)
    for reach in (100, 1 << 20, 1 << 40):
        a, b = g.integers(-reach, reach, (5, 7)), g.integers(-reach, reach, (30, 7))
        want = [[max(-negatives.TOP, min(negatives.TOP, sum(int(p) * int(q) for p, q in zip(x, y)))) for y in b] for x in a]
        got = negatives.products(a, b)
        assert got.tolist() == want
        order, minus = negatives.sorted_scores(got // max(1, reach))
        for k, row in enumerate(got // max(1, reach)):
            assert order[k].tolist() == sorted(range(30), key=lambda i: (-row[i], i)) and (-minus[k]).tolist() == row[order[k]].tolist()


def test_empty_and_lone(spark):
    assert run(spark, [], 10) == [] and run(spark, [(10, [1.0], 1)], 10) == []


def test_query_matches_oracle(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = sorted(map(tuple, queries.op13_negatives(spark, SF).collect()))
    assert got and got == sorted(c.sql(queries.ORACLES["op13_negatives"]).fetchall())

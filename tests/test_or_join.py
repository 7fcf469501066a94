"""Pairs by a key or by time and fixes: one join, of few copies, equal to the SQL at its edges."""

import datetime

import duckdb
import numpy as np

from waymark import catalog
from waymark.operators import queries


def test_edges_equal_the_sql(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows, t0 = [], datetime.datetime(2024, 1, 2)
    for user, n in enumerate([1, 1, 2, 10, 11, 19, 20, 19, 20, 21, 38, 39, 40, 41, 42, 95, 99, 100, 101, 105] * 4):
        begin = t0 + datetime.timedelta(minutes=int(rng.choice([0, 0, 29, 30, 59, 60])), microseconds=int(rng.choice([0, 0, 1, 999_999])))
        rows += [(begin + datetime.timedelta(seconds=k), user) for k in range(n)]
        if user % 5 == 0:  # a key in common, and the next five days begin within half an hour
            rows += [(datetime.datetime(2024, 1, 5, 23, 50), user), (datetime.datetime(2024, 1, 6, 0, 5), user)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame([(i, t, u, "view", 1.0, None) for i, (t, u) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(path)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    want = duck.sql(catalog.ORACLES["j05_or_join"]).fetchall()
    assert len(want) > 100 and sorted(tuple(r) for r in catalog.QUERIES["j05_or_join"](spark, str(tmp_path)).collect()) == sorted(want)


def test_one_join_of_few_copies(spark):
    plan = queries.j05_or_join(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Union" not in plan

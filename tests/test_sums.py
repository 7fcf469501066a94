"""Seconds and sums that are rounded: told as the SQL tells them, and alike in any order of rows."""

import datetime
import itertools
import re

import duckdb

from waymark import catalog
from waymark.plans import relational


def test_bests_take_seconds_to_the_nearest(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(0, at(0.6), 1, "view", 1.0, None), (1, at(20.0), 1, "view", 1.0, None), (2, at(60.4), 1, "view", 1.0, None), (3, at(5.5), 2, "view", 1.0, None), (4, at(16.5), 2, "view", 1.0, None)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(path)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    want = duck.sql(catalog.ORACLES["a03_personal_bests"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["a03_personal_bests"](spark, str(tmp_path)).collect())) == sorted(want)


def test_rollup_sums_tenths_alike_in_any_order(spark):
    """The sum of these as doubles is a tie or a little less, by its order."""
    sql = relational.SQL["a05_user_rollup"]
    total = re.search(r"count\(\*\) AS n, (.*?) AS m, min\(began\)", sql)[1]
    of_spark = re.sub(r"\[\[(.*?)\|\|.*?\]\]", r"\1", total)
    found = set()
    for tenths in itertools.permutations((828.8, 270.4, 707.3)):
        rows = spark.createDataFrame([(m,) for m in tenths], "m double").coalesce(1)
        found.add(rows.selectExpr(f"CAST(round({of_spark}) AS BIGINT)").first()[0])
    assert found == {1807}


def test_speeds_next_to_a_tie_round_as_the_sql_does(spark):
    """201.2 m in 1 920 s are 0.37725 km/h in digits, but less than that in their double."""
    rounded = [re.search(r"'fastest', sport, (round\(.*?), activity_id FROM", s)[1] for s in (catalog.ORACLES["a03_personal_bests"], re.sub(r"\[\[(.*?)\|\|.*?\]\]", r"\1", relational.SQL["a03_personal_bests"]))]
    rows = [(tenths / 10, s) for s in (96, 1920, 4800, 7200, 8064) for tenths in range(1, 20000)]
    spark.createDataFrame(rows, "m double, s long").createOrReplaceTempView("speeds")
    got = [r[0] for r in spark.sql(f"SELECT {rounded[1]} AS v FROM speeds ORDER BY s, m").collect()]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE speeds AS SELECT CAST(t AS DOUBLE) / 10 AS m, s FROM (SELECT unnest([96, 1920, 4800, 7200, 8064]) AS s) x, range(1, 20000) r(t)")
    assert got == [r[0] for r in duck.sql(f"SELECT {rounded[0]} AS v FROM speeds ORDER BY s, m").fetchall()]

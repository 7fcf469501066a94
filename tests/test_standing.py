"""Arrivals judged against the rides as they stand, where rides of one user start minutes apart."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from waymark import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def near(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("near"))
    events = spark.read.parquet(f"{SF}/events.parquet")
    again = [events.withColumns({"event_id": F.col("event_id") + k * 100_000, "ts": F.col("ts") + F.expr(f"INTERVAL '{2 * k}' MINUTE")}) for k in range(4)]
    again[0].unionByName(again[1]).unionByName(again[2]).unionByName(again[3]).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["m01_ingest_outcome", "m02_promote_twin"])
def test_equals_its_sql(spark, near, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{near}/events.parquet/*.parquet'")
    found = duck.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, near).select(*found.columns).collect()
    assert Counter(map(tuple, got)) == Counter(found.fetchall())

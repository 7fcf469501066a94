"""Tiles beyond the last meridian: kept by the query, refused by the archive, whose ids have no place for them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from waymark import catalog
from waymark.sources import tilearchive

SF = "/root/testdata/sf0.001"


def test_columns_go_on_beyond_the_meridian(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.unionByName(events.withColumns({"user_id": F.col("user_id") + 90_000, "event_id": F.col("event_id") + 100_000})).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(duck.sql(catalog.ORACLES["s26_s27_tile_archive"]).fetchall())
    assert max(r[1] >> r[0] for r in want) == 1
    assert sorted(map(tuple, catalog.QUERIES["s26_s27_tile_archive"](spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("place", [(3, 8, 0), (3, 0, 8), (3, -1, 0), (27, 0, 0)])
def test_archive_refuses_other_places(spark, tmp_path, place):
    with pytest.raises(Exception, match="outside the world"):
        tilearchive.write_archive(spark.createDataFrame([(*place, bytearray(b"a"))], "z int, x long, y long, tile binary"), f"file://{tmp_path}/a")

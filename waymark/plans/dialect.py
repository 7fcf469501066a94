"""Queries written once in SQL for Spark and for the DuckDB oracle.

A template names its tables {events} and, where the two dialects differ, has [[spark||duckdb]]. {dense} is no table
but the prepared traces.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.operators.prepare import prepare_traces
from waymark.plans.traces import ELIGIBLE, FAR_KM, FIXES, GAP_M, JUMP_M, RADIUS_M
from waymark.session import ensure_checkpoint_dir, read_table

_EITHER = re.compile(r"\[\[(.*?)\|\|(.*?)\]\]", re.S)
_TABLE = re.compile(r"\{(\w+)\}")


def spark_query(template: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the tables that the template names."""
    text = _EITHER.sub(lambda m: m[1], template)
    tables = sorted(set(_TABLE.findall(text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: prepared(spark, sf_dir) if t == "dense" else read_table(spark, sf_dir, t) for t in tables})

    return run


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the derived traces that the community may know of, in the shared checkpoint folder: a query scans
    the events once, however often it refers to them."""
    fixes = spark_query(f"WITH {FIXES} SELECT activity_id, user_id, sport, seq, lon, lat FROM fx WHERE {ELIGIBLE}")(spark, sf_dir)
    ensure_checkpoint_dir(spark)
    return prepare_traces(fixes, far_km=FAR_KM, jump_m=JUMP_M, radius=RADIUS_M, gap=GAP_M).checkpoint()


def over(template: str, dense: DataFrame) -> DataFrame:
    """A template of {dense} alone over a prepared table that is at hand."""
    return dense.sparkSession.sql(_EITHER.sub(lambda m: m[1], template), dense=dense)


def duckdb_sql(template: str) -> str:
    """The oracle's text; RECURSIVE does no harm where nothing is."""
    template = re.sub(r"^\s*WITH ", "WITH RECURSIVE ", template) if "{dense}" in template else template
    return _TABLE.sub(lambda m: m[1], _EITHER.sub(lambda m: m[2], template))

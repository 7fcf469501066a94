"""All registered queries of the trace and relational families, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.operators import queries as operator_queries
from waymark.plans import checked, kernel, kinds, relational, upkeep
from waymark.plans.dialect import duckdb_sql, spark_query

_TEMPLATES = kernel.SQL | relational.SQL | upkeep.SQL | kinds.SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: spark_query(t) for name, t in _TEMPLATES.items()} | operator_queries.QUERIES | checked.QUERIES
ORACLES: dict[str, str] = {name: duckdb_sql(t) for name, t in _TEMPLATES.items()} | checked.ORACLES

"""Every query over the driver's tables, by name, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import extract_queries, graph_queries, history_queries, scalar_queries
from .query import Query, gather

QUERIES: dict[str, Query]
SQL: dict[str, str]
QUERIES, SQL = gather(scalar_queries, extract_queries, history_queries, graph_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["page_selectors"](spark, sf_dir)

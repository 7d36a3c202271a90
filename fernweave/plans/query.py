"""How query modules declare what they offer."""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Marks a query; sql gives the same rows on the same tables."""

    def mark(run: Query) -> Query:
        run.is_query, run.sql = True, sql
        return run

    return mark


def gather(*modules: ModuleType) -> tuple[dict[str, Query], dict[str, str]]:
    found = {name: f for m in modules for name, f in vars(m).items() if getattr(f, "is_query", False)}
    return found, {name: f.sql for name, f in found.items() if f.sql}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

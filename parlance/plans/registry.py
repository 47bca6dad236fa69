"""Where the plans register their queries and DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, and its twin in SQL."""

    def add(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is read; documents, on which work is expensive, over all cores."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name == "documents" else scan

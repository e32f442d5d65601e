"""The registry that query modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def mark_sql(key: str, seed: int) -> str:
    """What sampling.mark says, in DuckDB."""
    return f"CAST('0x' || substr(md5(concat({key}, '|{seed}')), 1, 13) AS BIGINT)"


def uniform_sql(key: str, seed: int) -> str:
    """What sampling.uniform says, in DuckDB."""
    return f"((CAST({mark_sql(key, seed)} AS DOUBLE) + 0.5) / 4503599627370496)"


def query(name: str, sql: str | None = None):
    """Register a function (t) -> DataFrame, where t(name) is a table; sql says the same in DuckDB."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add

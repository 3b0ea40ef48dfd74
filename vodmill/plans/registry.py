"""A registry of named queries and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vodmill.sources.shared import scratch  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(base: str, keys: list[str], parts: dict[str, list[str]]) -> None:
    """Registers a query per operator of a query that applies several: its keys and that operator's columns."""
    whole, sql = QUERIES[base], SQL.get(base)
    for name, cols in parts.items():
        def one(spark: SparkSession, sf_dir: str, cols=cols) -> DataFrame:
            return whole(spark, sf_dir).select(*keys, *cols)

        one.__name__ = name
        QUERIES[name] = one
        if sql:
            SQL[name] = f"SELECT {', '.join([*keys, *cols])} FROM ({sql})"

"""The registry that keeps each query beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with DuckDB SQL if there is any."""

    def add(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"a second query {key}")
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = oracle
        return f

    return add

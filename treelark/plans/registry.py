"""The registered queries of the engine: name -> callable, and name -> DuckDB SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable of (model tables of a folder) under a name."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from treelark.plans.model import Model

            return fn(Model(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add

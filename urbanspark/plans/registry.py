"""Registered queries: name -> (spark, sf_dir) -> DataFrame, each with its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *relations: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``relations`` are the synthetic relations that the SQL uses."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            from urbanspark.plans.synth import with_relations

            ORACLE[f.__name__] = with_relations(sql, relations)
        return f

    return add

"""Queries register here with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import small_batches
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of `t`, which reads tables by name, under its own name.  Its Python
    workers take small Arrow batches."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: small_batches(f(lambda name: table(spark, sf_dir, name)))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add

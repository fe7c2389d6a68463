"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftmap.catalog.oracle import sql as with_tables
from siftmap.sources.domain import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(domain)` under `name`; without `sql` only the row count is checked."""

    def keep(fn: Callable[[Domain], DataFrame]):
        def run(spark: SparkSession, base: str) -> DataFrame:
            return fn(Domain(spark, base))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_tables(sql)
        return fn

    return keep


def load() -> None:
    """Import every module that registers queries."""
    from siftmap.catalog import (  # noqa: F401
        datasets,
        evidence,
        gaps,
        labeling,
        learning,
        living,
        monitoring,
        registry,
        relational,
        screening,
        streams,
        text,
        vectors,
    )

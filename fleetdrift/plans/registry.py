"""Registry of queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetdrift.plans.fixtures import with_fixtures
from fleetdrift.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query; ``sql`` may use ``{fixture}`` names."""

    def register(function: Query) -> Query:
        key = name or function.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(configure(spark), folder)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_fixtures(sql)
        return function

    return register

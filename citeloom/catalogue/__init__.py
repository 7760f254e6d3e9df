"""Registered queries with the SQL that checks them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL where the result can be stated in SQL."""

    def keep(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def load_all() -> None:
    from citeloom.catalogue import (  # noqa: F401
        conversations,
        corpus,
        evaluation,
        feedback,
        maintenance,
        retrieval,
        streams,
    )

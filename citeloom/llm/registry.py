"""Queries of this subpackage, and the SQL of those that SQL can state."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_all() -> None:
    from citeloom.llm import (  # noqa: F401
        bpe,
        exact_dedup,
        licences,
        lines,
        minhash,
        mixing,
        pii,
        quality,
        repair,
        secrets,
        substrings,
        topk,
        trie,
    )

"""The registry of queries: name -> DataFrame builder, and the DuckDB SQL that says the same."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Collects queries with their oracle SQL; names are unique."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, build: Query, oracle: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = build
        if oracle is not None:
            self.oracles[name] = oracle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; only Spark's readers see the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

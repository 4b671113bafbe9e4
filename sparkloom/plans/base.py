"""Collecting plans by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Book:
    """Registers functions of (table reader) as plans, with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Plan] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        def register(build: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
            name = build.__name__
            self.queries[name] = lambda spark, sf_dir: build(lambda t: table(spark, sf_dir, t))
            if sql:
                self.sql[name] = sql
            return build

        return register

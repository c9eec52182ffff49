"""Registry of queries: name, Spark callable, equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegauge.session import prepare, spread


class Tables:
    """Driver tables of one folder, read on first use as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = prepare(spark)
        self.folder = str(folder).rstrip("/")

    def spread(self, rows: DataFrame) -> DataFrame:
        """The driver's tables are one file with one row group each, so one task would do
        all the work per row; queries with much of it deal the rows out first."""
        return spread(rows, self.spark.sparkContext.defaultParallelism)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of ``Tables`` under its own name."""

    def add(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = function.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add

"""Landed JSON files and CSV reference data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.jsonfields import is_json
from tidegauge.sources import schemas


def read_landing(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None
) -> DataFrame:
    """Landed JSON lines. Without a schema: one ``payload`` string per record.

    Payloads stay text so that a malformed record reaches validation instead of
    failing the load; with a schema the typed columns are read directly.
    """
    if schema is not None:
        return spark.read.schema(schema).json(path)
    return spark.read.text(path).select(F.col("value").alias("payload"))


def reject_bad_payloads(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Split a batch into (usable, rejected); rejected rows carry a ``reason``."""
    reason = (
        F.when(F.col(payload).isNull(), F.lit("missing_payload"))
        .when(~is_json(payload), F.lit("invalid_json"))
    )
    marked = df.withColumn("reason", reason)
    good = marked.filter(F.col("reason").isNull()).drop("reason")
    return good, marked.filter(F.col("reason").isNotNull())


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Taxonomy CSV: header, every column a string, backslashes literal."""
    return (
        spark.read.schema(schemas.TAXONOMY)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def default_taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(schemas.DEFAULT_TAXONOMY, schemas.TAXONOMY)


def read_scan_rules(spark: SparkSession, path: str) -> DataFrame:
    """Scan rules as JSON lines: pattern, description, exceptions."""
    rules = spark.read.schema(schemas.SCAN_RULE).json(path)
    return rules.select(
        "pattern",
        F.coalesce("description", F.lit("Unnamed rule")).alias("description"),
        F.coalesce("exceptions", F.array().cast("array<string>")).alias("exceptions"),
    )

"""Bronze to silver: live records, latest version per key, cleaned text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.jsonfields import json_project
from tidegauge.functions.text import clean_html, text_or_empty
from tidegauge.session import spread

# Newest first; everything after the stamp only makes equal stamps deterministic.
NEWEST_FIRST = ["ingested_at", "load_id", "posted_at", "author", "parent_id", "raw_text"]
SILVER_COLUMNS = [
    "id",
    "author",
    "posted_at",
    "text",
    "full_text",
    "parent_id",
    "load_id",
    "ingested_at",
]


def clean_column(
    df: DataFrame, html: str, out: str, tag_replacement: str = "", partitions: int | None = None
) -> DataFrame:
    """Replace an HTML column by its cleaned text; ``partitions`` spreads the rows first."""
    cleaned = clean_html(html, tag_replacement).alias(out)
    return spread(df, partitions).select(*[c for c in df.columns if c != html], cleaned)


def live_records(df: DataFrame, type_value: str, type_col: str = "type",
                 deleted_col: str = "deleted") -> DataFrame:
    """Rows of one type that are not deleted. A null flag drops the row."""
    return df.filter((F.col(type_col) == type_value) & (F.col(deleted_col) == F.lit(False)))


def latest_by(df: DataFrame, keys: list[str], newest_first: list[str | Column]) -> DataFrame:
    """One row per key: the first in descending order of ``newest_first``.

    Give enough columns to break ties. Spark turns "row number = 1" into a group
    limit that runs before the shuffle, so each task sends at most one row per
    key: a key holding a third of all rows costs the same as any other.
    """
    order = [(F.col(c) if isinstance(c, str) else c).desc() for c in newest_first]
    newest = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("__rank", F.row_number().over(newest))
    return ranked.filter(F.col("__rank") == 1).drop("__rank")


def parse_bronze(bronze: DataFrame) -> DataFrame:
    """Payload fields of the staging model, one JSON parse per row."""
    fields = {
        "id": ("id", "bigint"),
        "type": ("type", "string"),
        "deleted": ("deleted", "boolean"),
        "author": ("by", "string"),
        "posted_at": ("time", "timestamp"),
        "raw_text": ("text", "string"),
        "parent_id": ("parent", "bigint"),
    }
    return json_project(bronze, "payload", fields, keep=["load_id", "ingested_at"])


def newest_versions(bronze: DataFrame, type_value: str = "comment") -> DataFrame:
    """Live records, newest version per id, text not cleaned yet."""
    return latest_by(live_records(parse_bronze(bronze), type_value), ["id"], NEWEST_FIRST)


def clean_versions(versions: DataFrame, tag_replacement: str = "") -> DataFrame:
    """Silver columns of chosen versions."""
    cleaned = versions.withColumn("text", clean_html("raw_text", tag_replacement))
    return cleaned.withColumn("full_text", text_or_empty("text")).select(*SILVER_COLUMNS)


def stage_records(bronze: DataFrame, type_value: str = "comment",
                  tag_replacement: str = "") -> DataFrame:
    """The staging model: live records, newest version per id, cleaned text.

    The live filter runs before the choice of version, so a record deleted in a
    newer load falls back to its last live version. Cleaning runs after it, on
    the surviving versions only.
    """
    return clean_versions(newest_versions(bronze, type_value), tag_replacement)

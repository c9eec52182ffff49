"""The pipeline end to end: threads to bronze, bronze to marts, marts to answers."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import quality
from tidegauge.operators.staging import stage_records
from tidegauge.operators.taxonomy import Term, bridge, dim_terms
from tidegauge.operators.tree import collect_threads, find_threads
from tidegauge.operators.trends import (
    SPINE_START,
    monthly_mentions,
    monthly_totals,
    monthly_trends,
    trends_from_text,
)
from tidegauge.session import work_path
from tidegauge.sources import schemas
from tidegauge.sources.bronze import append_bronze, to_payload
from tidegauge.sources.tables import check_months, current_version, new_version, publish, write_table


@dataclass(frozen=True)
class IngestResult:
    rows: int
    months_found: list[dt.date]
    months_missing: list[dt.date]


def ingest_months(
    users: DataFrame,
    items: DataFrame,
    months: list[dt.date],
    bronze_path: str,
    as_of: dt.date,
    load_id: str | None = None,
    ingested_at: dt.datetime | None = None,
) -> IngestResult:
    """Find the threads of the given months and land them whole, in one load.

    The list of months is the request; only thread ids per month (one row each)
    come back to the driver.
    """
    firsts = check_months(months, as_of)
    # Written once: the search joins all users' lists with all items.
    place = work_path(users.sparkSession, "threads")
    find_threads(users, items, firsts).write.parquet(place)
    threads = users.sparkSession.read.schema("user string, year int, month int, thread_id bigint").parquet(place)
    found = {
        dt.date(r["year"], r["month"], 1)
        for r in threads.select("year", "month").distinct().collect()
    }
    rows = 0
    if found:
        records = collect_threads(items, threads.select("thread_id"))
        rows = append_bronze(to_payload(records), bronze_path, load_id, ingested_at)
    return IngestResult(rows, sorted(found), sorted(set(firsts) - found))


@dataclass(frozen=True)
class Marts:
    silver: DataFrame
    bridge: DataFrame
    dim: DataFrame
    trends: DataFrame


def build_marts(
    bronze: DataFrame,
    taxonomy: DataFrame,
    as_of: dt.date,
    start: dt.date = SPINE_START,
) -> Marts:
    """All tables of the transformation, as plans. Staging makes ids unique, so
    the bridge needs no distinct; the trends count mentions and totals in one pass
    over bronze. ``rebuild`` writes each table before the next one reads it."""
    silver = stage_records(bronze)
    pairs = bridge(silver, taxonomy)
    dim = quality.enforce_contract(dim_terms(taxonomy), schemas.TAXONOMY_DIM)
    trends = trends_of_bronze(bronze, taxonomy, as_of, start)
    return Marts(silver, pairs, dim, quality.enforce_contract(trends, schemas.TRENDS))


def rebuild(spark: SparkSession, bronze: DataFrame, taxonomy: DataFrame, out: str,
            as_of: dt.date, start: dt.date = SPINE_START) -> Marts:
    """Full rebuild of silver, bridge, dimension and trends below ``out``.

    Each table is written before the next one reads it, so the text is parsed,
    deduplicated and cleaned once. All go to a folder of a new version, which is
    published when the last one is whole: until then, and if the rebuild fails,
    ``current_version`` names the version before.
    """
    base = out
    version, out = new_version(base)
    write_table(stage_records(bronze), f"{out}/silver")
    silver = spark.read.parquet(f"{out}/silver")
    write_table(bridge(silver, taxonomy), f"{out}/bridge")
    pairs = spark.read.parquet(f"{out}/bridge")
    dim = quality.enforce_contract(dim_terms(taxonomy), schemas.TAXONOMY_DIM)
    write_table(dim, f"{out}/dim_terms")
    trends = monthly_trends(
        monthly_mentions(pairs, "job_id", "tech_key", "job_posted_at", pairs_unique=True),
        monthly_totals(silver, "id", "posted_at", ids_unique=True),
        dim,
        start,
        as_of,
    )
    write_table(quality.enforce_contract(trends, schemas.TRENDS), f"{out}/trends")
    publish(spark, base, version)
    return read_marts(spark, base)


MART_TABLES = ["silver", "bridge", "dim_terms", "trends"]


def read_marts(spark: SparkSession, out: str) -> Marts:
    """The tables of the version that was published last."""
    folder = current_version(spark, out)
    return Marts(*(spark.read.parquet(f"{folder}/{name}") for name in MART_TABLES))


def trends_of_bronze(bronze: DataFrame, taxonomy: DataFrame | list[Term], as_of: dt.date,
                     start: dt.date = SPINE_START) -> DataFrame:
    """Only the trend mart: no bridge is built, the text is read once."""
    silver = stage_records(bronze)
    return trends_from_text(silver, taxonomy, "posted_at", "full_text", start, as_of)


def check_marts(marts: Marts, bronze: DataFrame, as_of: dt.date,
                start: dt.date = SPINE_START) -> DataFrame:
    """Violations per check over a built set of tables."""
    landed = bronze.select(
        F.get_json_object("payload", "$.id").cast("bigint").alias("id"),
        "load_id",
        "ingested_at",
        F.get_json_object("payload", "$.time").cast("timestamp").alias("landed_at"),
    )
    key_columns = ["id", "load_id", "ingested_at"]
    across = quality.count_violations(
        {
            "silver_not_null": quality.not_null(
                marts.silver, ["id", "author", "posted_at", "text", "full_text"]
            ),
            "silver_unique": quality.unique(marts.silver, ["id"]),
            "silver_conserved": quality.conserved(
                marts.silver, landed, key_columns, "posted_at", "landed_at"
            ),
            "dim_unique": quality.unique(marts.dim, ["tech_key"]),
            "bridge_not_null": quality.not_null(marts.bridge, marts.bridge.columns),
            "bridge_categories": quality.accepted(
                marts.bridge, "tech_category", schemas.CATEGORIES
            ),
            "trends_keys_known": quality.orphans(marts.trends, marts.dim, "tech_key"),
            "trends_complete": quality.spine_gaps(marts.trends, marts.dim, start, as_of),
            "trends_stable": quality.stability(marts.trends, marts.bridge),
        }
    )
    declared = ["month", "tech_key", "tech_name", "mention_count", "total_jobs", "pct_share"]
    return across.unionByName(quality.trend_violations(marts.trends, declared, start, as_of))

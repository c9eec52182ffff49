"""Tables: create-if-missing, rebuilds, month-wise reruns, counts."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.dates import in_months, month_of


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def ensure_table(spark: SparkSession, name: str, schema: T.StructType, path: str | None = None) -> None:
    """Create an empty parquet table unless it exists already."""
    if not table_exists(spark, name):
        spark.catalog.createTable(name, path=path, source="parquet", schema=schema)


def table_count(df: DataFrame) -> int:
    return df.count()


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Full rebuild. ``rebalance`` lets AQE cut a hot partition value over several
    tasks and files and merge the small ones, so one value may hold most rows."""
    if partition_by:
        balanced = df.hint("rebalance", partition_by)
        balanced.write.mode("overwrite").partitionBy(partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def new_version(path: str) -> tuple[str, str]:
    """Name and folder of a version to write below ``path``; names sort by time."""
    now = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    name = f"{now}-{uuid.uuid4().hex[:8]}"
    return name, f"{path}/version-{name}"


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Make a finished version the current one: one small file, committed last.

    Readers of an older version keep their files; a rebuild that fails is never published.
    """
    row = spark.createDataFrame([(version,)], "version string")
    row.coalesce(1).write.mode("append").parquet(f"{path}/published")


def current_version(spark: SparkSession, path: str) -> str:
    """Folder of the version published last."""
    published = spark.read.schema("version string").parquet(f"{path}/published")
    return f"{path}/version-{published.agg(F.max('version')).first()[0]}"


def retire_versions(spark: SparkSession, path: str, keep: int, tables: list[str]) -> list[str]:
    """Empty the tables of all published versions but the newest ``keep``; their names."""
    if keep < 1:
        raise ValueError("the current version must stay")
    published = spark.read.schema("version string").parquet(f"{path}/published")
    old = [r["version"] for r in published.distinct().orderBy(F.desc("version")).offset(keep).collect()]
    for version in old:
        for table in tables:
            spark.range(0).write.mode("overwrite").parquet(f"{path}/version-{version}/{table}")
    return old


def check_months(months: list[dt.date], as_of: dt.date) -> list[dt.date]:
    """First days of the requested months; a future month is an error."""
    firsts = [m.replace(day=1) for m in months]
    future = [m for m in firsts if m > as_of.replace(day=1)]
    if future:
        raise ValueError(f"months in the future: {[m.isoformat() for m in future]}")
    return firsts


def run_partitions(
    df: DataFrame,
    timestamp: str,
    months: list[dt.date],
    transform: Callable[[DataFrame], DataFrame],
    as_of: dt.date,
) -> DataFrame:
    """Run ``transform`` over the rows of the given months, in one job.

    ``transform`` sees a ``month`` column and must treat months independently.
    The raw column is filtered by range as well, which reaches the file scan.
    """
    firsts = check_months(months, as_of)
    if not firsts:
        return transform(df.withColumn("month", month_of(timestamp)).filter(F.lit(False)))
    stamp_type = df.schema[timestamp].dataType
    pruned = df.filter(in_months(timestamp, stamp_type, min(firsts), max(firsts)))
    selected = pruned.withColumn("month", month_of(timestamp)).filter(F.col("month").isin(firsts))
    return transform(selected)


def write_months(df: DataFrame, path: str, month: str = "month") -> None:
    """Replace the months present in ``df`` and leave all others as they are."""
    (
        df.hint("rebalance", month)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(month)
        .parquet(path)
    )

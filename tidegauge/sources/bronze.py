"""The append-only landing table: ``load_id, ingested_at, payload``."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidegauge.sources import schemas

_JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def to_payload(df: DataFrame) -> DataFrame:
    """One JSON payload per row: nulls are written, stamps are ISO with microseconds."""
    return df.select(F.to_json(F.struct("*"), _JSON_OPTIONS).alias("payload"))


def micros_of(stamp: dt.datetime | None) -> int:
    """Epoch micros of a stamp (now, if none): no driver time zone is involved; naive stamps are UTC."""
    if stamp is None:
        stamp = dt.datetime.now(dt.timezone.utc)
    elif stamp.tzinfo is None:
        stamp = stamp.replace(tzinfo=dt.timezone.utc)
    return int(stamp.timestamp()) * 1_000_000 + stamp.microsecond


def append_bronze(
    df: DataFrame,
    path: str,
    load_id: str | None = None,
    ingested_at: dt.datetime | None = None,
    replace_load: bool = False,
) -> int:
    """Append a batch of payloads; returns the number of rows written.

    The whole batch carries one ``load_id`` and one UTC timestamp. How it becomes visible
    is the committer's affair: the default one renames file by file, so a reader at that
    moment may see part of a load (``ledger.commit_load`` has none of that). A load may be appended in several
    batches; with ``replace_load`` the load's earlier rows are replaced instead,
    which makes a retried batch safe. The count comes from the write itself.
    """
    load_id = load_id or str(uuid.uuid4())
    written = Observation()
    rows = df.select(
        F.lit(load_id).alias("load_id"),
        F.timestamp_micros(F.lit(micros_of(ingested_at))).alias("ingested_at"),
        F.col("payload").cast("string").alias("payload"),
    ).observe(written, F.count(F.lit(1)).alias("rows"))
    writer = rows.write.partitionBy("load_id")
    if replace_load:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode("append")
    writer.parquet(path)
    return written.get["rows"]


def read_bronze(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Scan of the landing table; only the named columns are read."""
    names = columns or schemas.BRONZE.names
    return spark.read.schema(schemas.BRONZE).parquet(path).select(*names)


def load_stats(bronze: DataFrame, is_tombstone: str = "is_tombstone") -> DataFrame:
    """Items and tombstones per load, from a bronze table or typed records.

    The stored flag is read out of the payload unless it is already a column.
    """
    if is_tombstone in bronze.columns:
        flag = F.col(is_tombstone)
    else:
        flag = F.get_json_object("payload", f"$.{is_tombstone}") == "true"
    return bronze.groupBy("load_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count_if(flag).alias("tombstone_count"),
    )

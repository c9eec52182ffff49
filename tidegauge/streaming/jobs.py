"""Incremental jobs: landed files to bronze, bronze to the latest silver version.

Both run on Structured Streaming with ``foreachBatch``; a batch writes only to a
place named after its id, so a batch repeated after a failure replaces itself.
An output folder and its checkpoint folder belong together.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.operators.staging import NEWEST_FIRST, clean_versions, latest_by, newest_versions
from tidegauge.sources import schemas
from tidegauge.sources.bronze import append_bronze

VERSIONS = (
    "id bigint, type string, deleted boolean, author string, posted_at timestamp, "
    "raw_text string, parent_id bigint, load_id string, ingested_at timestamp"
)


def start_batches(stream: DataFrame, on_batch, checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    if interval:
        return writer.trigger(processingTime=interval).start()
    return writer.trigger(availableNow=True).start()


def bronze_stream(spark: SparkSession, bronze: str, max_files: int | None = None) -> DataFrame:
    """Rows of a bronze folder, as they land."""
    reader = spark.readStream.schema(schemas.BRONZE).format("parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(bronze)


def stream_bronze(
    spark: SparkSession,
    landing: str,
    out: str,
    checkpoint: str,
    *,
    load_prefix: str = "stream",
    ingested_at: dt.datetime | None = None,
    max_files: int | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Append landed JSON lines to bronze, one ``load_id`` per micro-batch."""
    reader = spark.readStream.schema("value string").format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    payloads = reader.load(landing).select(F.col("value").alias("payload"))

    def land(batch: DataFrame, batch_id: int) -> None:
        append_bronze(batch, out, f"{load_prefix}-{batch_id}", ingested_at, replace_load=True)

    return start_batches(payloads, land, checkpoint, interval)


def stream_latest(
    spark: SparkSession,
    bronze: str,
    out: str,
    checkpoint: str,
    *,
    type_value: str = "comment",
    max_files: int | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Keep the newest live version per id, increment by increment.

    A batch writes the newest versions among its own rows; ``read_latest`` picks
    the newest over all batches, so late arrivals of older versions lose by their
    stamp. Nothing already written is rewritten until ``compact_latest``.
    """
    rows = bronze_stream(spark, bronze, max_files)

    def fold(batch: DataFrame, batch_id: int) -> None:
        versions = newest_versions(batch, type_value)
        versions.write.mode("overwrite").parquet(f"{out}/delta/batch={batch_id}")
        _commit(spark, out, "delta", batch_id)

    return start_batches(rows, fold, checkpoint, interval)


COMMITTED = "kind string, number bigint"


def _commit(spark: SparkSession, out: str, kind: str, number: int) -> None:
    """Note that a folder is whole; noting it twice changes nothing."""
    row = spark.createDataFrame([(kind, number)], COMMITTED)
    row.coalesce(1).write.mode("append").parquet(f"{out}/committed")


def _finished(spark: SparkSession, out: str, kind: str, name: str) -> dict[int, str]:
    """Committed folders ``<kind>/<name>=<number>``, by number."""
    try:
        committed = spark.read.schema(COMMITTED).parquet(f"{out}/committed")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    numbers = committed.filter(F.col("kind") == kind).select("number").distinct().collect()
    return {r["number"]: f"{out}/{kind}/{name}={r['number']}" for r in numbers}


def _versions(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    bases = _finished(spark, out, "base", "upto")
    base = max(bases, default=-1)
    deltas = {
        n: path
        for n, path in _finished(spark, out, "delta", "batch").items()
        if n > base and (upto is None or n <= upto)
    }
    paths = ([bases[base]] if base >= 0 else []) + list(deltas.values())
    if not paths:
        return spark.createDataFrame([], VERSIONS)
    rows = spark.read.schema(VERSIONS).parquet(*paths)
    return latest_by(rows, ["id"], NEWEST_FIRST) if deltas else rows


def read_latest(spark: SparkSession, out: str, tag_replacement: str = "") -> DataFrame:
    """The silver table as of the last committed batch."""
    return clean_versions(_versions(spark, out), tag_replacement)


def compact_latest(spark: SparkSession, out: str) -> int | None:
    """Fold all committed batches into a new base; returns the last batch folded.

    The base is named after that batch and counts once it is noted as committed,
    so readers switch to it at once; folders it replaces are left to retention.
    """
    deltas = _finished(spark, out, "delta", "batch")
    if not deltas:
        return None
    last = max(deltas)
    if last not in _finished(spark, out, "base", "upto"):
        versions = _versions(spark, out, upto=last)
        versions.write.mode("overwrite").parquet(f"{out}/base/upto={last}")
        _commit(spark, out, "base", last)
    return last


def run_to_end(*queries: StreamingQuery) -> None:
    """Wait for ``availableNow`` jobs, in the order given."""
    reduce(lambda _, q: q.awaitTermination(), queries, None)

"""Loads that are there as a whole or not at all.

A load is written to a folder of its own, one that nobody reads. Only when its last file
is in place a row of the ledger names it, and readers read the folders that the ledger
names. The ledger is a table of versions: each is the whole list of folders and lies below
a number; it counts once its commit marker is there, and the highest such number is the
ledger. So a load that fails half way, and a compaction that does, change nothing.

Appending a load that the ledger holds already does nothing (a retried load); with
``replace`` its rows are exchanged in one step. Writers to one table must take turns: a
version that another writer has committed in the meantime is an error, not a lost load.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.dates import month_of
from tidegauge.sources import schemas
from tidegauge.sources.bronze import micros_of
from tidegauge.sources.tables import check_months

LEDGER = "load_id string, folder string, rows bigint, committed_at timestamp"
# Loads of fewer rows than this are put together by ``compact_loads``, up to so many rows.
SMALL_ROWS = 1_000_000


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The loads of a table: one row per load and folder that holds rows of it."""
    return _version(spark, path)[1]


def _version(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    try:
        every = spark.read.schema(f"{LEDGER}, version bigint").parquet(f"{path}/ledger")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, spark.createDataFrame([], LEDGER)
    last = every.agg(F.max("version")).first()[0]
    if last is None:
        return 0, spark.createDataFrame([], LEDGER)
    names = ["load_id", "folder", "rows", "committed_at"]
    return last, every.filter((F.col("version") == last) & F.col("folder").isNotNull()).select(*names)


def _commit(spark: SparkSession, path: str, seen: int, rows: DataFrame) -> None:
    """The next version of the ledger, in one file: it is renamed into place as a whole.

    The job fails if that version exists. A row without a folder stands for an empty list.
    """
    none = spark.createDataFrame([(None, None, None, None)], LEDGER)
    entries = rows.unionByName(none).coalesce(1)
    entries.write.mode("errorifexists").parquet(f"{path}/ledger/version={seen + 1}")


def commit_load(
    payloads: DataFrame,
    path: str,
    load_id: str | None = None,
    ingested_at: dt.datetime | None = None,
    replace: bool = False,
) -> int:
    """Append a batch of payloads as one load; returns its rows (0 if it was there).

    All rows carry the load's id and one UTC stamp.
    """
    spark = payloads.sparkSession
    load_id = load_id or str(uuid.uuid4())
    seen, loads = _version(spark, path)
    known = not loads.filter(F.col("load_id") == load_id).isEmpty()
    if known and not replace:
        return 0
    stamp = F.timestamp_micros(F.lit(micros_of(ingested_at)))
    written = Observation()
    rows = payloads.select(
        F.lit(load_id).alias("load_id"), stamp.alias("ingested_at"), F.col("payload").cast("string").alias("payload")
    ).observe(written, F.count(F.lit(1)).alias("rows"))
    folder = f"load-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/loads/{folder}")
    count = written.get["rows"]
    entry = spark.createDataFrame([(load_id, folder, count)], "load_id string, folder string, rows bigint")
    kept = loads.filter(F.col("load_id") != load_id)
    _commit(spark, path, seen, kept.unionByName(entry.withColumn("committed_at", F.current_timestamp())))
    return count


def _folder_names(loads: DataFrame) -> list[str]:
    """Folders that hold rows; their number is bounded by compaction, not by rows."""
    return sorted(r["folder"] for r in loads.filter("rows > 0").select("folder").distinct().collect())


def read_loads(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All rows of all committed loads; only the named columns are read.

    Of a folder that holds several loads, those count that the ledger names with it.
    """
    names = columns or schemas.BRONZE.names
    loads = ledger(spark, path)
    folders = _folder_names(loads)
    if not folders:
        return spark.createDataFrame([], schemas.BRONZE).select(*names)
    return spark.read.schema(schemas.BRONZE).parquet(*(f"{path}/loads/{f}" for f in folders)).select(*names)


def compact_loads(spark: SparkSession, path: str, small: int = SMALL_ROWS) -> int:
    """Put small folders together, first come first packed; returns how many went.

    A bin takes folders until it holds ``small`` rows. The new list is one version of the
    ledger: readers see the old folders or the new ones. Old ones are left to retention.
    """
    seen, loads = _version(spark, path)
    sizes = loads.filter("rows > 0").groupBy("folder").agg(F.sum("rows").alias("rows"), F.min("committed_at").alias("at"))
    bins: list[tuple[int, list[str]]] = []
    for row in sizes.filter(F.col("rows") < small).orderBy("at", "folder").collect():
        if bins and bins[-1][0] + row["rows"] <= small:
            bins[-1] = (bins[-1][0] + row["rows"], [*bins[-1][1], row["folder"]])
        else:
            bins.append((row["rows"], [row["folder"]]))
    moved = {}
    for _, folders in bins:
        if len(folders) > 1:
            target = f"load-{uuid.uuid4().hex}"
            paths = [f"{path}/loads/{folder}" for folder in folders]
            spark.read.schema(schemas.BRONZE).parquet(*paths).coalesce(1).write.parquet(f"{path}/loads/{target}")
            moved |= dict.fromkeys(folders, target)
    if moved:
        new = spark.createDataFrame([*moved.items()], "folder string, target string")
        entries = loads.join(new, "folder", "left").withColumn("folder", F.coalesce("target", "folder")).drop("target")
        _commit(spark, path, seen, entries)
    return len(moved)


MONTHS = "month date, state string, attempt bigint, reason string"
ASKED, DONE, FAILED = "asked", "done", "failed"


def month_states(spark: SparkSession, path: str) -> DataFrame:
    """The last state of every month that a backfill was asked for."""
    try:
        every = spark.read.schema(MONTHS).parquet(f"{path}/months")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MONTHS)
    order = F.struct("attempt", (F.col("state") != ASKED).alias("ended"))
    last = every.groupBy("month").agg(F.max_by(F.struct("state", "attempt", "reason"), order).alias("last"))
    return last.select("month", "last.*")


def backfill_months(
    df: DataFrame,
    timestamp: str,
    months: list[dt.date],
    transform: Callable[[DataFrame], DataFrame],
    path: str,
    as_of: dt.date,
    again: bool = False,
) -> DataFrame:
    """Run every asked month by itself and commit it by itself; returns their states.

    A month lands in a folder of its own and counts once its state says done; one that
    fails leaves the others as they are and says why. Months that are done are skipped, so
    a backfill that was stopped goes on where it was (``again`` runs them anew). Rows of a
    month are found by range, which reaches the file scan.
    """
    spark = df.sparkSession
    states = {r["month"]: (r["state"], r["attempt"]) for r in month_states(spark, path).collect()}
    for first in sorted(set(check_months(months, as_of))):
        state, attempt = states.get(first, (None, 0))
        if state == DONE and not again:
            continue
        _note(spark, path, first, ASKED, attempt + 1)
        after = (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
        inside = df.filter((F.col(timestamp) >= F.lit(first)) & (F.col(timestamp) < F.lit(after)))
        try:
            rows = transform(inside.withColumn("month", month_of(timestamp)))
            rows.write.mode("overwrite").parquet(f"{path}/data/month={first}/attempt={attempt + 1}")
        except Exception as failure:  # whatever a transformation raises concerns its month only
            _note(spark, path, first, FAILED, attempt + 1, str(failure)[:500])
        else:
            _note(spark, path, first, DONE, attempt + 1)
    return month_states(spark, path)


def _note(spark: SparkSession, path: str, month: dt.date, state: str, attempt: int, reason: str | None = None) -> None:
    row = spark.createDataFrame([(month, state, attempt, reason)], MONTHS)
    row.coalesce(1).write.mode("append").parquet(f"{path}/months")


def read_months(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The landed rows of all months that are done, from the attempt that was."""
    done = month_states(spark, path).filter(F.col("state") == DONE).select("month", "attempt").collect()
    if not done:
        return spark.createDataFrame([], schema)
    places = [f"{path}/data/month={r['month']}/attempt={r['attempt']}" for r in done]
    return spark.read.schema(schema).parquet(*places)

"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Settings every job of this library expects. Sizes (shuffle partitions, memory)
# belong to the cluster and are left alone.
EXPECTED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows are whole texts: batches on the way to and from Python stay small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on and return the session."""
    for key, value in EXPECTED_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "tidegauge", **conf: str) -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**EXPECTED_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A machine-local folder is chosen only in local mode, where the setting is
    usually absent; on a cluster a missing setting is an error, because files
    written by one executor must outlive it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    already_set = context.getCheckpointDir()
    if already_set:
        return already_set.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidegauge-"))
    return context.getCheckpointDir().rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is ever reused between runs."""
    return f"{shared_dir(spark)}/tidegauge/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Deal the rows out evenly before expensive work per row, if the caller asks for it.

    Meant for a table that arrives as one file with one row group, hence as one task. It
    costs a shuffle of all columns; larger inputs have splits enough.
    """
    return df if partitions is None else df.repartition(partitions)


class Scratch:
    """Intermediate tables in the shared folder, emptied when the block ends.

    Several rounds of a table lie in one folder and are read as one relation with a
    ``round`` column, so a plan over them does not grow with the rounds.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.tables = spark, work_path(spark, name), set()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        nothing = self.spark.range(0)
        for table in self.tables:
            nothing.write.mode("overwrite").parquet(f"{self.path}/{table}")

    def write(self, rows: DataFrame, table: str, counted: Column | None = None, round_: int | None = None) -> tuple[DataFrame, int]:
        """Write rows and read the table back (all its rounds), with the number of rows
        just written (of those where ``counted`` holds), taken from the write itself."""
        seen, place = Observation(), f"{self.path}/{table}"
        number = F.count(F.lit(1)) if counted is None else F.count_if(counted)
        self.tables.add(table)
        rows.observe(seen, number.alias("n")).write.parquet(place if round_ is None else f"{place}/round={round_}")
        schema = rows.schema if round_ is None else T.StructType([*rows.schema.fields]).add("round", "integer")
        return self.spark.read.schema(schema).parquet(place), seen.get["n"]

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.session import prepare, work_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage is cut, and an executor that dies later loses nothing: the files
    lie where all executors can reach them.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table of one folder; a missing or other column is left to the caller."""
    return prepare(spark).read.parquet(f"{str(folder).rstrip('/')}/{name}.parquet")


def crc32_of(value: Column) -> Column:
    """Unsigned CRC-32 of a value written as text (long; null for null)."""
    return F.crc32(value.cast("string").cast("binary"))


def lettered(value: Column) -> Column:
    """True where a text has a letter of any script; null counts as no text."""
    return F.coalesce(value.rlike(r"\p{L}"), F.lit(False))


def least_keys(rows: DataFrame, group: str, key: str, most: int) -> dict:
    """For each value of ``group`` the largest of its ``most`` least distinct keys.

    The groups must be few. Ranks are cut within each task before the shuffle.
    """
    ranked = rows.select(group, key).distinct().withColumn(
        "rank_", F.row_number().over(Window.partitionBy(group).orderBy(key))
    )
    found = ranked.filter(F.col("rank_") <= most).groupBy(group).agg(F.max(key).alias("most_"))
    return {row[0]: row["most_"] for row in found.collect()}


def numbered(rows: DataFrame, order: list[str], number: str, name: str) -> DataFrame:
    """Rows with their place in a sorted order, from zero and without gaps.

    Every sorted partition numbers its rows; the sizes of the partitions, one number each,
    give where it starts. The order should be unique, so that no partition is a lump.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*rows.schema.fields]).add("part__", "integer").add("within__", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            within = pa.array(range(seen, seen + batch.num_rows), pa.int64())
            seen += batch.num_rows
            here = pa.array([part] * batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, here, within], names=schema.names)

    found = stored(ordered.mapInArrow(run, schema), name)
    starts, before = [], 0
    for part, count in sorted(map(tuple, found.groupBy("part__").count().collect())):
        starts.append((part, before))
        before += count
    offsets = rows.sparkSession.createDataFrame(starts, "part__ int, start__ long")
    joined = found.join(offsets, "part__").withColumn(number, F.col("start__") + F.col("within__"))
    return joined.select(*rows.columns, number)

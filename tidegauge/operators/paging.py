"""Pages of a sorted table by number: a table of counts says which ranges hold a page.

The rows are written once, sorted, in parts of one file each; within a part every so many rows
are a range, numbered by place. A page then reads the ranges that hold it, and one task sorts no
more than these, however deep the page is. Files, tasks and counts grow with the parts, not with
the ranges. Equal values of the order may lie in two ranges of a part, so the order must be
total, as for any paging.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a range has: what a page reads, besides its own, at either end.
RANGE_ROWS = 100_000
# Rows a part should have: what one task sorts and writes as one file.
PART_ROWS = 500_000

_PART, _RANGE = "part__", "range__"


def write_ordered(
    df: DataFrame, path: str, order: Sequence[str | Column], range_rows: int = RANGE_ROWS
) -> int:
    """Write a table in ranges of ``order`` with their counts; returns the number of rows.

    Nulls come first, as in ``orderBy``. Bounds of parts are sampled, so parts are of about
    equal size only; their ranges have ``range_rows`` rows each, the last one what is left.
    """
    if range_rows < 1:
        raise ValueError("a range must hold rows")
    total = df.count()
    parts = max(1, -(-total // max(range_rows, PART_ROWS)))
    spark, rows = df.sparkSession, f"{path}/rows"
    cut = df.repartitionByRange(parts, *order).withColumn(_PART, F.spark_partition_id())
    # Of an id, the lower 33 bits are the row's place in its part.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut.sortWithinPartitions(_PART, *order).withColumn(_RANGE, F.floor(place / range_rows))
    # Pages of the file about as long as a range: what lies beside them is not decoded.
    written = placed.write.option("parquet.page.row.count.limit", min(max(range_rows, 1000), 20_000))
    written.mode("overwrite").partitionBy(_PART).parquet(rows)
    df.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    counts = _rows(spark, path).groupBy(_PART).agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.withColumn("range_rows", F.lit(range_rows).cast("long"))
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")
    return total


def _rows(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(schema.add(_RANGE, "long").add(_PART, "integer")).parquet(f"{path}/rows")


def indexed_page(
    spark: SparkSession, path: str, order: Sequence[str | Column], limit: int, offset: int = 0
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a table from ``write_ordered``, same order.

    The counts that come to the driver are one row a part.
    """
    if limit < 0:
        raise ValueError("limit must be non-negative")
    if offset < 0:
        raise ValueError("offset must be non-negative")
    before, skipped, holding = 0, 0, []
    for row in spark.read.parquet(f"{path}/counts").orderBy(_PART).collect():
        start, stop = max(offset - before, 0), min(offset + limit - before, row["rows"])
        if start < stop:
            first, last = start // row["range_rows"], (stop - 1) // row["range_rows"]
            if not holding:
                skipped = start - first * row["range_rows"]
            holding.append((row[_PART], first, last))
        before += row["rows"]
    rows, part, place = _rows(spark, path), F.col(_PART), F.col(_RANGE)
    if not holding:
        found = rows.filter(F.lit(False))
    else:
        # Parts between the first and the last are read as a whole.
        pieces = [(part == p) & place.between(a, b) for p, a, b in dict.fromkeys([holding[0], holding[-1]])]
        if len(holding) > 2:
            pieces.append((part > holding[0][0]) & (part < holding[-1][0]))
        found = reduce(DataFrame.unionAll, [rows.filter(piece) for piece in pieces])
    return found.drop(_PART, _RANGE).orderBy(*order).offset(skipped).limit(limit)


def indexed_total(spark: SparkSession, path: str) -> int:
    """Number of rows, from the counts alone."""
    return spark.read.parquet(f"{path}/counts").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

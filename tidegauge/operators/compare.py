"""Comparing two tables by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.metrics import abs_diff, pct_diff

# Buckets of keys whose digests are compared before any row is.
DIGEST_BUCKETS = 4096


def reconcile(
    actual: DataFrame,
    source: DataFrame,
    keys: list[str],
    actual_col: str,
    source_col: str,
    max_abs: float = 1,
    max_pct: float = 1.0,
) -> DataFrame:
    """Keys whose two aggregates differ by more than ``max_abs`` or ``max_pct`` percent.

    Both sides must be aggregated to one row per key first; a key on one side
    only counts as zero on the other.
    """
    joined = actual.select(*keys, F.col(actual_col).alias("__a")).join(
        source.select(*keys, F.col(source_col).alias("__s")), keys, "full"
    )
    compared = joined.select(
        *keys,
        F.coalesce("__s", F.lit(0)).alias("source_count"),
        F.coalesce("__a", F.lit(0)).alias("mart_count"),
        abs_diff(F.col("__a"), F.col("__s")).alias("abs_diff"),
        pct_diff(F.col("__a"), F.col("__s")).alias("pct_diff"),
    )
    return compared.filter(
        (F.col("abs_diff") > max_abs) | F.coalesce(F.col("pct_diff") > max_pct, F.lit(False))
    )


def missing_keys(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct expected keys that the other table does not have.

    Keys are made distinct on both sides before the join: tasks send each key
    once, however often it occurs.
    """
    known = actual.select(*keys).distinct()
    return expected.select(*keys).distinct().join(known, keys, "left_anti")


def _row_digest(keys: list[str], columns: list[str]) -> list[Column]:
    """Two order-free digests of rows and their number, as aggregates.

    Hashes leave nulls out, so flags say where they are.
    """
    cells = [F.col(c) for c in (*keys, *columns)] + [F.col(c).isNull() for c in (*keys, *columns)]
    return [
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.xxhash64(*cells).cast("decimal(38,0)")).alias("wide"),
        F.sum(F.hash(*cells).cast("bigint")).alias("narrow"),
    ]


def changed_keys(
    actual: DataFrame,
    source: DataFrame,
    keys: list[str],
    columns: list[str],
    buckets: int = DIGEST_BUCKETS,
) -> DataFrame:
    """Keys whose rows differ between two tables, with ``change``: added, removed or changed.

    Each side is summed up to one digest per bucket of keys first; tasks send one row a
    bucket. Only buckets whose digests differ (their numbers come to the driver) are read
    again and compared by key, so equal tables shuffle no row. Null keys are a key; several
    rows of a key are compared as a whole, in any order. Two different buckets pass for
    equal if 96 bits of digests and their counts agree.
    """
    if buckets < 1:
        raise ValueError("at least one bucket is needed")
    cells = [F.col(k) for k in keys] + [F.col(k).isNull() for k in keys]
    number = F.pmod(F.xxhash64(*cells), F.lit(buckets)).cast("int").alias("bucket__")
    sides = [side.select(*keys, *columns, number) for side in (actual, source)]
    digests = [side.groupBy("bucket__").agg(*_row_digest(keys, columns)) for side in sides]
    # A bucket is equal if both sides have it with the same digest: two rows in one group.
    groups = digests[0].unionByName(digests[1]).groupBy("bucket__", "rows", "wide", "narrow")
    unequal = groups.agg(F.count(F.lit(1)).alias("sides")).filter("sides = 1")
    open_ = [r["bucket__"] for r in unequal.select("bucket__").distinct().collect()]
    flagged = [side.filter(F.col("bucket__").isin(open_)).withColumn("side__", F.lit(i)) for i, side in enumerate(sides)]
    per_side = flagged[0].unionByName(flagged[1]).groupBy(*keys, "side__").agg(*_row_digest(keys, columns))
    digest = F.struct("rows", "wide", "narrow")
    both = per_side.groupBy(*keys).agg(
        F.max(F.when(F.col("side__") == 0, digest)).alias("actual__"), F.max(F.when(F.col("side__") == 1, digest)).alias("source__")
    )
    change = (
        F.when(F.col("source__").isNull(), "added").when(F.col("actual__").isNull(), "removed").otherwise("changed")
    )
    return both.filter(~F.col("actual__").eqNullSafe(F.col("source__"))).select(*keys, change.alias("change"))

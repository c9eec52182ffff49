"""Connected components by alternating star contractions, after Kiveris et al. (2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import stored

MAX_ROUNDS = 64


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least v of each u; minima are taken before the shuffle."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        _with_least(both)
        .filter("v > u")
        .select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    joined = _with_least(edges)
    own = joined.select("u", F.col("least").alias("v"))
    others = joined.filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return own.union(others).distinct()


def _mark(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def stars(edges: DataFrame, name: str = "components") -> DataFrame:
    """Of edges (u, v) of longs: each node (u) with the least node (v) of its component.

    The least node itself has no row. Every round is a table in the shared folder; the
    rounds grow with the logarithm of the longest path. Loops, repeated edges and
    nulls change nothing.
    """
    ordered = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = stored(ordered.distinct(), name)
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        now = stored(_small_star(_large_star(now)), name)
        before, mark = mark, _mark(now)
        if before == mark:
            return now
    raise RuntimeError("components did not settle")

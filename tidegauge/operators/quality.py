"""Data-quality checks. Each returns the violating rows; no rows means passed."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.metrics import safe_share
from tidegauge.operators.compare import missing_keys, reconcile
from tidegauge.operators.trends import dense_grid, lagged, monthly_mentions

# Fixed value: days after which a source counts as stale.
STALE_AFTER_DAYS = 35


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns holding nulls, with their number: one pass for all columns."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_rows")) for c in columns]
    )
    return counts.select(F.inline(rows)).filter(F.col("null_rows") > 0)


def unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """Key values that occur more than once, with their number."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    counts = df.filter(present).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.filter(F.col("n_rows") > 1)


def accepted(df: DataFrame, column: str, values: list) -> DataFrame:
    """Values outside the accepted list, with their number; null passes."""
    outside = df.filter(~F.col(column).isin(values))
    return outside.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def enforce_contract(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame with its columns in declared order; raises unless names and types match."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema}
    declared = {f.name: f.dataType.simpleString() for f in schema}
    if actual != declared:
        wrong = sorted(
            f"{n}: {actual.get(n, 'absent')} instead of {declared.get(n, 'absent')}"
            for n in actual.keys() | declared.keys()
            if actual.get(n) != declared.get(n)
        )
        raise ValueError("contract broken: " + "; ".join(wrong))
    return df.select(*schema.names)


def freshness(
    df: DataFrame, column: str, as_of: dt.datetime, days: int = STALE_AFTER_DAYS
) -> DataFrame:
    """One row when the newest stamp is more than ``days`` old, or there is none.

    ``as_of`` is UTC unless it carries a zone of its own.
    """
    kind = df.schema[column].dataType.simpleString()
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(dt.timezone.utc).replace(tzinfo=None)
    # As text: a datetime literal would be read in the driver machine's zone.
    oldest_fresh = F.lit(str(as_of - dt.timedelta(days=days))).cast(kind)
    newest = df.agg(F.max(column).alias("newest"))
    return newest.filter(F.col("newest").isNull() | (F.col("newest") < oldest_fresh))


def recency(trends: DataFrame, as_of: dt.date) -> DataFrame:
    """The last complete month, when it has no records at all."""
    last = as_of.replace(day=1) - dt.timedelta(days=1)
    month = last.replace(day=1)
    found = trends.filter(F.col("month") == F.lit(month)).agg(
        F.max("total_jobs").alias("max_total_jobs")
    )
    return found.select(F.lit(month).alias("month"), "max_total_jobs").filter(
        F.col("max_total_jobs").isNull() | (F.col("max_total_jobs") == 0)
    )


def stability(trends: DataFrame, pairs: DataFrame, id_col: str = "job_id", key: str = "tech_key",
              timestamp: str = "job_posted_at") -> DataFrame:
    """Mart counts that drifted from the bridge they were computed from."""
    source = monthly_mentions(pairs, id_col, key, timestamp)
    mart = trends.filter(F.col("mention_count") > 0).select("month", key, "mention_count")
    return reconcile(
        mart,
        source.withColumnRenamed("mention_count", "source_mentions"),
        ["month", key],
        "mention_count",
        "source_mentions",
    )


def _early_growth(start: dt.date) -> Column:
    first = start.replace(day=1)
    return ((F.col("month") == F.lit(first)) & F.col("mom_growth_pct").isNotNull()) | (
        (F.col("month") < F.lit(first.replace(year=first.year + 1)))
        & F.col("yoy_growth_pct").isNotNull()
    )


def _growth_over_zero() -> Column:
    """Over rows with the lagged shares."""
    return ((F.col("pct_share_lag_1") == 0) & F.col("mom_growth_pct").isNotNull()) | (
        (F.col("pct_share_lag_12") == 0) & F.col("yoy_growth_pct").isNotNull()
    )


def _wrong_share() -> Column:
    share = F.col("pct_share")
    expected = safe_share(F.col("mention_count"), F.col("total_jobs"))
    return share.isNull() | ~share.between(0.0, 1.0) | (share != expected)


def growth_null_head(trends: DataFrame, start: dt.date, key: str = "tech_key") -> DataFrame:
    """Growth values where no earlier period exists: the first month, the first year."""
    return trends.filter(_early_growth(start)).select("month", key, "mom_growth_pct", "yoy_growth_pct")


def growth_null_zero(trends: DataFrame, key: str = "tech_key") -> DataFrame:
    """Growth values over a zero share."""
    shares = lagged(trends, key, "month", "pct_share", [1, 12])
    return shares.filter(_growth_over_zero()).select(
        "month",
        key,
        F.col("pct_share_lag_1").alias("prev_month_share"),
        "mom_growth_pct",
        F.col("pct_share_lag_12").alias("prev_year_share"),
        "yoy_growth_pct",
    )


def orphans(fact: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """Fact keys without a dimension row, with the number of rows behind each.

    The fact is aggregated by key before the join: a hot key is one row by then.
    """
    counts = (
        fact.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    )
    known = dim.select(F.col(dim_key or key).alias(key)).distinct()
    return counts.join(known, key, "left_anti")


def spine_gaps(trends: DataFrame, dim: DataFrame, start: dt.date, end: dt.date,
               key: str = "tech_key") -> DataFrame:
    """Months a key has no row for."""
    return missing_keys(dense_grid(dim.select(key), start, end), trends, ["month", key])


def bounds(trends: DataFrame, key: str = "tech_key") -> DataFrame:
    """Shares outside 0..1 or different from count over total."""
    return trends.filter(_wrong_share()).select("month", key, "mention_count", "total_jobs", "pct_share")


def conserved(silver: DataFrame, bronze: DataFrame, keys: list[str], silver_col: str,
              bronze_col: str) -> DataFrame:
    """Silver values different from those of the bronze row they came from.

    ``keys`` must name the bronze version (id and load), not the id alone. A
    version landed twice is compared once.
    """
    landed = bronze.select(*keys, F.col(bronze_col).alias("bronze_value")).distinct()
    return (
        silver.select(*keys, F.col(silver_col).alias("silver_value"))
        .join(landed, keys, "left")
        .filter(~F.col("silver_value").eqNullSafe(F.col("bronze_value")))
    )


def residual_tags(df: DataFrame, column: str) -> DataFrame:
    """Rows whose cleaned text still holds something shaped like a tag."""
    return df.filter(F.col(column).rlike("<[^>]+>"))


def trend_violations(
    trends: DataFrame, columns: list[str], start: dt.date, as_of: dt.date, key: str = "tech_key"
) -> DataFrame:
    """The checks of the trend mart that need no other table, counted in one scan.

    ``check_name, violations``, with the numbers of rows that ``not_null`` (over ``columns``),
    ``bounds``, ``growth_null_head``, ``growth_null_zero`` and ``recency`` would return.
    """
    last = (as_of.replace(day=1) - dt.timedelta(days=1)).replace(day=1)
    newest = F.max(F.when(F.col("month") == F.lit(last), F.col("total_jobs")))
    holes = reduce(lambda a, b: a + b, [(F.count_if(F.col(c).isNull()) > 0).cast("bigint") for c in columns])
    counts = {
        "trends_not_null": holes,
        "trends_bounds": F.count_if(_wrong_share()),
        "growth_head": F.count_if(_early_growth(start)),
        "growth_zero_base": F.count_if(_growth_over_zero()),
        "recent_month": (F.coalesce(newest, F.lit(0)) == 0).cast("bigint"),
    }
    row = lagged(trends, key, "month", "pct_share", [1, 12]).agg(*[c.alias(name) for name, c in counts.items()])
    named = [F.struct(F.lit(name).alias("check_name"), F.col(name).alias("violations")) for name in counts]
    return row.select(F.inline(F.array(*named)))


def count_violations(checks: dict[str, DataFrame]) -> DataFrame:
    """Number of violating rows per check: ``check_name, violations``."""
    counts = [
        frame.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(name).alias("check_name"), "violations"
        )
        for name, frame in checks.items()
    ]
    return reduce(DataFrame.unionByName, counts)


"""Dense month-by-key metrics: counts, share, month and year growth."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.dates import in_months, month_of
from tidegauge.functions.metrics import growth_pct, safe_share
from tidegauge.operators.taxonomy import Term, found_terms, plan_terms, prepare_text, term_matches

# First month of the calendar spine and of the load partitions.
SPINE_START = dt.date(2011, 6, 1)
PARTITION_START = dt.date(2011, 4, 1)
# From so many terms on, pairs of month and term are counted instead of one column a term.
COUNTED_BY_PAIR = 100


def _months(start: dt.date, end: dt.date):
    return F.sequence(
        F.trunc(F.lit(start), "month"), F.trunc(F.lit(end), "month"), F.expr("interval 1 month")
    )


def month_spine(spark: SparkSession, start: dt.date = SPINE_START, end: dt.date | None = None) -> DataFrame:
    """One row per month from ``start`` through ``end`` (default: this month)."""
    end = end or dt.datetime.now(dt.timezone.utc).date()
    return spark.range(1).select(F.explode(_months(start, end)).alias("month"))


def spine_of(df: DataFrame, timestamp: str) -> DataFrame:
    """The spine from the first through the last month seen in a table."""
    bounds = df.agg(
        month_of(F.min(timestamp)).alias("first"), month_of(F.max(timestamp)).alias("last")
    ).filter(F.col("first").isNotNull())
    return bounds.select(
        F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("month")
    )


def dense_grid(dim: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Every month for every row of ``dim``: a row-wise expansion, no join."""
    return dim.select(F.explode(_months(start, end)).alias("month"), *dim.columns)


def monthly_mentions(
    pairs: DataFrame, id_col: str, key: str, timestamp: str, *, pairs_unique: bool = False
) -> DataFrame:
    """Distinct ids per (month, key). Unique pairs need no distinct and no second shuffle."""
    count = F.count(id_col) if pairs_unique else F.count_distinct(id_col)
    return pairs.groupBy(month_of(timestamp).alias("month"), F.col(key)).agg(
        count.alias("mention_count")
    )


def monthly_totals(
    records: DataFrame, id_col: str, timestamp: str, *, ids_unique: bool = False
) -> DataFrame:
    """Distinct ids per month, whatever their keys: the denominator of the share."""
    count = F.count(id_col) if ids_unique else F.count_distinct(id_col)
    return records.groupBy(month_of(timestamp).alias("month")).agg(count.alias("total_jobs"))


def monthly_share(mentions: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Share of each (month, key) count in its month's total."""
    return mentions.join(totals, "month", "left").select(
        "month",
        key,
        "mention_count",
        F.coalesce("total_jobs", F.lit(0)).alias("total_jobs"),
        safe_share(F.col("mention_count"), F.col("total_jobs")).alias("pct_share"),
    )


def lagged(df: DataFrame, key: str, order: str, col: str, offsets: list[int]) -> DataFrame:
    """Add ``<col>_lag_<n>`` per key. Meant for aggregated rows: a key's months."""
    history = Window.partitionBy(key).orderBy(order)
    return df.select("*", *[F.lag(col, n).over(history).alias(f"{col}_lag_{n}") for n in offsets])


def with_growth(base: DataFrame, key: str) -> DataFrame:
    """Add month and year growth of ``pct_share`` to dense (month, key) rows."""
    with_lags = lagged(base, key, "month", "pct_share", [1, 12])
    share = F.col("pct_share")
    return with_lags.withColumns(
        {
            "mom_growth_pct": growth_pct(share, F.col("pct_share_lag_1")),
            "yoy_growth_pct": growth_pct(share, F.col("pct_share_lag_12")),
        }
    ).drop("pct_share_lag_1", "pct_share_lag_12")


def monthly_trends(
    mentions: DataFrame,
    totals: DataFrame | None,
    dim: DataFrame,
    start: dt.date,
    end: dt.date,
    key: str = "tech_key",
    name: str = "tech_name",
) -> DataFrame:
    """The trend mart from monthly counts.

    Both inputs are aggregates, so the joins move months x keys rows, never
    records. ``totals`` has at most one row per month of the spine after the
    range filter; that is the bound under which it is broadcast. Without ``totals``
    a month's total is the sum of its mentions: for records that have exactly one
    key, all of them in ``dim``, which are then read and counted once.
    """
    spine = F.col("month").between(start.replace(day=1), end)
    grid = dense_grid(dim.select(key, name), start, end)
    base = grid.join(mentions.filter(spine), ["month", key], "left")
    total = F.col("total_jobs")
    if totals is None:
        base = base.withColumn("total_jobs", F.sum("mention_count").over(Window.partitionBy("month")))
    else:
        base = base.join(F.broadcast(totals.filter(spine)), "month", "left")
    counted = base.select(
        "month",
        key,
        name,
        F.coalesce("mention_count", F.lit(0)).alias("mention_count"),
        F.coalesce(total, F.lit(0)).alias("total_jobs"),
    )
    return with_growth(
        counted.withColumn("pct_share", safe_share(F.col("mention_count"), total)), key
    )


def mart_of_counts(
    spark: SparkSession, counts: DataFrame, terms: list[Term], start: dt.date, end: dt.date
) -> DataFrame:
    """The mart from ``rows`` per month and number of a term; number -1 stands for all rows."""
    names = F.from_json(F.lit(json.dumps([[t.key, t.name] for t in terms])), "array<array<string>>")
    cells = month_spine(spark, start, end).select("month", F.explode(F.sequence(F.lit(-1), F.lit(len(terms) - 1))).alias("number"))
    counted = cells.join(counts, ["month", "number"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    all_rows = F.max(F.when(F.col("number") < 0, F.col("rows"))).over(Window.partitionBy("month"))
    mart = (
        counted.withColumn("total_jobs", all_rows)
        .filter("number >= 0")
        .withColumn("term", F.get(names, F.col("number")))
        .select(
            "month",
            F.get("term", 0).alias("tech_key"),
            F.get("term", 1).alias("tech_name"),
            F.col("rows").alias("mention_count"),
            "total_jobs",
            safe_share(F.col("rows"), F.col("total_jobs")).alias("pct_share"),
        )
    )
    return with_growth(mart, "tech_key")


def _trends_by_pair(
    in_range: DataFrame, terms: list[Term], timestamp: str, text: str, start: dt.date, end: dt.date, partitions: int | None
) -> DataFrame:
    """The mart from counts per month and number of a term; -1 stands for all rows."""
    every = F.array(F.lit(-1))
    # A null text has no terms; its row counts all the same.
    found = F.coalesce(F.transform(found_terms(terms), lambda t: t["number"]), F.array().cast("array<int>"))
    numbers = F.concat(every, found)
    counts = (
        prepare_text(in_range, text, [month_of(timestamp).alias("month")], partitions)
        .select("month", F.explode(numbers).alias("number"))
        .groupBy("month", "number")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return mart_of_counts(in_range.sparkSession, counts, terms, start, end)


def trends_from_text(
    records: DataFrame,
    taxonomy: DataFrame | list[Term],
    timestamp: str,
    text: str,
    start: dt.date,
    end: dt.date,
    partitions: int | None = None,
) -> DataFrame:
    """The trend mart straight from records with unique ids, in one pass over the text.

    Per month, one counter per term and one for all rows: tasks send a row per
    month, and no bridge rows exist. ``partitions`` spreads the records first. Many terms
    are counted as pairs of month and term instead, of which tasks send sums as well.
    """
    spark, terms = records.sparkSession, plan_terms(taxonomy)
    if not terms:
        raise ValueError("trends need at least one term")
    in_range = records.filter(in_months(timestamp, records.schema[timestamp].dataType, start, end))
    if len(terms) >= COUNTED_BY_PAIR:
        return _trends_by_pair(in_range, terms, timestamp, text, start, end, partitions)
    counters = [F.count_if(term_matches(t)).alias(f"__n{i}") for i, t in enumerate(terms)]
    per_month = (
        prepare_text(in_range, text, [month_of(timestamp).alias("month")], partitions)
        .groupBy("month")
        .agg(F.count(F.lit(1)).alias("total_jobs"), *counters)
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(t.key).alias("tech_key"),
                F.lit(t.name).alias("tech_name"),
                F.coalesce(F.col(f"__n{i}"), F.lit(0)).alias("mention_count"),
            )
            for i, t in enumerate(terms)
        ]
    )
    mart = (
        month_spine(spark, start, end)
        .join(F.broadcast(per_month), "month", "left")
        .select("month", "total_jobs", F.explode(cells).alias("cell"))
        .select("month", "cell.*", F.coalesce("total_jobs", F.lit(0)).alias("total_jobs"))
        .withColumn("pct_share", safe_share(F.col("mention_count"), F.col("total_jobs")))
    )
    return with_growth(mart, "tech_key")

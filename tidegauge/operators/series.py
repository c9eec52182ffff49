"""Serving queries over the trend mart and the taxonomy."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.dates import month_label, month_span
from tidegauge.functions.text import contains_ignore_case

# Limits of a series request.
MAX_KEYS = 10
MAX_MONTHS = 60
DEFAULT_LIMIT = 20
KEY_FORMAT = r"[a-zA-Z0-9_-]+"


@dataclass(frozen=True)
class TrendRequest:
    keys: tuple[str, ...]
    start: dt.date
    end: dt.date


def trend_request(
    keys: str | Sequence[str] | None,
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
    as_of: dt.date | None = None,
) -> TrendRequest:
    """Check a request and fill in its dates; raises ``ValueError``.

    The range defaults to the year before ``end`` (today, when absent); the
    default start day is capped at 28 so that it exists in every month.
    """
    if isinstance(keys, str):
        keys = keys.split(",")
    parsed = [k.strip() for k in keys or [] if k.strip()]
    if not parsed:
        raise ValueError("at least one key is required")
    malformed = [k for k in parsed if not re.fullmatch(KEY_FORMAT, k)]
    if malformed:
        raise ValueError(f"malformed keys: {malformed}")
    if len(parsed) > MAX_KEYS:
        raise ValueError(f"at most {MAX_KEYS} keys, got {len(parsed)}")
    as_of = as_of or dt.date.today()
    start = dt.date.fromisoformat(start) if isinstance(start, str) else start
    end = dt.date.fromisoformat(end) if isinstance(end, str) else end
    last = end or as_of
    first = start or dt.date(last.year - 1, last.month, min(last.day, 28))
    if month_span(first, last) > MAX_MONTHS:
        raise ValueError(f"at most {MAX_MONTHS} months, got {month_span(first, last)}")
    return TrendRequest(tuple(parsed), first, last)


def trend_filter(
    keys: Sequence[str], start: dt.date, end: dt.date, key: str = "tech_key", month: str = "month"
) -> Column:
    """Key in list and month in range, both ends included."""
    return F.col(key).isin(list(keys)) & F.col(month).between(start, end)


def series_points(
    trends: DataFrame,
    keys: Sequence[str],
    start: dt.date,
    end: dt.date,
    key: str = "tech_key",
    name: str = "tech_name",
    count: str = "mention_count",
) -> DataFrame:
    """Flat form of ``get_trends``: ``tech_key, name, month (YYYY-MM), count``."""
    return trends.filter(trend_filter(keys, start, end, key)).select(
        F.col(key).alias("tech_key"),
        F.col(name).alias("name"),
        month_label("month").alias("month"),
        F.coalesce(F.col(count), F.lit(0)).cast("bigint").alias("count"),
    )


def get_trends(
    trends: DataFrame,
    keys: Sequence[str],
    start: dt.date,
    end: dt.date,
    key: str = "tech_key",
    name: str = "tech_name",
    count: str = "mention_count",
) -> DataFrame:
    """One row per requested key: ``tech_key, name, data array<struct<month, count>>``.

    Sorted by name, points in time order, null counts as 0; unknown keys do not
    appear. The list of a key is as long as the requested range has months.
    """
    points = series_points(trends, keys, start, end, key, name, count)
    return (
        points.groupBy("tech_key", "name")
        .agg(F.sort_array(F.collect_list(F.struct("month", "count"))).alias("data"))
        .orderBy("name", "tech_key")
    )


def flatten_series(series: DataFrame) -> DataFrame:
    return series.select("tech_key", "name", F.explode("data").alias("p")).select(
        "tech_key", "name", F.col("p.month").alias("month"), F.col("p.count").alias("count")
    )


def pivot_series(points: DataFrame, keys: Sequence[str], key: str = "tech_key") -> DataFrame:
    """Wide points: one row per month (``date``), one column per key, absent cells null."""
    return (
        points.groupBy(F.col("month").alias("date"))
        .pivot(key, list(keys))
        .agg(F.first("count"))
        .orderBy("date")
    )


def list_terms(taxonomy: DataFrame, trends: DataFrame) -> DataFrame:
    """Terms that have trend rows, by name. A semi join on distinct keys: trend rows
    neither multiply the terms nor meet in one task."""
    return (
        taxonomy.join(trends.select("tech_key").distinct(), "tech_key", "left_semi")
        .select(F.col("tech_key").alias("key"), F.col("display_name").alias("name"), "category")
        .distinct()
        .orderBy("name", "key")
    )


def search_terms(
    df: DataFrame, query: str, selected: Sequence[str], key: str = "key", name: str = "name"
) -> DataFrame:
    """Terms whose name contains the query, without those already selected."""
    found = df.filter(contains_ignore_case(name, query))
    return found.filter(~F.col(key).isin(list(selected))) if selected else found


def lookup_names(
    keys: DataFrame, dim: DataFrame, key: str = "key", name: str = "name", position: str = "position"
) -> DataFrame:
    """Name of each selected key, the key itself when unknown; positions are kept."""
    names = dim.select(key, F.col(name).alias("__name"))
    return keys.join(names, key, "left").select(
        position, key, F.coalesce(F.col("__name"), F.col(key).cast("string")).alias("name")
    )


def selected_keys(spark: SparkSession, keys: Sequence[str]) -> DataFrame:
    """The keys of a request as rows (``position, key``), in the order given."""
    return spark.createDataFrame(list(enumerate(keys)), "position int, key string")


def page(
    df: DataFrame, order: Sequence[str | Column], limit: int = DEFAULT_LIMIT, offset: int = 0
) -> DataFrame:
    """``LIMIT``/``OFFSET`` over a total order, for shallow pages: one task holds and sorts
    offset + limit rows. Deep pages go by ``page_after``."""
    if limit < 0:
        raise ValueError("limit must be non-negative")
    if offset < 0:
        raise ValueError("offset must be non-negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(
    df: DataFrame, order: Sequence[str], after: Sequence | None, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """The page that follows a row, given by its values of ``order`` (``None``: the first page).

    ``order`` must be total and its columns not null. However deep the page, tasks keep
    ``limit`` rows each, and the condition reaches the scan.
    """
    if limit < 0:
        raise ValueError("limit must be non-negative")
    if after is not None:
        if len(after) != len(order):
            raise ValueError("one value for each column of the order")
        beyond = F.lit(False)
        for column, value in reversed(list(zip(order, after))):
            col = F.col(column)
            beyond = (col > value) | ((col == value) & beyond)
        df = df.filter((F.col(order[0]) >= after[0]) & beyond)
    return df.orderBy(*order).limit(limit)


def page_info(df: DataFrame, page_number: int, page_size: int) -> DataFrame:
    """Paging metadata: total rows, and whether rows follow page ``page_number`` (from 1)."""
    return df.agg(F.count(F.lit(1)).alias("total_count")).select(
        "total_count",
        F.lit(page_number).cast("bigint").alias("page"),
        F.lit(page_size).cast("bigint").alias("page_size"),
        (F.lit(page_number * page_size) < F.col("total_count")).alias("has_more"),
    )


def fetch_all(spark: SparkSession, query: str, params: Sequence | dict | None = None, **views) -> DataFrame:
    """A query with bound parameters (``?`` or ``:name``); DataFrames bind as ``{name}``."""
    return spark.sql(query, args=params, **views)


def fetch_one(spark: SparkSession, query: str, params: Sequence | dict | None = None, **views):
    """First row of ``fetch_all`` as a dict, or ``None``."""
    row = fetch_all(spark, query, params, **views).first()
    return None if row is None else row.asDict()

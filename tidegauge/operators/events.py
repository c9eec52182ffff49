"""Aggregates over an event log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_rates(
    df: DataFrame, name: str, bad: str, base: str, durations: dict[str, Column], by: list[str] = ()
) -> DataFrame:
    """Counts of two event names, their ratio in percent and the longest duration.

    ``durations`` gives the duration of each event name that has one; missing
    ones count as none, and without any the maximum is 0. Without ``base``
    events the percentage is 0.
    """
    event = F.col(name)
    longest = reduce(
        lambda rest, pair: F.when(event == pair[0], pair[1].cast("double")).otherwise(rest),
        durations.items(),
        F.lit(None).cast("double"),
    )
    bad_count, base_count = F.count_if(event == bad), F.count_if(event == base)
    ratio = bad_count.cast("double") / F.nullif(base_count, F.lit(0)).cast("double") * 100
    return df.groupBy(*by).agg(
        bad_count.alias("bad_count"),
        base_count.alias("all_count"),
        F.greatest(F.lit(0.0), F.coalesce(F.max(longest), F.lit(0.0))).alias("max_duration"),
        F.coalesce(ratio, F.lit(0.0)).alias("bad_pct"),
    )

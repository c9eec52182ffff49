"""Registered queries: every operator on whole driver tables, with its check in SQL."""

from tidegauge.plans.registered import (  # noqa: F401
    landing,
    quality,
    records,
    scan,
    serving,
    streams,
    text,
    tree,
    trends,
)
from tidegauge.plans.registered.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

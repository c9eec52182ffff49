"""Streaming jobs run to the end over landed events, and the pipeline as a whole."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidegauge.functions.jsonfields import json_project
from tidegauge.plans.pipeline import build_marts, check_marts, rebuild, trends_of_bronze
from tidegauge.plans.registered.landing import EVENT_FIELDS, event_payloads
from tidegauge.plans.registered.records import STAGED_SQL, event_bronze, without_zone
from tidegauge.plans.registered.registry import query
from tidegauge.plans.registered.trends import _quoted, mart_sql
from tidegauge.session import work_path
from tidegauge.sources import schemas
from tidegauge.sources.bronze import read_bronze
from tidegauge.streaming.buckets import compact_buckets, read_buckets, read_trends, retire_steps, stream_buckets
from tidegauge.streaming.jobs import compact_latest, read_latest, run_to_end, stream_bronze, stream_latest

STREAM_STAMP = dt.datetime(2024, 2, 1)
# The driver's tables are small; a folder per bucket is all that more of them would give.
QUERY_BUCKETS = 8


@query(
    """
    SELECT event_id, event_type, user_id, true AS known_load FROM events
    """
)
def stream_bronze_rows(t):
    """Landed files appended by micro-batches, two runs over one checkpoint."""
    landing, out = work_path(t.spark, "landing"), work_path(t.spark, "bronze")
    checkpoint = work_path(t.spark, "checkpoint")
    payloads = event_payloads(t)
    is_click = F.get_json_object("payload", "$.event_type") == "click"
    payloads.filter(is_click).write.mode("append").text(landing)
    run_to_end(stream_bronze(t.spark, landing, out, checkpoint, ingested_at=STREAM_STAMP))
    payloads.filter(~is_click).write.mode("append").text(landing)
    run_to_end(stream_bronze(t.spark, landing, out, checkpoint, ingested_at=STREAM_STAMP))
    fields = {k: EVENT_FIELDS[k] for k in ("event_id", "event_type", "user_id")}
    rows = json_project(read_bronze(t.spark, out), "payload", fields, keep=["load_id"])
    return rows.select(
        "event_id", "event_type", "user_id", F.col("load_id").rlike("^stream-[0-9]+$").alias("known_load")
    )


def _stream_events(t, compact: bool):
    bronze, out = work_path(t.spark, "bronze"), work_path(t.spark, "silver")
    checkpoint = work_path(t.spark, "checkpoint")
    # Late arrivals: the second batch is older than the first.
    for condition in ("load_id >= 'load-purchase'", "load_id < 'load-purchase'"):
        part = event_bronze(t).filter(condition)
        part.select(*schemas.BRONZE.names).write.mode("append").parquet(bronze)
        run_to_end(stream_latest(t.spark, bronze, out, checkpoint))
        if compact:
            compact_latest(t.spark, out)
    return without_zone(read_latest(t.spark, out))


@query(STAGED_SQL)
def stream_latest_equals_batch(t):
    """Silver kept up by micro-batches equals the batch staging of everything."""
    return _stream_events(t, compact=False)


@query(STAGED_SQL)
def stream_latest_compacted(t):
    return _stream_events(t, compact=True)


@query(STAGED_SQL)
def stream_latest_touched_buckets(t):
    """Silver in buckets: compaction rewrites those that a batch touched, no other is read."""
    bronze, out = work_path(t.spark, "bronze"), work_path(t.spark, "buckets")
    checkpoint = work_path(t.spark, "checkpoint")
    for condition in ("load_id >= 'load-purchase'", "load_id < 'load-purchase'"):
        part = event_bronze(t).filter(condition)
        part.select(*schemas.BRONZE.names).write.mode("append").parquet(bronze)
        run_to_end(stream_buckets(t.spark, bronze, out, checkpoint, buckets=QUERY_BUCKETS))
    compact_buckets(t.spark, out)
    retire_steps(t.spark, out, keep=1)
    return without_zone(read_buckets(t.spark, out))


PIPE_FIRST = dt.date(2023, 11, 1)
PIPE_LAST = dt.date(2025, 2, 1)
PIPE_TERMS = [
    ("views", "Views", "Language", r"\b(view)\b"),
    ("money", "Money", "Tool", r"\b(purchase|sale)\b"),
    ("sevens", "Sevens", "Cloud", r"'[0-9]*7[0-9]*'"),
]
_TERMS = (
    "(VALUES "
    + ", ".join(f"({', '.join(_quoted(v) for v in row)})" for row in PIPE_TERMS)
    + ") AS x(tech_key, display_name, category, regex_pattern)"
)
_PIPE_MART = mart_sql(
    """SELECT CAST(generate_series AS DATE) AS month
       FROM generate_series(DATE '2023-11-01', DATE '2025-02-01', INTERVAL 1 MONTH)""",
    f"SELECT tech_key, display_name AS tech_name FROM {_TERMS}",
    f"""SELECT CAST(date_trunc('month', posted_at) AS DATE) AS month, x.tech_key,
               count(DISTINCT id) AS mention_count
        FROM ({STAGED_SQL}) AS s CROSS JOIN {_TERMS}
        WHERE regexp_matches(s.full_text, x.regex_pattern, 'i') GROUP BY 1, 2""",
    f"""SELECT CAST(date_trunc('month', posted_at) AS DATE) AS month,
               count(DISTINCT id) AS total_jobs
        FROM ({STAGED_SQL}) GROUP BY 1""",
)


def _taxonomy(t):
    return t.spark.createDataFrame(PIPE_TERMS, schemas.TAXONOMY)


@query(_PIPE_MART)
def pipeline_marts(t):
    """Payloads to trend mart in one plan."""
    return build_marts(event_bronze(t), _taxonomy(t), PIPE_LAST, PIPE_FIRST).trends


@query(_PIPE_MART)
def bronze_trends(t):
    """Payloads to trend mart without a bridge, straight from the landing table."""
    return trends_of_bronze(event_bronze(t), _taxonomy(t), PIPE_LAST, PIPE_FIRST)


@query(_PIPE_MART)
def pipeline_rebuild(t):
    """The same with every table written, as a full rebuild does."""
    out = work_path(t.spark, "marts")
    return rebuild(t.spark, event_bronze(t), _taxonomy(t), out, PIPE_LAST, PIPE_FIRST).trends


@query(_PIPE_MART)
def trends_by_deltas(t):
    """The mart as a sum of changes: late versions take back what older ones had counted.

    The loads come one by one, the last ones first, so later batches hold older versions."""
    bronze, out = work_path(t.spark, "bronze"), work_path(t.spark, "buckets")
    checkpoint = work_path(t.spark, "checkpoint")
    late = F.col("load_id") >= "load-purchase"
    even = F.col("ingested_at").cast("long") % 2 == 0
    for condition in (late & even, late & ~even, ~late):
        part = event_bronze(t).filter(condition)
        part.select(*schemas.BRONZE.names).write.mode("append").parquet(bronze)
        run_to_end(stream_buckets(t.spark, bronze, out, checkpoint, _taxonomy(t), buckets=QUERY_BUCKETS))
    return read_trends(t.spark, out, _taxonomy(t), PIPE_LAST, PIPE_FIRST)


_COUNT = "SELECT '{}' AS check_name, count(*) AS violations FROM ({}) WHERE {}"
_LAGS = f"""
    SELECT *, lag(pct_share, 1) OVER w AS p1, lag(pct_share, 12) OVER w AS p12
    FROM ({_PIPE_MART}) WINDOW w AS (PARTITION BY tech_key ORDER BY month)
"""
_TIMES = f"""
    SELECT s.posted_at, date_trunc('second', e.ts) AS landed_at
    FROM ({STAGED_SQL}) AS s JOIN events AS e ON e.event_id = s.parent_id
"""


@query(
    " UNION ALL ".join(
        _COUNT.format(name, source, where)
        for name, source, where in [
            ("silver_not_null", STAGED_SQL, "author IS NULL OR posted_at IS NULL OR text IS NULL"),
            ("silver_unique", f"SELECT id FROM ({STAGED_SQL}) GROUP BY id HAVING count(*) > 1", "true"),
            ("silver_conserved", _TIMES, "posted_at IS DISTINCT FROM landed_at"),
            ("dim_unique", f"SELECT tech_key FROM {_TERMS} GROUP BY 1 HAVING count(*) > 1", "true"),
            ("bridge_not_null", f"SELECT * FROM {_TERMS}", "tech_key IS NULL OR category IS NULL"),
            ("bridge_categories", f"SELECT * FROM {_TERMS}", "category NOT IN ('Language', 'Tool', 'Cloud')"),
            ("trends_not_null", _PIPE_MART, "tech_name IS NULL OR mention_count IS NULL"),
            ("trends_keys_known", _PIPE_MART, f"tech_key NOT IN (SELECT tech_key FROM {_TERMS})"),
            ("trends_complete", f"SELECT tech_key FROM ({_PIPE_MART}) GROUP BY 1 HAVING count(*) <> 16", "true"),
            ("trends_bounds", _PIPE_MART, "pct_share < 0 OR pct_share > 1"),
            ("trends_stable", _PIPE_MART, "mention_count > total_jobs"),
            ("growth_head", _PIPE_MART, "month = DATE '2023-11-01' AND mom_growth_pct IS NOT NULL"),
            ("growth_zero_base", _LAGS, "(p1 = 0 AND mom_growth_pct IS NOT NULL) OR (p12 = 0 AND yoy_growth_pct IS NOT NULL)"),
            ("recent_month", f"SELECT month, max(total_jobs) AS n FROM ({_PIPE_MART}) GROUP BY 1",
             "month = DATE '2025-01-01' AND n = 0"),
        ]
    )
)
def pipeline_checks(t):
    """All checks over the rebuilt tables; only the last month is empty, as it should be."""
    out = work_path(t.spark, "marts")
    bronze = event_bronze(t)
    marts = rebuild(t.spark, bronze, _taxonomy(t), out, PIPE_LAST, PIPE_FIRST)
    return check_marts(marts, bronze, PIPE_LAST, PIPE_FIRST)



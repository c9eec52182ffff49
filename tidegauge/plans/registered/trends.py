"""Taxonomy tagging, monthly counts and the trend mart."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidegauge.operators.events import event_rates
from tidegauge.operators.staging import latest_by
from tidegauge.operators.taxonomy import Term, bridge, dim_terms, pattern_failures, tag_taxonomy
from tidegauge.operators.trends import (
    dense_grid,
    lagged,
    monthly_mentions,
    monthly_share,
    monthly_totals,
    monthly_trends,
    spine_of,
    trends_from_text,
)
from tidegauge.plans.registered.registry import query

SPINE_FIRST = dt.date(1994, 10, 1)
SPINE_LAST = dt.date(2001, 12, 1)
DOC_FIRST = dt.date(2019, 11, 1)
DOC_LAST = dt.date(2023, 2, 1)

# Terms for the driver's invented prose.
DOC_TERMS = [
    Term("articles", "Articles", "Language", r"\b(the|an)\b"),
    Term("joiner", "Joiner", "Language", r"\b(and|und|et|y)\b"),
    Term("french", "French", "Language", r"\b(e|au|le)\b"),
    Term("letters", "Letters", "Tool", r"\b(s|t|n)\b"),
    Term("spanish", "Spanish", "Language", r"\b(ción[a-z]*|para|con)\b"),
    Term("german", "German", "Language", r"\b(der|die|das)\b"),
    Term("licence", "Licence", "Tool", r"\b(licensed\s+under|apache\s+license|gnu\s+general)\b"),
    Term("mail", "Mail", "Tool", r"[a-z0-9.]+@[a-z0-9.]+"),
    Term("secret", "Secret", "Cloud", r"\b(token|password|api_key|secret)\b"),
    Term("address", "Address", "Cloud", r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b"),
    Term("absent", "Absent", "DevOps", r"\b(kubernetes|k8s)\b"),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TERMS_SQL = (
    "(VALUES "
    + ", ".join(
        f"({_quoted(x.key)}, {_quoted(x.name)}, {_quoted(x.category)}, {_quoted(x.pattern)})"
        for x in DOC_TERMS
    )
    + ") AS x(tech_key, display_name, category, regex_pattern)"
)
POSTED_SQL = "DATE '2020-01-01' + INTERVAL 1 MONTH * CAST(doc_id % 36 AS INTEGER)"


def posted_documents(t):
    """Documents with the month they stand for: three years from 2020 on."""
    month = F.add_months(F.lit(dt.date(2020, 1, 1)), (F.col("doc_id") % 36).cast("int"))
    return t.documents.select(
        F.col("doc_id").alias("id"), month.alias("posted_at"), F.col("text").alias("full_text")
    )


_PAIRS_SQL = f"""
    SELECT DISTINCT d.doc_id AS job_id, x.tech_key, x.category AS tech_category,
           CAST({POSTED_SQL} AS DATE) AS job_posted_at
    FROM documents AS d CROSS JOIN {TERMS_SQL}
    WHERE regexp_matches(d.text, x.regex_pattern, 'i')
"""


@query(_PAIRS_SQL)
def taxonomy_bridge(t):
    return bridge(t.spread(posted_documents(t)), DOC_TERMS).drop("matched_at")


@query(
    f"""
    SELECT DISTINCT d.lang, d.source, x.tech_key, x.category AS tech_category
    FROM documents AS d CROSS JOIN {TERMS_SQL}
    WHERE regexp_matches(d.text, x.regex_pattern, 'i')
    """
)
def taxonomy_of_sources(t):
    """Pairs of repeated rows: the distinct cannot be saved here."""
    return tag_taxonomy(t.documents, DOC_TERMS, "text", ["lang", "source"])


@query(
    f"""
    SELECT d.page_id, x.tech_key, x.category AS tech_category
    FROM pages AS d CROSS JOIN {TERMS_SQL}
    WHERE regexp_matches(d.html, x.regex_pattern, 'i')
    """
)
def taxonomy_of_pages(t):
    return tag_taxonomy(t.pages, DOC_TERMS, "html", ["page_id"], rows_unique=True)


_MENTIONS_SQL = """
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority,
           count(DISTINCT o_orderkey) AS mention_count
    FROM orders GROUP BY 1, 2
"""
_TOTALS_SQL = """
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
           count(DISTINCT o_orderkey) AS total_jobs
    FROM orders GROUP BY 1
"""


@query(_MENTIONS_SQL)
def order_mentions(t):
    return monthly_mentions(t.orders, "o_orderkey", "o_orderpriority", "o_orderdate")


@query(_TOTALS_SQL)
def order_totals(t):
    return monthly_totals(t.orders, "o_orderkey", "o_orderdate")


@query(
    """
    SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_returnflag,
           count(DISTINCT l_orderkey) AS mention_count
    FROM lineitem GROUP BY 1, 2
    """
)
def shipment_mentions(t):
    """Ids repeat within a month and key here: several lines per order."""
    return monthly_mentions(t.lineitem, "l_orderkey", "l_returnflag", "l_shipdate")


_SHARE_SQL = f"""
    SELECT m.month, m.o_orderpriority, m.mention_count, t.total_jobs,
           CASE WHEN t.total_jobs = 0 THEN 0.0
                ELSE CAST(m.mention_count AS DOUBLE) / t.total_jobs END AS pct_share
    FROM ({_MENTIONS_SQL}) AS m LEFT JOIN ({_TOTALS_SQL}) AS t ON m.month = t.month
"""


def order_shares(t):
    return monthly_share(order_mentions(t), order_totals(t), "o_orderpriority")


@query(_SHARE_SQL)
def monthly_order_share(t):
    return order_shares(t)


@query(
    f"""
    SELECT *, lag(pct_share, 1) OVER w AS pct_share_lag_1,
           lag(pct_share, 12) OVER w AS pct_share_lag_12
    FROM ({_SHARE_SQL}) WINDOW w AS (PARTITION BY o_orderpriority ORDER BY month)
    """
)
def lagged_share(t):
    return lagged(order_shares(t), "o_orderpriority", "month", "pct_share", [1, 12])


@query(
    """
    SELECT CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)),
           date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS DATE) AS month
    FROM orders
    """
)
def month_spine_of_orders(t):
    return spine_of(t.orders, "o_orderdate")


_SPINE_SQL = """
    SELECT CAST(generate_series AS DATE) AS month
    FROM generate_series(DATE '1994-10-01', DATE '2001-12-01', INTERVAL 1 MONTH)
"""
_DIM_SQL = "SELECT DISTINCT o_orderpriority AS tech_key, upper(o_orderpriority) AS tech_name FROM orders"


def priority_dim(t):
    keys = t.orders.select(F.col("o_orderpriority").alias("tech_key")).distinct()
    return keys.withColumn("tech_name", F.upper("tech_key"))


@query(f"SELECT s.month, d.tech_key, d.tech_name FROM ({_SPINE_SQL}) AS s CROSS JOIN ({_DIM_SQL}) AS d")
def order_grid(t):
    return dense_grid(priority_dim(t), SPINE_FIRST, SPINE_LAST)


@query(
    """
    SELECT s.month, c.c_custkey
    FROM (SELECT CAST(generate_series AS DATE) AS month
          FROM generate_series(DATE '1994-10-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS s
    CROSS JOIN customer AS c
    """
)
def customer_grid(t):
    return dense_grid(t.customer.select("c_custkey"), SPINE_FIRST, SPINE_LAST)


def mart_sql(spine: str, dim: str, mentions: str, totals: str) -> str:
    """The trend mart in plain SQL over four sub-queries."""
    return f"""
    WITH base AS (
        SELECT g.month, g.tech_key, g.tech_name,
               coalesce(m.mention_count, 0) AS mention_count,
               coalesce(t.total_jobs, 0) AS total_jobs,
               CASE WHEN coalesce(t.total_jobs, 0) = 0 THEN 0.0
                    ELSE CAST(coalesce(m.mention_count, 0) AS DOUBLE) / t.total_jobs
               END AS pct_share
        FROM (SELECT * FROM ({spine}) AS s CROSS JOIN ({dim}) AS d) AS g
        LEFT JOIN ({mentions}) AS m ON g.month = m.month AND g.tech_key = m.tech_key
        LEFT JOIN ({totals}) AS t ON g.month = t.month
    ), lags AS (
        SELECT *, lag(pct_share, 1) OVER w AS p1, lag(pct_share, 12) OVER w AS p12
        FROM base WINDOW w AS (PARTITION BY tech_key ORDER BY month)
    )
    SELECT month, tech_key, tech_name, mention_count, total_jobs, pct_share,
           CASE WHEN p1 IS NULL OR p1 = 0 THEN NULL ELSE (pct_share - p1) / p1 * 100 END
               AS mom_growth_pct,
           CASE WHEN p12 IS NULL OR p12 = 0 THEN NULL ELSE (pct_share - p12) / p12 * 100 END
               AS yoy_growth_pct
    FROM lags
    """


MART_SQL = mart_sql(
    _SPINE_SQL,
    _DIM_SQL,
    f"SELECT month, o_orderpriority AS tech_key, mention_count FROM ({_MENTIONS_SQL})",
    _TOTALS_SQL,
)


def order_trends(t):
    # Order keys are unique and have one priority each: totals are sums of the mentions.
    mentions = monthly_mentions(
        t.orders, "o_orderkey", "o_orderpriority", "o_orderdate", pairs_unique=True
    ).withColumnRenamed("o_orderpriority", "tech_key")
    return monthly_trends(mentions, None, priority_dim(t), SPINE_FIRST, SPINE_LAST)


@query(MART_SQL)
def monthly_trends_of_orders(t):
    """The flagship: a dense month-by-priority mart over orders."""
    return order_trends(t)


_DOC_SPINE = """
    SELECT CAST(generate_series AS DATE) AS month
    FROM generate_series(DATE '2019-11-01', DATE '2023-02-01', INTERVAL 1 MONTH)
"""
_DOC_MART = mart_sql(
    _DOC_SPINE,
    f"SELECT tech_key, display_name AS tech_name FROM {TERMS_SQL}",
    f"""SELECT CAST(date_trunc('month', job_posted_at) AS DATE) AS month, tech_key,
               count(DISTINCT job_id) AS mention_count
        FROM ({_PAIRS_SQL}) GROUP BY 1, 2""",
    f"""SELECT CAST(date_trunc('month', {POSTED_SQL}) AS DATE) AS month,
               count(DISTINCT doc_id) AS total_jobs
        FROM documents GROUP BY 1""",
)


@query(_DOC_MART)
def document_trends(t):
    """Trends from text in one pass: tagging and counting without bridge rows."""
    return trends_from_text(
        t.spread(posted_documents(t)), DOC_TERMS, "posted_at", "full_text", DOC_FIRST, DOC_LAST
    )


@query(_DOC_MART)
def document_trends_by_bridge(t):
    """The same mart through the bridge table."""
    documents = posted_documents(t)
    pairs = bridge(documents, DOC_TERMS)
    dim = t.spark.createDataFrame([(x.key, x.name) for x in DOC_TERMS], "tech_key string, tech_name string")
    return monthly_trends(
        monthly_mentions(pairs, "job_id", "tech_key", "job_posted_at", pairs_unique=True),
        monthly_totals(documents, "id", "posted_at", ids_unique=True),
        dim,
        DOC_FIRST,
        DOC_LAST,
    )


@query(
    """
    SELECT CAST(p_partkey AS VARCHAR) AS tech_key, p_name AS tech_name FROM part
    """
)
def dim_terms_of_parts(t):
    return dim_terms(
        t.part.select(F.col("p_partkey").cast("string").alias("tech_key"), F.col("p_name").alias("display_name"))
    )


@query(
    f"""
    SELECT doc_id, 'french' AS tech_key, lang = 'fr' AS should_match,
           regexp_matches(text, {_quoted(DOC_TERMS[2].pattern)}, 'i') AS did_match
    FROM documents
    WHERE (lang = 'fr') <> regexp_matches(text, {_quoted(DOC_TERMS[2].pattern)}, 'i')
    UNION ALL
    SELECT doc_id, 'unknown', true, false FROM documents
    """
)
def dq_pattern_controls(t):
    """Every document a control case: the French term should match French text only."""
    french = t.documents.select(
        F.col("doc_id").cast("string").alias("case_id"),
        "text",
        F.lit("french").alias("tech_key"),
        (F.col("lang") == "fr").alias("should_match"),
    )
    unknown = t.documents.select(
        F.col("doc_id").cast("string").alias("case_id"),
        "text",
        F.lit("unknown").alias("tech_key"),
        F.lit(True).alias("should_match"),
    )
    failures = pattern_failures(french.unionByName(unknown), DOC_TERMS, keep=["case_id"])
    return failures.select(
        F.col("case_id").cast("bigint").alias("doc_id"), "tech_key", "should_match", "did_match"
    )


@query(
    """
    SELECT count(*) FILTER (WHERE event_type = 'error') AS bad_count,
           count(*) FILTER (WHERE event_type = 'view') AS all_count,
           greatest(0.0, max(value) FILTER (WHERE event_type IN ('click', 'purchase')) / 1000,
                    max(value) FILTER (WHERE event_type = 'signup')) AS max_duration,
           CASE WHEN count(*) FILTER (WHERE event_type = 'view') = 0 THEN 0.0
                ELSE CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE)
                     / count(*) FILTER (WHERE event_type = 'view') * 100 END AS bad_pct
    FROM events
    """
)
def event_rates_of_log(t):
    return event_rates(
        t.events,
        "event_type",
        bad="error",
        base="view",
        durations={"click": F.col("value") / 1000, "purchase": F.col("value") / 1000,
                   "signup": F.col("value")},
    )


@query(
    """
    SELECT month, o_custkey, mention_count FROM (
        SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_custkey,
               count(DISTINCT o_orderkey) AS mention_count
        FROM (SELECT * FROM orders QUALIFY row_number() OVER (
              PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
        GROUP BY 1, 2)
    """
)
def mentions_of_latest(t):
    """Counting after deduplication needs no distinct: keys are unique by then."""
    newest = latest_by(t.orders, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"])
    return monthly_mentions(newest, "o_orderkey", "o_custkey", "o_orderdate", pairs_unique=True)

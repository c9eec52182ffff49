"""Data-quality checks, each on data with faults so that it has something to find."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators import quality
from tidegauge.operators.staging import stage_records
from tidegauge.plans.registered.records import event_bronze
from tidegauge.plans.registered.registry import query
from tidegauge.plans.registered.trends import (
    MART_SQL,
    SPINE_FIRST,
    SPINE_LAST,
    order_trends,
    priority_dim,
)
from tidegauge.session import work_path
from tidegauge.sources.tables import ensure_table


@query(
    """
    SELECT 'o_custkey' AS column_name, count(*) AS null_rows FROM orders
    WHERE o_orderstatus = 'P' HAVING count(*) > 0
    UNION ALL
    SELECT 'o_orderdate', count(*) FROM orders WHERE o_totalprice > 400000 HAVING count(*) > 0
    """
)
def dq_not_null(t):
    faulty = t.orders.withColumns(
        {
            "o_custkey": F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")),
            "o_orderdate": F.when(F.col("o_totalprice") <= 400000, F.col("o_orderdate")),
        }
    )
    return quality.not_null(faulty, faulty.columns)


@query(
    """
    SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
    GROUP BY 1, 2 HAVING count(*) > 1
    """
)
def dq_unique(t):
    return quality.unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    """
    SELECT event_type, count(*) AS n_rows FROM events
    WHERE event_type NOT IN ('click', 'view', 'signup') GROUP BY 1
    """
)
def dq_accepted(t):
    return quality.accepted(t.events, "event_type", ["click", "view", "signup"])


AS_OF_STALE = dt.datetime(2024, 3, 15)


@query(
    """
    SELECT max(ts) AS newest FROM events
    HAVING max(ts) < TIMESTAMP '2024-03-15' - INTERVAL 35 DAY OR max(ts) IS NULL
    """
)
def dq_freshness(t):
    return quality.freshness(t.events, "ts", AS_OF_STALE)


@query(
    """
    SELECT max(ts) AS newest FROM events
    HAVING max(ts) < TIMESTAMP '2024-02-10' - INTERVAL 35 DAY OR max(ts) IS NULL
    """
)
def dq_freshness_passes(t):
    return quality.freshness(t.events, "ts", dt.datetime(2024, 2, 10))


def _recency_sql(month: str) -> str:
    return f"""
    SELECT m.month, max(t.total_jobs) AS max_total_jobs
    FROM (SELECT DATE '{month}' AS month) AS m
    LEFT JOIN ({MART_SQL}) AS t ON m.month = t.month
    GROUP BY m.month
    HAVING max(t.total_jobs) IS NULL OR max(t.total_jobs) = 0
    """


@query(_recency_sql("2001-11-01"))
def dq_recency(t):
    return quality.recency(order_trends(t), dt.date(2001, 12, 9))


@query(_recency_sql("2000-05-01"))
def dq_recency_passes(t):
    return quality.recency(order_trends(t), dt.date(2000, 6, 30))


_FAULTY_SQL = f"""
    SELECT month, tech_key, tech_name,
           CASE WHEN tech_key = '5-LOW' THEN mention_count + 3
                WHEN tech_key = '2-HIGH' AND mention_count > 0 THEN mention_count + 1
                ELSE mention_count END AS mention_count,
           total_jobs,
           CASE WHEN tech_key = '1-URGENT' THEN pct_share + 1 ELSE pct_share END AS pct_share,
           CASE WHEN tech_key = '3-MEDIUM' THEN coalesce(mom_growth_pct, 0) ELSE mom_growth_pct END
               AS mom_growth_pct,
           CASE WHEN tech_key = '3-MEDIUM' THEN coalesce(yoy_growth_pct, 0) ELSE yoy_growth_pct END
               AS yoy_growth_pct
    FROM ({MART_SQL})
"""


def faulty_trends(t):
    """The order mart with counts, shares and growth tampered with by key."""
    key, count = F.col("tech_key"), F.col("mention_count")
    zero = F.lit(0.0)
    return order_trends(t).withColumns(
        {
            "mention_count": F.when(key == "5-LOW", count + 3)
            .when((key == "2-HIGH") & (count > 0), count + 1)
            .otherwise(count),
            "pct_share": F.when(key == "1-URGENT", F.col("pct_share") + 1).otherwise(
                F.col("pct_share")
            ),
            "mom_growth_pct": F.when(
                key == "3-MEDIUM", F.coalesce("mom_growth_pct", zero)
            ).otherwise(F.col("mom_growth_pct")),
            "yoy_growth_pct": F.when(
                key == "3-MEDIUM", F.coalesce("yoy_growth_pct", zero)
            ).otherwise(F.col("yoy_growth_pct")),
        }
    )


@query(
    f"""
    WITH s AS (
        SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
               o_orderpriority AS tech_key, count(DISTINCT o_orderkey) AS n
        FROM orders GROUP BY 1, 2
    ), m AS (
        SELECT month, tech_key, mention_count AS n FROM ({_FAULTY_SQL}) WHERE mention_count > 0
    ), c AS (
        SELECT coalesce(m.month, s.month) AS month, coalesce(m.tech_key, s.tech_key) AS tech_key,
               coalesce(s.n, 0) AS source_count, coalesce(m.n, 0) AS mart_count,
               abs(coalesce(m.n, 0) - coalesce(s.n, 0)) AS abs_diff,
               CASE WHEN coalesce(s.n, 0) = 0 THEN NULL
                    ELSE CAST(abs(coalesce(m.n, 0) - s.n) AS DOUBLE) * 100.0
                         / CAST(s.n AS DOUBLE) END AS pct_diff
        FROM m FULL JOIN s ON m.month = s.month AND m.tech_key = s.tech_key
    )
    SELECT * FROM c WHERE abs_diff > 1 OR (pct_diff IS NOT NULL AND pct_diff > 1.0)
    """
)
def dq_reconcile(t):
    pairs = t.orders.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_orderpriority").alias("tech_key"),
        F.col("o_orderdate").alias("job_posted_at"),
    )
    return quality.stability(faulty_trends(t), pairs)


@query(
    f"""
    SELECT month, tech_key, mom_growth_pct, yoy_growth_pct FROM ({_FAULTY_SQL})
    WHERE (month = DATE '1994-10-01' AND mom_growth_pct IS NOT NULL)
       OR (month < DATE '1995-10-01' AND yoy_growth_pct IS NOT NULL)
    """
)
def dq_growth_head(t):
    return quality.growth_null_head(faulty_trends(t), SPINE_FIRST)


@query(
    f"""
    SELECT * FROM (
        SELECT month, tech_key, lag(pct_share, 1) OVER w AS prev_month_share, mom_growth_pct,
               lag(pct_share, 12) OVER w AS prev_year_share, yoy_growth_pct
        FROM ({_FAULTY_SQL}) WINDOW w AS (PARTITION BY tech_key ORDER BY month)
    )
    WHERE (prev_month_share = 0 AND mom_growth_pct IS NOT NULL)
       OR (prev_year_share = 0 AND yoy_growth_pct IS NOT NULL)
    """
)
def dq_growth_zero(t):
    return quality.growth_null_zero(faulty_trends(t))


@query(
    """
    SELECT o_orderkey, count(*) AS n_rows FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1
    """
)
def dq_orphans(t):
    return quality.orphans(t.orders, t.lineitem, "o_orderkey", "l_orderkey")


@query(
    """
    SELECT l_suppkey, count(*) AS n_rows FROM lineitem
    WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000) GROUP BY 1
    """
)
def dq_orphans_of_hot_keys(t):
    """Few keys, each behind many rows: counted before the join."""
    solvent = t.supplier.filter("s_acctbal > 1000")
    return quality.orphans(t.lineitem, solvent, "l_suppkey", "s_suppkey")


@query(
    f"""
    SELECT month, tech_key FROM ({MART_SQL}) WHERE mention_count = 0
    """
)
def dq_spine_gaps(t):
    """Gaps of a mart that left out its zero rows."""
    sparse = order_trends(t).filter("mention_count > 0")
    return quality.spine_gaps(sparse, priority_dim(t), SPINE_FIRST, SPINE_LAST)


@query(
    f"""
    SELECT month, tech_key, mention_count, total_jobs, pct_share FROM ({_FAULTY_SQL})
    WHERE pct_share IS NULL OR pct_share < 0 OR pct_share > 1
       OR pct_share <> CASE WHEN total_jobs = 0 THEN 0.0
                            ELSE CAST(mention_count AS DOUBLE) / total_jobs END
    """
)
def dq_bounds(t):
    return quality.bounds(faulty_trends(t))


@query(
    """
    SELECT user_id AS id, 'load-' || event_type AS load_id, ts AS ingested_at,
           date_trunc('second', ts) + INTERVAL 1 HOUR AS silver_value,
           date_trunc('second', ts) AS bronze_value
    FROM (
        SELECT * FROM events WHERE event_type <> 'error' AND value >= 4
        QUALIFY row_number() OVER (PARTITION BY user_id
                ORDER BY ts DESC, event_type DESC, event_id DESC) = 1
    ) WHERE event_type = 'view'
    """
)
def dq_conserved(t):
    """Silver stamps against the payloads they came from, one load's off by an hour."""
    bronze = event_bronze(t)
    landed = bronze.select(
        F.get_json_object("payload", "$.id").cast("bigint").alias("id"),
        "load_id",
        "ingested_at",
        F.get_json_object("payload", "$.time").cast("timestamp").alias("landed_at"),
    )
    late = F.col("posted_at") + F.expr("interval 1 hour")
    silver = stage_records(bronze).withColumn(
        "posted_at", F.when(F.col("load_id") == "load-view", late).otherwise(F.col("posted_at"))
    )
    wrong = quality.conserved(
        silver, landed, ["id", "load_id", "ingested_at"], "posted_at", "landed_at"
    )
    stamps = ("ingested_at", "silver_value", "bronze_value")
    return wrong.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps})


@query(
    f"""
    SELECT 'bounds' AS check_name, count(*) AS violations FROM ({_FAULTY_SQL})
    WHERE pct_share IS NULL OR pct_share < 0 OR pct_share > 1
       OR pct_share <> CASE WHEN total_jobs = 0 THEN 0.0
                            ELSE CAST(mention_count AS DOUBLE) / total_jobs END
    UNION ALL SELECT 'unique', 0
    UNION ALL SELECT 'growth_head', 0
    """
)
def dq_summary(t):
    trends = faulty_trends(t)
    return quality.count_violations(
        {
            "bounds": quality.bounds(trends),
            "unique": quality.unique(trends, ["month", "tech_key"]),
            "growth_head": quality.growth_null_head(order_trends(t), SPINE_FIRST),
        }
    )


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def contract_of_orders(t):
    """Columns in any order, checked and put in the declared one."""
    declared = "o_orderkey bigint, o_orderstatus string, o_totalprice double"
    mixed = t.orders.select("o_totalprice", "o_orderstatus", F.col("o_orderkey").cast("bigint").alias("o_orderkey"))
    return quality.enforce_contract(mixed, T.StructType.fromDDL(declared))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def ensured_table_rows(t):
    """A table made where it is missing; asking for it again keeps its rows."""
    rows, path = t.orders.select("o_orderkey", "o_orderstatus"), work_path(t.spark, "ensured")
    name = f"ensured_{path.rsplit('-', 1)[1]}"
    ensure_table(t.spark, name, rows.schema, path)
    rows.write.insertInto(name)
    ensure_table(t.spark, name, rows.schema, path)
    return t.spark.table(name)

"""Serving queries: series, listings, paging, search, lookups, comparisons."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidegauge.functions.dates import month_of
from tidegauge.operators.compare import changed_keys, missing_keys, reconcile
from tidegauge.operators.paging import indexed_page, write_ordered
from tidegauge.operators.series import (
    fetch_all,
    flatten_series,
    get_trends,
    list_terms,
    lookup_names,
    page,
    page_after,
    page_info,
    pivot_series,
    search_terms,
    series_points,
    trend_filter,
    trend_request,
)
from tidegauge.plans.registered.registry import query
from tidegauge.plans.registered.trends import MART_SQL, order_trends
from tidegauge.session import work_path

REQUEST = trend_request("1-URGENT,5-LOW,3-MEDIUM,nothing", end="1999-03-15", start="1994-11-02")

_POINTS_SQL = f"""
    SELECT tech_key, tech_name AS name, strftime(month, '%Y-%m') AS month, mention_count AS count
    FROM ({MART_SQL})
    WHERE tech_key IN ('1-URGENT', '5-LOW', '3-MEDIUM', 'nothing')
      AND month BETWEEN DATE '1994-11-02' AND DATE '1999-03-15'
"""


def _points(t):
    return series_points(order_trends(t), REQUEST.keys, REQUEST.start, REQUEST.end)


@query(_POINTS_SQL)
def trend_series(t):
    """Grouped series of several keys, flattened again for comparison."""
    series = get_trends(order_trends(t), REQUEST.keys, REQUEST.start, REQUEST.end)
    return flatten_series(series)


@query(
    f"""
    SELECT tech_key, name, count(*) AS n_points, min(month) AS first_month,
           max(month) AS last_month
    FROM ({_POINTS_SQL}) GROUP BY 1, 2
    """
)
def trend_series_shape(t):
    series = get_trends(order_trends(t), REQUEST.keys, REQUEST.start, REQUEST.end)
    return series.select(
        "tech_key",
        "name",
        F.size("data").cast("bigint").alias("n_points"),
        F.element_at("data", 1)["month"].alias("first_month"),
        F.element_at("data", -1)["month"].alias("last_month"),
    )


@query(
    f"""
    SELECT month AS date,
           max(count) FILTER (WHERE tech_key = '1-URGENT') AS "1-URGENT",
           max(count) FILTER (WHERE tech_key = '5-LOW') AS "5-LOW",
           max(count) FILTER (WHERE tech_key = 'nothing') AS nothing
    FROM ({_POINTS_SQL}) WHERE tech_key <> '5-LOW' OR month >= '1997-01'
    GROUP BY 1
    """
)
def pivot_of_series(t):
    """Wide points; one key starts late, one never, so cells are absent."""
    points = _points(t).filter((F.col("tech_key") != "5-LOW") | (F.col("month") >= "1997-01"))
    return pivot_series(points, ["1-URGENT", "5-LOW", "nothing"])


@query(
    """
    SELECT n.n_name AS key, upper(n.n_name) AS name, r.r_name AS category
    FROM nation AS n JOIN region AS r ON n.n_regionkey = r.r_regionkey
    WHERE n.n_nationkey IN (SELECT c_nationkey FROM customer)
    """
)
def list_terms_of_nations(t):
    """Nations with customers: repeated fact keys do not multiply the list."""
    taxonomy = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("tech_key"),
        F.upper("n_name").alias("display_name"),
        F.col("r_name").alias("category"),
        F.col("n_nationkey"),
    )
    facts = (
        t.customer
        .join(taxonomy, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("tech_key")
    )
    return list_terms(taxonomy, facts)


@query(
    """
    SELECT p_partkey, p_name FROM part
    WHERE lower(p_name) LIKE '%ring%' AND p_brand NOT IN ('Brand#2', 'Brand#17')
    """
)
def term_search(t):
    found = search_terms(t.part, "  RiNG ", ["Brand#2", "Brand#17"], key="p_brand", name="p_name")
    return found.select("p_partkey", "p_name")


@query(
    """
    SELECT o_orderkey AS position, o_custkey AS key,
           coalesce(c.c_name, CAST(o_custkey AS VARCHAR)) AS name
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) AS c
         ON o_custkey = c.c_custkey
    """
)
def lookup_fallback(t):
    """Customer names of orders; customers in debt are unknown to the dimension."""
    keys = t.orders.select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("key"))
    dim = t.customer.filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name")
    )
    return lookup_names(keys, dim)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40")
def page_terms(t):
    return page(t.part.select("p_partkey", "p_name"), ["p_name", "p_partkey"], 20, 40)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40")
def page_after_terms(t):
    """The same page, found by the last row of the page before."""
    rows, order = t.part.select("p_partkey", "p_name"), ["p_name", "p_partkey"]
    before = page(rows, order, 1, 39).first()
    return page_after(rows, order, None if before is None else [before["p_name"], before["p_partkey"]], 20)


_LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber"]


@query(
    f"""
    SELECT l_shipdate, l_orderkey, l_linenumber FROM lineitem
    ORDER BY {", ".join(_LINE_ORDER)} LIMIT 500 OFFSET (SELECT count(*) * 9 // 10 FROM lineitem)
    """
)
def page_of_ranges(t):
    """A page nine tenths down all lines: only the ranges that hold it are read."""
    path = work_path(t.spark, "ordered")
    total = write_ordered(t.lineitem.select(*_LINE_ORDER), path, _LINE_ORDER, range_rows=1000)
    return indexed_page(t.spark, path, _LINE_ORDER, 500, total * 9 // 10)


@query(
    """
    WITH actual AS (
        SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1
    ), source AS (
        SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders
        WHERE o_orderstatus <> 'F' GROUP BY 1
    )
    SELECT coalesce(a.o_custkey, s.o_custkey) AS o_custkey,
           CASE WHEN s.o_custkey IS NULL THEN 'added' WHEN a.o_custkey IS NULL THEN 'removed'
                ELSE 'changed' END AS change
    FROM actual AS a FULL JOIN source AS s ON a.o_custkey = s.o_custkey
    WHERE a.n IS DISTINCT FROM s.n OR a.last IS DISTINCT FROM s.last
    """
)
def changed_customers(t):
    """Customers whose summary changes with closed orders, found by digests of buckets."""
    def summary(orders):
        return orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last"))

    open_orders = t.orders.filter("o_orderstatus <> 'F'")
    return changed_keys(summary(t.orders), summary(open_orders), ["o_custkey"], ["n", "last"])


@query(
    """
    SELECT count(*) AS total_count, CAST(3 AS BIGINT) AS page, CAST(20 AS BIGINT) AS page_size,
           3 * 20 < count(*) AS has_more
    FROM part
    """
)
def page_meta(t):
    return page_info(t.part, 3, 20)


@query(
    """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 250000.0
    """
)
def param_query(t):
    return fetch_all(
        t.spark,
        "SELECT o_orderkey, o_totalprice FROM {orders} "
        "WHERE o_orderpriority = :priority AND o_totalprice > :floor",
        {"priority": "1-URGENT", "floor": 250000.0},
        orders=t.orders,
    )


@query(
    """
    SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS at FROM orders
    UNION ALL
    SELECT 'shipment', l_orderkey, l_shipdate FROM lineitem
    """
)
def union_activity(t):
    orders = t.orders.select(
        F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at")
    )
    shipments = t.lineitem.select(
        F.lit("shipment").alias("kind"),
        F.col("l_orderkey").alias("id"),
        F.col("l_shipdate").alias("at"),
    )
    return orders.unionByName(shipments)


_RECONCILE_SQL = """
    WITH a AS (
        SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n
        FROM orders GROUP BY 1
    ), s AS (
        SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
               count(DISTINCT l_orderkey) AS n
        FROM lineitem GROUP BY 1
    ), c AS (
        SELECT coalesce(a.month, s.month) AS month, coalesce(s.n, 0) AS source_count,
               coalesce(a.n, 0) AS mart_count,
               abs(coalesce(a.n, 0) - coalesce(s.n, 0)) AS abs_diff,
               CASE WHEN coalesce(s.n, 0) = 0 THEN NULL
                    ELSE CAST(abs(coalesce(a.n, 0) - s.n) AS DOUBLE) * 100.0
                         / CAST(s.n AS DOUBLE) END AS pct_diff
        FROM a FULL JOIN s ON a.month = s.month
    )
    SELECT * FROM c WHERE abs_diff > 1 OR (pct_diff IS NOT NULL AND pct_diff > 1.0)
"""


@query(_RECONCILE_SQL)
def reconcile_months(t):
    """Orders placed against orders shipped, month by month."""
    placed = t.orders.groupBy(month_of("o_orderdate").alias("month")).agg(
        F.count(F.lit(1)).alias("placed")
    )
    shipped = t.lineitem.groupBy(month_of("l_shipdate").alias("month")).agg(
        F.count_distinct("l_orderkey").alias("shipped")
    )
    return reconcile(placed, shipped, ["month"], "placed", "shipped")


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_order_keys(t):
    shipped = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return missing_keys(t.orders, shipped, ["o_orderkey"])


@query(
    """
    SELECT o_orderkey FROM orders
    WHERE o_orderpriority IN ('2-HIGH', '5-LOW')
      AND o_orderdate BETWEEN TIMESTAMP '1996-02-10' AND TIMESTAMP '1996-05-01'
    """
)
def keyed_range_filter(t):
    """Key list and inclusive range, pushed to the scan."""
    wanted = trend_filter(
        ["2-HIGH", "5-LOW"],
        F.lit(dt.date(1996, 2, 10)).cast("timestamp_ntz"),
        F.lit(dt.date(1996, 5, 1)).cast("timestamp_ntz"),
        "o_orderpriority",
        "o_orderdate",
    )
    return t.orders.filter(wanted).select("o_orderkey")

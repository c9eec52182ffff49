"""Trees: closures, whole threads, thread lookup."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidegauge.functions.dates import month_of
from tidegauge.functions.jsonfields import json_project
from tidegauge.operators.tree import (
    collect_threads,
    descendants,
    find_threads,
    first_match,
    mark_missing,
    tree_edges,
)
from tidegauge.plans.pipeline import ingest_months
from tidegauge.plans.registered.registry import query
from tidegauge.plans.registered.text import _TITLE_SQL, MONTH_NUMBER_SQL, YEAR_SQL, titles
from tidegauge.session import work_path
from tidegauge.sources.bronze import read_bronze

# Room for the turns of one conversation in an item id.
TURNS = 1_000_000_000


def turn_items(t):
    """Turns as items: a turn's only kid is the next turn, so the last one's is missing."""
    item = F.col("conv_id") * TURNS + F.col("turn")
    return t.conversations.select(item.alias("id"), F.array(item + 1).alias("kids"))


_CLOSURE_SQL = f"""
    WITH RECURSIVE items AS (
        SELECT conv_id * {TURNS} + turn AS id FROM conversations
    ), walk AS (
        SELECT id AS root, id, CAST(0 AS BIGINT) AS depth FROM items WHERE id % {TURNS} = 0
        UNION ALL
        SELECT w.root, w.id + 1, w.depth + 1 FROM walk AS w JOIN items AS i ON i.id = w.id
    )
    SELECT w.root, w.id, w.depth, i.id IS NULL AS is_tombstone
    FROM walk AS w LEFT JOIN items AS i ON i.id = w.id
"""


@query(_CLOSURE_SQL)
def thread_closure(t):
    items = turn_items(t)
    roots = items.filter(F.col("id") % TURNS == 0).select(F.col("id").alias("root"))
    return mark_missing(descendants(items, roots), items)


@query(f"SELECT root, id, depth FROM ({_CLOSURE_SQL}) WHERE depth <= 2")
def thread_closure_two_levels(t):
    items = turn_items(t)
    roots = items.filter(F.col("id") % TURNS == 0).select(F.col("id").alias("root"))
    return descendants(items, roots, max_depth=2)


@query(
    f"""
    SELECT root, id, min(depth) AS depth FROM (
        SELECT root, id, depth FROM ({_CLOSURE_SQL})
        UNION ALL
        SELECT w.root - {TURNS}, w.id, w.depth + 1 FROM ({_CLOSURE_SQL}) AS w
        WHERE w.root // {TURNS} % 2 = 1
          AND EXISTS (SELECT 1 FROM conversations AS c WHERE c.conv_id = w.root // {TURNS} - 1 AND c.turn = 0)
    ) GROUP BY root, id
    """
)
def thread_closure_with_repeat(t):
    """Every even conversation's first turn also lists the next conversation's first turn,
    which is a root itself: threads reached twice, from two roots."""
    first = t.conversations.filter("turn = 0").select((F.col("conv_id") * TURNS).alias("id"))
    items = turn_items(t)
    extra = first.filter(F.col("id") / TURNS % 2 == 0).select("id", F.array(F.col("id") + TURNS).alias("kids"))
    known = extra.join(first.select((F.col("id") - TURNS).alias("id")), "id", "left_semi")
    return descendants(items.unionByName(known), first.withColumnRenamed("id", "root"))


def _shop_edges(t):
    """Regions own nations, nations customers, customers orders; nations own closed
    orders as well, so an order may have two parents. Ids are spread by kind."""
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    nation_of = t.customer.select("c_custkey", "c_nationkey")
    closed = orders.filter("o_orderstatus = 'F'").join(
        nation_of, F.col("o_custkey") == F.col("c_custkey")
    )

    def pairs(df, parent, parent_kind, child, child_kind):
        return df.select(
            (F.col(parent).cast("bigint") * 10 + parent_kind).alias("id"),
            F.array(F.col(child).cast("bigint") * 10 + child_kind).alias("kids"),
        )

    return (
        pairs(t.nation, "n_regionkey", 1, "n_nationkey", 2)
        .unionByName(pairs(t.customer, "c_nationkey", 2, "c_custkey", 3))
        .unionByName(pairs(orders, "o_custkey", 3, "o_orderkey", 4))
        .unionByName(pairs(closed, "c_nationkey", 2, "o_orderkey", 4))
    )


@query(
    """
    WITH owned AS (
        SELECT CAST(n.n_regionkey AS BIGINT) * 10 + 1 AS root,
               CAST(n.n_nationkey AS BIGINT) * 10 + 2 AS nation, c.c_custkey, o.o_orderkey,
               o.o_orderstatus
        FROM nation AS n
        LEFT JOIN customer AS c ON c.c_nationkey = n.n_nationkey
        LEFT JOIN orders AS o ON o.o_custkey = c.c_custkey
    )
    SELECT root, id, min(depth) AS depth FROM (
        SELECT root, root AS id, CAST(0 AS BIGINT) AS depth FROM owned
        UNION ALL SELECT root, nation, 1 FROM owned
        UNION ALL SELECT root, c_custkey * 10 + 3, 2 FROM owned WHERE c_custkey IS NOT NULL
        UNION ALL SELECT root, o_orderkey * 10 + 4, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 3 END
                  FROM owned WHERE o_orderkey IS NOT NULL
    ) GROUP BY root, id
    """
)
def graph_closure(t):
    """Closure where ids have several parents: the shortest way counts."""
    roots = t.nation.select((F.col("n_regionkey").cast("bigint") * 10 + 1).alias("root"))
    return descendants(_shop_edges(t), roots)


@query(
    f"""
    SELECT DISTINCT id AS parent, id + 1 AS child
    FROM (SELECT conv_id * {TURNS} + turn AS id FROM conversations)
    """
)
def thread_edges(t):
    items = turn_items(t)
    return tree_edges(items.unionByName(items))


_RECORDS_SQL = f"""
    SELECT c.id, c.type, c."by", c.n_kids, c.deleted, c.is_tombstone
    FROM (
        SELECT w.id, CASE WHEN i.role IS NOT NULL THEN 'comment' END AS type, i.role AS "by",
               CASE WHEN i.role IS NOT NULL THEN 1 ELSE 0 END AS n_kids,
               i.role IS NULL AS deleted, i.role IS NULL AS is_tombstone
        FROM (SELECT DISTINCT id FROM ({_CLOSURE_SQL})) AS w
        LEFT JOIN (SELECT conv_id * {TURNS} + turn AS id, role FROM conversations) AS i
               ON i.id = w.id
    ) AS c
"""


@query(_RECORDS_SQL)
def thread_records(t):
    """Whole threads as records ready to land, with tombstones for missing turns."""
    return _landed(turn_records(t))


def turn_records(t):
    """Turns as full item records."""
    item = F.col("conv_id") * TURNS + F.col("turn")
    none = F.lit(None)
    return t.conversations.select(
        item.alias("id"),
        F.lit("comment").alias("type"),
        F.col("role").alias("by"),
        none.cast("timestamp").alias("time"),
        "text",
        none.cast("string").alias("title"),
        none.cast("string").alias("url"),
        F.array(item + 1).alias("kids"),
        none.cast("bigint").alias("parent"),
        none.cast("bigint").alias("score"),
        none.cast("bigint").alias("descendants"),
        F.lit(False).alias("deleted"),
        F.lit(False).alias("dead"),
    )


def _landed(items):
    roots = items.filter(F.col("id") % TURNS == 0).select(F.col("id").alias("root"))
    return collect_threads(items, roots).select(
        "id", "type", "by", F.size("kids").alias("n_kids"), "deleted", "is_tombstone"
    )


@query(_RECORDS_SQL)
def thread_records_of_doubled_items(t):
    """Every item landed twice, the second time without an author: each record once."""
    items = turn_records(t)
    return _landed(items.unionByName(items.withColumn("by", F.lit(None).cast("string"))))


# Stories that one user has submitted.
STORIES = 16

_INGEST_SQL = f"""
    WITH stories AS (
        SELECT conv_id * {TURNS} AS id, 2024 + conv_id % 2 AS year, conv_id % 12 + 1 AS month
        FROM conversations WHERE turn = 0
    ), asked AS (
        SELECT min(id) AS id FROM stories GROUP BY id // {TURNS} // {STORIES}, year, month
    )
    SELECT w.id, w.is_tombstone FROM ({_CLOSURE_SQL}) AS w WHERE w.root IN (SELECT id FROM asked)
"""


@query(_INGEST_SQL)
def ingest_roundtrip(t):
    """Find each user's threads of all months, walk them, land them whole and read the landing back.

    First turns are stories titled by month; a user has submitted 16 of them in a row, so
    some months name two of a user's stories, of which the first counts."""
    number = F.floor(F.col("id") / TURNS)
    month = F.make_date(F.lit(2024) + (number % 2).cast("int"), (number % 12 + 1).cast("int"), F.lit(1))
    title = F.concat(F.lit("Who is hiring? ("), F.date_format(month, "MMMM yyyy"), F.lit(")"))
    first = F.col("id") % TURNS == 0
    items = turn_records(t)
    items = items.withColumn("type", F.when(first, "story").otherwise("comment")).withColumn("title", F.when(first, title))
    stories = items.filter(first).select("id", month.alias("month"))
    user = F.concat(F.lit("poster-"), F.floor(number / STORIES).cast("string"))
    users = stories.groupBy(user.alias("id")).agg(F.sort_array(F.collect_list("id")).alias("submitted"))
    path = work_path(t.spark, "ingested")
    months = [r["month"] for r in stories.select("month").distinct().orderBy("month").collect()]
    ingest_months(users, items, months, path, dt.date(2026, 1, 1), "load", dt.datetime(2026, 1, 1))
    fields = {"id": ("id", "bigint"), "is_tombstone": ("is_tombstone", "boolean")}
    return json_project(read_bronze(t.spark, path), "payload", fields, keep=[])


_TITLED_SQL = f"""
    SELECT conv_id * {TURNS} + turn AS id, {YEAR_SQL} AS year, {MONTH_NUMBER_SQL} AS month
    FROM ({_TITLE_SQL}) WHERE turn % 2 = 0
"""


@query(
    f"""
    SELECT l.user_name AS "user", i.year, i.month, arg_min(i.id, l.pos) AS thread_id
    FROM (
        SELECT role || '-' || CAST(conv_id AS VARCHAR) AS user_name,
               conv_id * {TURNS} + turn + unnest([2, 1, 0]) AS id, unnest([0, 1, 2]) AS pos
        FROM conversations
    ) AS l
    JOIN ({_TITLED_SQL}) AS i ON i.id = l.id
    WHERE i.year IS NOT NULL AND i.month IS NOT NULL
    GROUP BY ALL
    """
)
def threads_by_month(t):
    """First story in list order that names a month, per user and month.

    Every turn is a list of the turns two ahead, one ahead and itself; turns of
    even number are stories.
    """
    item = F.col("conv_id") * TURNS + F.col("turn")
    items = titles(t).select(
        item.alias("id"),
        F.when(F.col("turn") % 2 == 0, "story").otherwise("comment").alias("type"),
        "title",
    )
    users = t.conversations.select(
        F.concat_ws("-", "role", "conv_id").alias("id"),
        F.array(item + 2, item + 1, item).alias("submitted"),
    )
    return find_threads(users, items)


@query(
    """
    SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
           arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey
    FROM orders GROUP BY 1, 2
    """
)
def first_match_by_position(t):
    """Cheapest order of each customer and month: position is the price."""
    placed = t.orders.withColumn("month", month_of("o_orderdate"))
    return first_match(placed, ["o_custkey", "month"], "o_orderkey", ["o_totalprice", "o_orderkey"])

"""Landing, bronze, reference data, tables, month-wise reruns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.dates import month_of
from tidegauge.functions.jsonfields import json_project
from tidegauge.plans.registered.registry import query
from tidegauge.session import work_path
from tidegauge.sources.bronze import append_bronze, load_stats, read_bronze, to_payload
from tidegauge.sources.ledger import backfill_months, commit_load, compact_loads, read_loads, read_months
from tidegauge.sources.landing import read_landing, read_taxonomy, reject_bad_payloads
from tidegauge.sources.tables import run_partitions, write_months, write_table

EVENT_FIELDS = {
    "event_id": ("event_id", "bigint"),
    "ts": ("ts", "timestamp_ntz"),
    "user_id": ("user_id", "bigint"),
    "event_type": ("event_type", "string"),
    "value": ("value", "double"),
    "k": ("props_k", "bigint"),
}
FIRST_LOAD, SECOND_LOAD = "load-1", "load-2"
FIRST_STAMP = dt.datetime(2024, 2, 1)
SECOND_STAMP = dt.datetime(2024, 3, 1)


def event_payloads(t):
    """Events as landed payloads; errors stand for tombstones."""
    events = t.events.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").alias("props_k"),
        (F.col("event_type") == "error").alias("is_tombstone"),
    )
    return to_payload(events)


def land_events_twice(t, name: str) -> str:
    path = work_path(t.spark, name)
    append_bronze(event_payloads(t), path, FIRST_LOAD, FIRST_STAMP)
    append_bronze(event_payloads(t), path, SECOND_LOAD, SECOND_STAMP)
    return path


@query(
    """
    SELECT event_id, ts, user_id, event_type, value,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
    FROM events
    """
)
def bronze_fields(t):
    return json_project(event_payloads(t), "payload", EVENT_FIELDS, keep=[])


@query(
    """
    SELECT event_id, ts, user_id, event_type, value,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
    FROM events
    """
)
def landing_files(t):
    """Landed JSON files read back as payload text, all fields."""
    path = work_path(t.spark, "landing")
    event_payloads(t).write.text(path)
    return json_project(read_landing(t.spark, path), "payload", EVENT_FIELDS, keep=[])


@query(
    """
    SELECT event_id, user_id, event_type, value
    FROM events
    """
)
def landing_files_typed(t):
    path = work_path(t.spark, "landing")
    event_payloads(t).write.text(path)
    schema = "event_id bigint, user_id bigint, event_type string, value double"
    return read_landing(t.spark, path, T.StructType.fromDDL(schema))


@query(
    """
    SELECT l.load_id, l.ingested_at, e.event_id, e.event_type
    FROM events AS e
    CROSS JOIN (
        VALUES ('load-1', TIMESTAMP '2024-02-01 00:00:00'),
               ('load-2', TIMESTAMP '2024-03-01 00:00:00')
    ) AS l(load_id, ingested_at)
    """
)
def bronze_append_roundtrip(t):
    bronze = read_bronze(t.spark, land_events_twice(t, "bronze"))
    fields = {k: EVENT_FIELDS[k] for k in ("event_id", "event_type")}
    rows = json_project(bronze, "payload", fields, keep=["load_id", "ingested_at"])
    return rows.withColumn("ingested_at", F.col("ingested_at").cast("timestamp_ntz"))


@query(
    """
    SELECT l.load_id, count(*) AS item_count,
           count(*) FILTER (WHERE e.event_type = 'error') AS tombstone_count
    FROM events AS e
    CROSS JOIN (VALUES ('load-1'), ('load-2')) AS l(load_id)
    GROUP BY l.load_id
    """
)
def bronze_load_stats(t):
    return load_stats(read_bronze(t.spark, land_events_twice(t, "bronze")))


@query(
    """
    SELECT CAST(user_id AS VARCHAR) AS load_id, count(*) AS item_count,
           count(*) FILTER (WHERE event_type = 'error') AS tombstone_count
    FROM events
    GROUP BY user_id
    """
)
def load_stats_typed(t):
    """Load statistics over typed rows: users stand for loads."""
    rows = t.events.select(
        F.col("user_id").cast("string").alias("load_id"),
        (F.col("event_type") == "error").alias("is_tombstone"),
    )
    return load_stats(rows)


@query("SELECT count(*) AS n_rows FROM events")
def bronze_count(t):
    path = work_path(t.spark, "bronze")
    append_bronze(event_payloads(t), path, FIRST_LOAD, FIRST_STAMP)
    return read_bronze(t.spark, path, ["load_id"]).agg(F.count(F.lit(1)).alias("n_rows"))


def _cut_payloads(t):
    """Event properties, cut short for errors."""
    cut = F.expr("left(props, length(props) - 1)")
    return t.events.select(
        "event_id", F.when(F.col("event_type") == "error", cut).otherwise(F.col("props")).alias("payload")
    )


_CUT_SQL = """
    SELECT event_id,
           CASE WHEN event_type = 'error' THEN left(props, length(props) - 1) ELSE props END
               AS payload
    FROM events
"""


@query(
    f"""
    SELECT event_id, payload, 'invalid_json' AS reason
    FROM ({_CUT_SQL}) WHERE NOT json_valid(payload)
    """
)
def bad_payloads(t):
    return reject_bad_payloads(_cut_payloads(t))[1]


@query(f"SELECT event_id, payload FROM ({_CUT_SQL}) WHERE json_valid(payload)")
def good_payloads(t):
    return reject_bad_payloads(_cut_payloads(t))[0]


_TAXONOMY_SQL = r"""
    SELECT CAST(p_partkey AS VARCHAR) AS tech_key, p_name AS display_name,
           p_type || ', "' || p_brand || '"' AS category,
           '\b(' || replace(p_name, ' ', '\s+') || '|"' || p_brand || '",x)\b' AS regex_pattern
    FROM part
"""


@query(_TAXONOMY_SQL)
def taxonomy_scan(t):
    """A taxonomy CSV with quotes, commas and backslashes, written and read back."""
    path = work_path(t.spark, "taxonomy")
    rows = t.part.select(
        F.col("p_partkey").cast("string").alias("tech_key"),
        F.col("p_name").alias("display_name"),
        F.concat("p_type", F.lit(', "'), "p_brand", F.lit('"')).alias("category"),
        F.concat(
            F.lit(r"\b("),
            F.replace("p_name", F.lit(" "), F.lit(r"\s+")),
            F.lit('|"'),
            "p_brand",
            F.lit(r'",x)\b'),
        ).alias("regex_pattern"),
    )
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return read_taxonomy(t.spark, path)


@query(
    """
    SELECT o_orderpriority, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
    FROM orders GROUP BY o_orderpriority
    """
)
def table_rebuild(t):
    """A partitioned table rebuilt twice holds the rows once."""
    path = work_path(t.spark, "rebuild")
    for _ in range(2):
        write_table(t.orders, path, partition_by="o_orderpriority")
    return (
        t.spark.read.parquet(path)
        .groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("key_sum"))
    )


BACKFILL = [dt.date(1996, m, 1) for m in range(1, 13)]
AS_OF = dt.date(2002, 1, 15)


def _orders_per_month(orders):
    return orders.groupBy("month").agg(
        F.count(F.lit(1)).alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers")
    )


@query(
    """
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
           count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers
    FROM orders
    WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'
    GROUP BY 1
    """
)
def months_backfill(t):
    return run_partitions(t.orders, "o_orderdate", BACKFILL, _orders_per_month, AS_OF)


@query(
    """
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n_orders,
           CASE WHEN year(any_value(o_orderdate)) = 1996 THEN 2 ELSE 1 END AS run_no
    FROM orders GROUP BY 1
    """
)
def months_rerun(t):
    """All months written by one run, the months of 1996 replaced by a second."""
    path = work_path(t.spark, "months")
    counts = t.orders.groupBy(month_of("o_orderdate").alias("month")).agg(
        F.count(F.lit(1)).alias("n_orders")
    )
    write_months(counts.withColumn("run_no", F.lit(1)), path)
    again = run_partitions(
        t.orders,
        "o_orderdate",
        BACKFILL,
        lambda df: df.groupBy("month").agg(F.count(F.lit(1)).alias("n_orders")),
        AS_OF,
    )
    write_months(again.withColumn("run_no", F.lit(2)), path)
    return t.spark.read.parquet(path).select("month", "n_orders", "run_no")


@query(
    """
    SELECT event_type AS load_id, TIMESTAMP '2024-02-01 00:00:00' AS ingested_at, count(*) AS n_rows,
           sum(event_id) AS id_sum
    FROM events GROUP BY event_type
    """
)
def loads_by_ledger(t):
    """Events committed load by load (types stand for loads), a retried and a replaced
    load among them, then compacted."""
    path = work_path(t.spark, "ledger")
    types = [r[0] for r in t.events.select("event_type").distinct().orderBy("event_type").collect()]
    for name in types:
        own = event_payloads(t).filter(F.get_json_object("payload", "$.event_type") == name)
        if name == types[0]:
            commit_load(own.filter(F.get_json_object("payload", "$.event_id").cast("long") % 2 == 0), path, name, FIRST_STAMP)
        commit_load(own, path, name, FIRST_STAMP, replace=name == types[0])
    commit_load(own, path, types[-1], SECOND_STAMP)
    compact_loads(t.spark, path)
    rows = json_project(read_loads(t.spark, path), "payload", {"event_id": ("event_id", "bigint")}, keep=["load_id", "ingested_at"])
    return rows.groupBy("load_id", F.col("ingested_at").cast("timestamp_ntz").alias("ingested_at")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("event_id").alias("id_sum")
    )


@query(
    """
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n_orders, max(o_orderkey) AS last_key
    FROM orders
    WHERE date_trunc('month', o_orderdate) BETWEEN DATE '1996-01-01' AND DATE '1996-06-01'
      AND date_trunc('month', o_orderdate) <> DATE '1996-03-01'
    GROUP BY 1
    """
)
def months_by_ledger(t):
    """A backfill whose third month fails: the others have landed; it goes on afterwards."""
    path = work_path(t.spark, "month-ledger")
    months = [dt.date(1996, m, 1) for m in range(1, 7)]

    def counts(rows):
        if not rows.filter("month = date'1996-03-01'").isEmpty():
            raise ValueError("a month that cannot be transformed")
        return rows.groupBy("month").agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_orderkey").alias("last_key"))

    for asked in (months[:4], months):
        backfill_months(t.orders, "o_orderdate", asked, counts, path, dt.date(1998, 1, 1))
    return read_months(t.spark, path, "month date, n_orders bigint, last_key bigint")

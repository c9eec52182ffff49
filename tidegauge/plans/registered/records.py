"""Validation, tombstones, latest version per key, staging."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.dates import month_label, month_of
from tidegauge.operators.staging import latest_by, stage_records
from tidegauge.operators.tree import tombstones
from tidegauge.operators.validate import (
    classify_items,
    classify_users,
    series_violations,
    split_valid,
    term_violations,
)
from tidegauge.plans.registered.registry import query
from tidegauge.sources.bronze import to_payload

KNOWN_TYPES = ["click", "view", "purchase", "signup"]


def _item_payloads(t):
    """Events as item records: unknown type for errors, no time for low values of
    views, a cut-off payload for low values of signups."""
    low = F.col("value") < 5
    time = F.when(~((F.col("event_type") == "view") & low), F.unix_seconds(F.col("ts").cast("timestamp")))
    record = F.struct(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("type"),
        time.alias("time"),
        F.col("user_id").cast("string").alias("by"),
        F.array("user_id").alias("kids"),
        F.lit("ignored").alias("unknown_field"),
    )
    whole = F.to_json(record, {"ignoreNullFields": "true"})
    cut = F.expr("left(__p, length(__p) - 2)")
    return (
        t.events.withColumn("__p", whole)
        .withColumn(
            "payload", F.when((F.col("event_type") == "signup") & low, cut).otherwise(F.col("__p"))
        )
        .select("event_id", "payload")
    )


_REASON_SQL = """
    CASE WHEN event_type = 'signup' AND value < 5 THEN 'invalid_json'
         WHEN event_type = 'view' AND value < 5 THEN 'missing_time'
         WHEN event_type = 'error' THEN 'unknown_type' END
"""


@query(f"SELECT event_id, {_REASON_SQL} AS reason FROM events")
def validate_records(t):
    return classify_items(_item_payloads(t), types=KNOWN_TYPES).select("event_id", "reason")


@query(
    f"""
    SELECT event_id AS id, event_type AS type, CAST(user_id AS VARCHAR) AS "by",
           date_trunc('second', ts) AS time, 1 AS n_kids, 0 AS n_parts, false AS deleted,
           false AS dead
    FROM events WHERE {_REASON_SQL} IS NULL
    """
)
def validated_items(t):
    good, _ = split_valid(classify_items(_item_payloads(t), types=KNOWN_TYPES))
    return good.select(
        "id",
        "type",
        "by",
        F.col("time").cast("timestamp_ntz").alias("time"),
        F.size("kids").alias("n_kids"),
        F.size("parts").alias("n_parts"),
        "deleted",
        "dead",
    )


@query(
    """
    SELECT c_custkey,
           CASE WHEN c_mktsegment = 'BUILDING' THEN 'bad_created'
                WHEN c_acctbal < 0 THEN 'missing_karma' END AS reason
    FROM customer
    """
)
def validate_user_records(t):
    """Customers as user records: no karma on debt, an unreadable date for one segment."""
    record = F.struct(
        F.col("c_name").alias("id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "last year").otherwise("1175714200").alias(
            "created"
        ),
        F.when(F.col("c_acctbal") >= 0, F.floor("c_acctbal")).alias("karma"),
        F.array("c_custkey").alias("submitted"),
    )
    payloads = t.customer.select("c_custkey", F.to_json(record).alias("payload"))
    return classify_users(payloads).select("c_custkey", "reason")


@query(
    """
    SELECT o_orderkey AS id, CAST(NULL AS VARCHAR) AS type, 0 AS n_kids, true AS deleted,
           false AS dead, true AS is_tombstone
    FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    """
)
def tombstones_of_orders(t):
    """Orders nobody shipped anything for: referenced ids without an item."""
    rows = tombstones(t.orders, t.lineitem, child="o_orderkey", item_id="l_orderkey")
    return rows.select("id", "type", F.size("kids").alias("n_kids"), "deleted", "dead", "is_tombstone")


@query(
    """
    SELECT DISTINCT o_orderpriority AS tech_key, o_orderstatus AS name
    FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderstatus = 'P'
    """
)
def series_shape_violations(t):
    """Series with malformed months for one priority, negative counts for another and
    a blank name for one status; the months of a series are few by nature."""
    label = F.when(
        F.col("o_orderpriority") == "1-URGENT", F.date_format("month", "yyyy/MM")
    ).otherwise(month_label("month"))
    count = F.when(F.col("o_orderpriority") == "2-HIGH", -F.col("n")).otherwise(F.col("n"))
    monthly = t.orders.groupBy(
        "o_orderpriority", "o_orderstatus", month_of("o_orderdate").alias("month")
    ).agg(F.count(F.lit(1)).alias("n"))
    point = F.struct(label.alias("month"), count.alias("count"))
    series = monthly.groupBy(F.col("o_orderpriority").alias("tech_key"), "o_orderstatus").agg(
        F.sort_array(F.collect_list(point)).alias("data")
    )
    status = F.col("o_orderstatus")
    named = series.withColumn("name", F.when(status == "P", F.lit("")).otherwise(status))
    return series_violations(named).select("tech_key", F.col("o_orderstatus").alias("name"))


@query("SELECT p_partkey AS key FROM part WHERE p_size < 10 OR p_type = 'ECONOMY'")
def term_shape_violations(t):
    terms = t.part.select(
        F.col("p_partkey").cast("string").alias("key"),
        F.when(F.col("p_size") >= 10, F.col("p_name")).alias("name"),
        F.when(F.col("p_type") == "ECONOMY", "").otherwise(F.col("p_type")).alias("category"),
    )
    return term_violations(terms).select(F.col("key").cast("bigint").alias("key"))


@query(
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
    """
)
def latest_order_per_customer(t):
    return latest_by(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


def event_bronze(t):
    """Events as versions of user records: the id is the user, the stamp the event's.

    Errors are of another type; low values are deleted, middling ones unknown."""
    deleted = F.when(F.col("value") < 2, True).when(F.col("value") >= 4, False)
    record = F.struct(
        F.col("user_id").alias("id"),
        F.when(F.col("event_type") == "error", "story").otherwise("comment").alias("type"),
        F.col("event_type").alias("by"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("time"),
        F.concat(
            F.lit("<p>"), "event_type", F.lit("<br> &amp;\n&#x27;"), F.col("event_id").cast("string"),
            F.lit("&#X27; "),
        ).alias("text"),
        F.col("event_id").alias("parent"),
        deleted.alias("deleted"),
    )
    return t.events.select(
        F.concat(F.lit("load-"), F.col("event_type")).alias("load_id"),
        F.col("ts").cast("timestamp").alias("ingested_at"),
        F.to_json(record).alias("payload"),
    )


STAGED_SQL = """
    SELECT user_id AS id, event_type AS author, date_trunc('second', ts) AS posted_at,
           event_type || ' & ''' || CAST(event_id AS VARCHAR) || '''' AS text,
           event_type || ' & ''' || CAST(event_id AS VARCHAR) || '''' AS full_text,
           event_id AS parent_id, 'load-' || event_type AS load_id, ts AS ingested_at
    FROM events
    WHERE event_type <> 'error' AND value >= 4
    QUALIFY row_number() OVER (PARTITION BY user_id
            ORDER BY ts DESC, event_type DESC, event_id DESC) = 1
"""


def without_zone(silver):
    return silver.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("posted_at", "ingested_at")}
    )


@query(STAGED_SQL)
def staged_events(t):
    return without_zone(stage_records(event_bronze(t)))


@query(STAGED_SQL)
def reingest_idempotent(t):
    """The same load landed twice stages to the same table."""
    bronze = event_bronze(t)
    return without_zone(stage_records(bronze.unionByName(bronze)))


_SHAPES = [
    # What an optional field holds, and the reason it gives.
    ('"by":123', "bad_field"),
    ('"text":{"a":1}', "bad_field"),
    ('"title":true', "bad_field"),
    ('"url":["x"]', "bad_field"),
    ('"kids":null', "bad_field"),
    ('"deleted":null', "bad_field"),
    ('"score":"x"', "bad_field"),
    ('"by":null,"text":"x","kids":["7",8],"dead":false,"score":null', None),
    ('"by":"u"', None),
]


def _shaped(id_: str, shapes: list, first: str, cases: str):
    """A payload of every shape in turn, and the reasons in SQL."""
    number = F.col(id_) % len(shapes)
    optional = F.element_at(F.array(*(F.lit(s) for s, _ in shapes)), (number + 1).cast("int"))
    payload = F.concat(F.lit(first), F.col(id_).cast("string"), F.lit(cases), optional, F.lit("}"))
    return payload


def _reasons(id_: str, shapes: list) -> str:
    named = (f"WHEN {i} THEN '{reason}'" for i, (_, reason) in enumerate(shapes) if reason)
    return f"CASE {id_} % {len(shapes)} {' '.join(named)} END AS reason"


@query(f"SELECT event_id, {_reasons('event_id', _SHAPES)} FROM events")
def validate_typed_records(t):
    """Fields of another JSON type than declared, and nulls where none may be."""
    payload = _shaped("event_id", _SHAPES, '{"id":', ',"type":"comment","time":1700000000,')
    return classify_items(t.events.select("event_id", payload.alias("payload"))).select("event_id", "reason")


_USER_SHAPES = [('"id":7', "bad_id"), ('"id":"u","about":5', "bad_field"), ('"id":"u","submitted":null', "bad_field"), ('"id":"u","about":null', None)]


@query(f"SELECT c_custkey, {_reasons('c_custkey', _USER_SHAPES)} FROM customer")
def validate_typed_users(t):
    payload = _shaped("c_custkey", _USER_SHAPES, '{"karma":', ',"created":1175714200,')
    return classify_users(t.customer.select("c_custkey", payload.alias("payload"))).select("c_custkey", "reason")


@query("SELECT event_id, user_id FROM events")
def landed_records(t):
    """Payload round trip of typed rows: serialise and read back."""
    kept = t.events.select("event_id", "user_id")
    parsed = F.from_json("payload", "event_id bigint, user_id bigint")
    return to_payload(kept).select(parsed.alias("r")).select("r.*")

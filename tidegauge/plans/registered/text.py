"""Field extraction, text cleaning, matching, dates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.dates import MONTH_NAMES, month_label, month_of, parse_month_title, to_utc
from tidegauge.functions.jsonfields import json_project
from tidegauge.functions.metrics import abs_diff, growth_pct, pct_diff, safe_share
from tidegauge.functions.regex import re2_match
from tidegauge.functions.text import nfkc_lower, text_or_empty
from tidegauge.operators.quality import residual_tags
from tidegauge.operators.staging import clean_column, live_records
from tidegauge.plans.registered.registry import query
from tidegauge.sources.bronze import to_payload


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(t):
    return json_project(t.events, "props", {"k": ("k", "bigint")}, keep=["event_id"])


@query(
    """
    SELECT event_id, p->'metadata'->>'source' AS source,
           CAST(p->'metadata'->'version'->>'major' AS BIGINT) AS major
    FROM (
        SELECT event_id, json_object('metadata', json_object('source', event_type,
            'version', json_object('major', user_id))) AS p
        FROM events
    )
    """
)
def json_nested(t):
    version = F.struct(F.col("user_id").alias("major")).alias("version")
    nested = t.events.select(
        "event_id",
        F.to_json(
            F.struct(F.struct(F.col("event_type").alias("source"), version).alias("metadata"))
        ).alias("payload"),
    )
    fields = {
        "source": ("metadata.source", "string"),
        "major": ("metadata.version.major", "bigint"),
    }
    return json_project(nested, "payload", fields, keep=["event_id"])


@query(
    """
    SELECT event_id, CAST(json_array_length(p->'kids') AS INTEGER) AS n_kids,
           CAST(p->'kids'->>0 AS BIGINT) AS first_kid, CAST(p->'kids'->>2 AS BIGINT) AS third_kid
    FROM (
        SELECT event_id, json_object('kids',
            CASE WHEN event_type = 'click' THEN json_array(user_id)
                 ELSE json_array(user_id, event_id, event_id + 1) END) AS p
        FROM events
    )
    """
)
def json_array(t):
    one = F.array("user_id")
    three = F.array(F.col("user_id"), F.col("event_id"), F.col("event_id") + 1)
    kids = F.when(F.col("event_type") == "click", one).otherwise(three)
    payloads = t.events.select("event_id", F.to_json(F.struct(kids.alias("kids"))).alias("payload"))
    fields = {
        "kids": ("kids", "bigint[]"),
        "first_kid": ("kids[0]", "bigint"),
        "third_kid": ("kids[2]", "bigint"),
    }
    return json_project(payloads, "payload", fields, keep=["event_id"]).select(
        "event_id", F.array_size("kids").alias("n_kids"), "first_kid", "third_kid"
    )


@query(
    """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
    FROM events
    WHERE event_type = 'click' AND CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50
    ORDER BY k DESC, event_id
    """
)
def json_filter_sort(t):
    fields = json_project(
        t.events, "props", {"k": ("k", "int")}, keep=["event_id", "event_type"]
    )
    wanted = fields.filter((F.col("event_type") == "click") & (F.col("k") >= 50))
    return wanted.select("event_id", "k").orderBy(F.desc("k"), "event_id")


@query(
    """
    SELECT event_id FROM (
        SELECT event_id, event_type,
               CASE WHEN value < 10 THEN true WHEN value < 20 THEN NULL ELSE false END AS deleted
        FROM events
    ) WHERE event_type = 'click' AND deleted = false
    """
)
def live_filter(t):
    """Null flags drop a row just as deleted ones do."""
    deleted = F.when(F.col("value") < 10, True).when(F.col("value") >= 20, False)
    rows = t.events.withColumn("deleted", deleted)
    return live_records(rows, "click", type_col="event_type").select("event_id")


def _clean_sql(column: str, tag: str = "") -> str:
    steps = [
        ("<[^>]+>", tag, "g"),
        ("&lt;", "<", "g"),
        ("&gt;", ">", "g"),
        ("&amp;", "&", "g"),
        ("&quot;", '"', "g"),
        ("&nbsp;", " ", "g"),
        ("&apos;", "''", "g"),
        ("&#39;", "''", "g"),
        ("&#x27;", "''", "gi"),
        ("&#34;", '"', "g"),
        ("&#x22;", '"', "gi"),
        ("&#38;", "&", "g"),
        ("&#x26;", "&", "gi"),
        ("&#60;", "<", "g"),
        ("&#x3[cC];", "<", "g"),
        ("&#62;", ">", "g"),
        ("&#x3[eE];", ">", "g"),
        ("&#160;|&#x[aA]0;", " ", "g"),
        ("[\\r\\n]+", " ", "g"),
        (" +", " ", "g"),
    ]
    expression = column
    for pattern, replacement, flags in steps:
        expression = f"regexp_replace({expression}, '{pattern}', '{replacement}', '{flags}')"
    return f"trim({expression})"


@query(f"SELECT page_id, {_clean_sql('html')} AS body FROM pages")
def clean_html_pages(t):
    return clean_column(t.spread(t.pages.select("page_id", "html")), "html", "body")


@query(f"SELECT page_id, {_clean_sql('html', ' ')} AS body FROM pages")
def clean_html_spaced(t):
    """Cleaning with a space for every tag, so that words do not run together."""
    return clean_column(t.spread(t.pages.select("page_id", "html")), "html", "body", tag_replacement=" ")


@query(
    f"""
    SELECT doc_id, coalesce({_clean_sql("nullif(text, '')")}, '') AS full_text
    FROM documents
    """
)
def clean_documents(t):
    texts = t.documents.select("doc_id", F.nullif(F.col("text"), F.lit("")).alias("html"))
    return clean_column(texts, "html", "text").select(
        "doc_id", text_or_empty("text").alias("full_text")
    )


@query("SELECT page_id FROM pages WHERE page_id % 3 = 0")
def dq_residual_tags_found(t):
    """Encoded tags survive cleaning: every third page has one and is found."""
    encoded = F.when(F.col("page_id") % 3 == 0, "&lt;b&gt;bold&lt;/b&gt; ").otherwise("plain ")
    html = F.concat(F.lit("<p>"), encoded, F.col("url"), F.lit("<br></p>"))
    cleaned = clean_column(t.pages.select("page_id", html.alias("html")), "html", "body")
    return residual_tags(cleaned, "body").select("page_id")


@query(
    f"""
    SELECT page_id FROM (SELECT page_id, {_clean_sql('html')} AS body FROM pages)
    WHERE regexp_matches(body, '<[^>]+>')
    """
)
def dq_residual_tags(t):
    cleaned = clean_column(t.spread(t.pages.select("page_id", "html")), "html", "body")
    return residual_tags(cleaned, "body").select("page_id")


@query("SELECT doc_id, lower(text) AS norm FROM documents")
def nfkc_lower_documents(t):
    """Normalised text. All driver text is in NFKC already, which lower() relies on here."""
    return t.documents.select("doc_id", nfkc_lower("text").alias("norm"))


@query("SELECT event_id, date_trunc('second', ts) AS at FROM events")
def epoch_to_ts(t):
    epoch = t.events.select(
        "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch")
    )
    return epoch.select(
        "event_id", to_utc("epoch", T.LongType()).cast("timestamp_ntz").alias("at")
    )


@query("SELECT event_id, ts AS iso_at, date_trunc('second', ts) AS epoch_at FROM events")
def text_to_ts(t):
    """ISO text and epoch text, as both occur in payloads."""
    texts = t.events.select(
        "event_id",
        F.concat(F.col("ts").cast("string"), F.lit("+00:00")).alias("iso"),
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("epoch"),
    )
    return texts.select(
        "event_id",
        to_utc("iso").cast("timestamp_ntz").alias("iso_at"),
        to_utc("epoch").cast("timestamp_ntz").alias("epoch_at"),
    )


@query(
    """
    SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
           strftime(o_orderdate, '%Y-%m') AS label
    FROM orders
    """
)
def order_months(t):
    return t.orders.select(
        "o_orderkey",
        month_of("o_orderdate").alias("month"),
        month_label("o_orderdate").alias("label"),
    )


_NAMES = MONTH_NAMES + ["Smarch", "Nov"]
_TITLE_SQL = f"""
    SELECT conv_id, turn,
           left(text, 40) || CASE WHEN role = 'user' THEN ' who''s  hiring ('
                ELSE ' Ask: Who is hiring? (' END
           || list_extract([{', '.join(repr(n) for n in _NAMES)}],
                           CAST(conv_id % {len(_NAMES)} AS INTEGER) + 1)
           || ' ' || CAST(2011 + turn AS VARCHAR) || ')' AS title
    FROM conversations
"""


def titles(t):
    """Conversation turns with a thread title put after their opening words."""
    name = F.element_at(
        F.array(*[F.lit(n) for n in _NAMES]), (F.col("conv_id") % len(_NAMES)).cast("int") + 1
    )
    opening = F.when(F.col("role") == "user", F.lit(" who's  hiring (")).otherwise(
        F.lit(" Ask: Who is hiring? (")
    )
    year = (F.col("turn") + 2011).cast("string")
    return t.conversations.select(
        "conv_id",
        "turn",
        "role",
        F.concat(F.left("text", F.lit(40)), opening, name, F.lit(" "), year, F.lit(")")).alias(
            "title"
        ),
    )


MONTH_NUMBER_SQL = (
    "CAST(nullif(list_position(["
    + ", ".join(repr(m.lower()) for m in MONTH_NAMES)
    + "], lower(regexp_extract(title, '(?i)who(?:''s|\\s+is)\\s+hiring\\??\\s*"
    + "\\((\\w+)\\s+([0-9]{4})\\)', 1))), 0) AS INTEGER)"
)
YEAR_SQL = (
    "CAST(nullif(regexp_extract(title, '(?i)who(?:''s|\\s+is)\\s+hiring\\??\\s*"
    "\\((\\w+)\\s+([0-9]{4})\\)', 2), '') AS INTEGER)"
)


@query(
    f"""
    SELECT conv_id, turn, CASE WHEN month IS NOT NULL THEN year END AS year, month
    FROM (SELECT conv_id, turn, {YEAR_SQL} AS year, {MONTH_NUMBER_SQL} AS month
          FROM ({_TITLE_SQL}))
    """
)
def title_month(t):
    named = titles(t).select("conv_id", "turn", parse_month_title("title").alias("named"))
    return named.select("conv_id", "turn", "named.year", "named.month")


@query(
    r"""
    SELECT doc_id, regexp_matches(text, '\b(e|au|le)\b', 'i') AS short_words,
           regexp_matches(text, '\b(s|t|n)\b', 'i') AS single_letters,
           regexp_matches(text, 'é\s+[a-d]+$', 'i') AS accented_end,
           regexp_matches(text, '^.{300}', 'i') AS long_first_line,
           regexp_matches(text, '\Bé\b', 'i') AS inner_boundary
    FROM documents
    """
)
def regex_match(t):
    patterns = {
        "short_words": r"\b(e|au|le)\b",
        "single_letters": r"\b(s|t|n)\b",
        "accented_end": r"é\s+[a-d]+$",
        "long_first_line": "^.{300}",
        "inner_boundary": r"\Bé\b",
    }
    return t.documents.select(
        "doc_id", *[re2_match("text", p).alias(n) for n, p in patterns.items()]
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
           CASE WHEN l_discount = 0 THEN 0.0 ELSE l_tax / l_discount END AS share,
           CASE WHEN l_discount = 0 THEN NULL
                ELSE (l_tax - l_discount) / l_discount * 100 END AS growth,
           abs(l_tax - l_discount) AS difference,
           CASE WHEN l_discount = 0 THEN NULL
                ELSE abs(l_tax - l_discount) * 100.0 / l_discount END AS difference_pct
    FROM lineitem
    """
)
def guarded_ratios(t):
    tax, discount = F.col("l_tax"), F.col("l_discount")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        safe_share(tax, discount).alias("share"),
        growth_pct(tax, discount).alias("growth"),
        abs_diff(tax, discount).alias("difference"),
        pct_diff(tax, discount).alias("difference_pct"),
    )


@query(
    "SELECT CAST(to_json(struct_pack(event_id := event_id, user_id := user_id, "
    "event_type := event_type)) AS VARCHAR) AS payload FROM events"
)
def item_payloads(t):
    """Rows to compact JSON payloads."""
    return to_payload(t.events.select("event_id", "user_id", "event_type"))

"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names and types of the data format (bronze, items, users).
BRONZE = T.StructType(
    [
        T.StructField("load_id", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("payload", T.StringType()),
    ]
)

ITEM = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("by", T.StringType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("kids", T.ArrayType(T.LongType())),
        T.StructField("parent", T.LongType()),
        T.StructField("score", T.LongType()),
        T.StructField("descendants", T.LongType()),
        T.StructField("poll", T.LongType()),
        T.StructField("parts", T.ArrayType(T.LongType())),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("dead", T.BooleanType()),
    ]
)

USER = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("created", T.TimestampType()),
        T.StructField("karma", T.LongType()),
        T.StructField("about", T.StringType()),
        T.StructField("submitted", T.ArrayType(T.LongType())),
    ]
)

TAXONOMY = T.StructType(
    [
        T.StructField("tech_key", T.StringType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("regex_pattern", T.StringType()),
    ]
)

TAXONOMY_DIM = T.StructType(
    [
        T.StructField("tech_key", T.StringType()),
        T.StructField("tech_name", T.StringType()),
    ]
)

TRENDS = T.StructType(
    [
        T.StructField("month", T.DateType()),
        T.StructField("tech_key", T.StringType()),
        T.StructField("tech_name", T.StringType()),
        T.StructField("mention_count", T.LongType()),
        T.StructField("total_jobs", T.LongType()),
        T.StructField("pct_share", T.DoubleType()),
        T.StructField("mom_growth_pct", T.DoubleType()),
        T.StructField("yoy_growth_pct", T.DoubleType()),
    ]
)

SCAN_RULE = T.StructType(
    [
        T.StructField("pattern", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("exceptions", T.ArrayType(T.StringType())),
    ]
)

# Record types and taxonomy categories that pass validation.
ITEM_TYPES = ["story", "comment", "job", "poll", "pollopt"]
CATEGORIES = ["Language", "Framework", "Database", "Cloud", "DevOps", "Tool"]

# The default taxonomy (key, name, category, pattern).
DEFAULT_TAXONOMY = [
    ("python", "Python", "Language", r"\b(python|python3|py3)\b"),
    ("javascript", "JavaScript", "Language", r"\b(javascript|js|ecmascript)\b"),
    ("typescript", "TypeScript", "Language", r"\b(typescript)\b"),
    ("java", "Java", "Language", r"\b(java)\b"),
    ("go", "Go", "Language", r"\b(golang|go\s+programming|go\s+language)\b"),
    ("rust", "Rust", "Language", r"\b(rust)\b"),
    ("c_sharp", "C#", "Language", r"\b(c#|csharp|c-sharp)\b"),
    ("sql", "SQL", "Language", r"\b(sql)\b"),
    ("react", "React", "Framework", r"\b(react|reactjs|react\.js)\b"),
    ("node", "Node.js", "Framework", r"\b(node\.js|nodejs)\b"),
    ("django", "Django", "Framework", r"\b(django)\b"),
    ("fastapi", "FastAPI", "Framework", r"\b(fastapi|fast-api)\b"),
    ("spring", "Spring", "Framework", r"\b(spring\s+boot|spring\s+framework|springframework)\b"),
    ("postgresql", "PostgreSQL", "Database", r"\b(postgresql|postgres|psql)\b"),
    ("mongodb", "MongoDB", "Database", r"\b(mongodb|mongo)\b"),
    ("redis", "Redis", "Database", r"\b(redis)\b"),
    ("aws", "AWS", "Cloud", r"\b(aws|amazon\s+web\s+services)\b"),
    ("gcp", "Google Cloud", "Cloud", r"\b(gcp|google\s+cloud|google\s+cloud\s+platform)\b"),
    ("docker", "Docker", "DevOps", r"\b(docker)\b"),
    ("kubernetes", "Kubernetes", "DevOps", r"\b(kubernetes|k8s)\b"),
]

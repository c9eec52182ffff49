"""Monthly metrics against a plain computation, and the checks over them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.functions.dates import months_between_inclusive
from tidegauge.operators import quality
from tidegauge.operators.events import event_rates
from tidegauge.functions.regex import re2_match
from tidegauge.operators.taxonomy import Term, bridge, pattern_failures, tag_taxonomy
from tidegauge.operators.trends import (
    SPINE_START,
    month_spine,
    monthly_mentions,
    monthly_totals,
    monthly_trends,
    spine_of,
    trends_from_text,
)
from tidegauge.plans.pipeline import (
    MART_TABLES,
    Marts,
    check_marts,
    ingest_months,
    read_marts,
    rebuild,
    trends_of_bronze,
)
from tidegauge.sources.tables import current_version, retire_versions
from tidegauge.sources import schemas
from tidegauge.sources.bronze import load_stats, read_bronze
from tidegauge.sources.landing import default_taxonomy

START, END = dt.date(2022, 11, 1), dt.date(2024, 3, 20)
TERMS = [Term("a", "A", "Tool", r"\b(aa)\b"), Term("b", "B", "Tool", "b+"), Term("z", "Z", "Tool", "zz")]


def _records(seed=3):
    draw = random.Random(seed)
    rows = []
    for number in range(400):
        at = dt.datetime(2022, 10, 1) + dt.timedelta(days=draw.randrange(520))
        if at.month == 7:
            continue
        rows.append((number, at, draw.choice(["aa", "b aa", "bb", "aaa", "", "x"])))
    return rows


def _expected(rows):
    import re

    out = {}
    for key, pattern in (("a", r"\baa\b"), ("b", "b+"), ("z", "zz")):
        shares = []
        for month in months_between_inclusive(START, END):
            texts = [t for _, at, t in rows if (at.year, at.month) == (month.year, month.month)]
            count = sum(bool(re.search(pattern, t)) for t in texts)
            shares.append(count / len(texts) if texts else 0.0)
            growth = []
            for back in (1, 12):
                base = shares[-1 - back] if len(shares) > back else None
                growth.append((shares[-1] - base) / base * 100 if base else None)
            out[month, key] = (count, len(texts), shares[-1], *growth)
    return out


def _collected(frame):
    return {
        (r.month, r.tech_key): (r.mention_count, r.total_jobs, r.pct_share, r.mom_growth_pct, r.yoy_growth_pct)
        for r in frame.collect()
    }


def test_mart_by_bridge_and_in_one_pass(spark, monkeypatch):
    rows = _records()
    frame = spark.createDataFrame(rows, "id bigint, posted_at timestamp, full_text string")
    pairs = bridge(frame, TERMS)
    dim = spark.createDataFrame([(t.key, t.name) for t in TERMS], "tech_key string, tech_name string")
    for unique in (False, True):
        mart = monthly_trends(
            monthly_mentions(pairs, "job_id", "tech_key", "job_posted_at", pairs_unique=unique),
            monthly_totals(frame, "id", "posted_at", ids_unique=unique),
            dim,
            START,
            END,
        )
        assert _collected(mart) == _expected(rows)
    quality.enforce_contract(mart, schemas.TRENDS)
    one_pass = trends_from_text(frame, TERMS, "posted_at", "full_text", START, END)
    assert _collected(one_pass) == _expected(rows)
    quality.enforce_contract(one_pass, schemas.TRENDS)
    monkeypatch.setattr("tidegauge.operators.taxonomy.TERMS_PER_ARRAY", 1)
    assert _collected(
        trends_from_text(frame, TERMS, "posted_at", "full_text", START, END)
    ) == _expected(rows)


def test_spine(spark):
    months = [r.month for r in month_spine(spark, end=dt.date(2026, 1, 31)).orderBy("month").collect()]
    assert (len(months), months[0], months[-1]) == (176, SPINE_START, dt.date(2026, 1, 1))
    empty = spark.createDataFrame([], "at timestamp")
    assert spine_of(empty, "at").count() == 0


@pytest.fixture(scope="module")
def mart(spark):
    rows = _records()
    frame = spark.createDataFrame(rows, "id bigint, posted_at timestamp, full_text string")
    return trends_from_text(frame, TERMS, "posted_at", "full_text", START, END).persist()


def test_checks_pass_on_a_sound_mart(spark, mart):
    dim = spark.createDataFrame([(t.key,) for t in TERMS], "tech_key string")
    for frame in (
        quality.bounds(mart),
        quality.growth_null_head(mart, START),
        quality.growth_null_zero(mart),
        quality.spine_gaps(mart, dim, START, END),
        quality.orphans(mart, dim, "tech_key"),
        quality.unique(mart, ["month", "tech_key"]),
        quality.not_null(mart, ["month", "tech_key", "pct_share"]),
        quality.recency(mart, dt.date(2024, 3, 20)),
    ):
        assert frame.isEmpty()


def test_checks_find_faults(spark, mart):
    assert not quality.recency(mart, dt.date(2023, 8, 2)).isEmpty()  # July has no records
    assert quality.recency(mart, dt.date(2030, 1, 1)).first().asDict() == {
        "month": dt.date(2029, 12, 1), "max_total_jobs": None,
    }
    wrong = mart.withColumn("mom_growth_pct", F.coalesce("mom_growth_pct", F.lit(1.0)))
    assert quality.growth_null_head(wrong, START).count() == 3
    assert quality.growth_null_zero(wrong).count() > 3
    assert quality.bounds(mart.withColumn("pct_share", F.lit(2.0))).count() == mart.count()
    dim = spark.createDataFrame([("a",), ("q",)], "tech_key string")
    assert quality.spine_gaps(mart, dim, START, END).count() == len(months_between_inclusive(START, END))
    assert {r.tech_key for r in quality.orphans(mart, dim, "tech_key").collect()} == {"b", "z"}
    frame = spark.createDataFrame([(None, "x"), (1, "y"), (1, None)], "a int, b string")
    assert {tuple(r) for r in quality.not_null(frame, ["a", "b"]).collect()} == {("a", 1), ("b", 1)}
    assert [tuple(r) for r in quality.unique(frame, ["a"]).collect()] == [(1, 2)]
    assert [tuple(r) for r in quality.accepted(frame, "b", ["x"]).collect()] == [("y", 1)]


def test_freshness(spark):
    frame = spark.sql("select timestamp'2024-01-01 00:00:00' as at")
    assert quality.freshness(frame, "at", dt.datetime(2024, 2, 5)).isEmpty()
    assert quality.freshness(frame, "at", dt.datetime(2024, 2, 6)).count() == 1
    assert quality.freshness(frame.limit(0), "at", dt.datetime(2024, 2, 6)).count() == 1


def test_pattern_failures(spark):
    cases = [("I go", "a", False), ("aa", "a", True), ("aaa", "a", True), ("b", "b", False), ("x", "?", True)]
    frame = spark.createDataFrame(cases, "text string, tech_key string, should_match boolean")
    assert {(r.text, r.did_match) for r in pattern_failures(frame, TERMS).collect()} == {
        ("aaa", False), ("b", True), ("x", False),
    }


def test_event_rates(spark):
    rows = [("Dropped", None), ("Begin", None), ("Begin", None), ("Task", 70_000.0), ("Long", 60.0), ("Task", None)]
    log = spark.createDataFrame(rows, "name string, dur double")
    durations = {"Task": F.col("dur") / 1000, "Long": F.col("dur")}
    rates = event_rates(log, "name", "Dropped", "Begin", durations)
    assert tuple(rates.first()) == (1, 2, 70.0, 50.0)
    none = event_rates(log.filter("name = 'Dropped'"), "name", "Dropped", "Begin", durations)
    assert tuple(none.first()) == (1, 0, 0.0, 0.0)


ITEM = (
    "id bigint, type string, by string, time timestamp, text string, title string, url string, "
    "kids array<bigint>, parent bigint, score bigint, descendants bigint, deleted boolean, dead boolean"
)


def test_months_to_marts(spark, tmp_path):
    """Threads landed twice, built, checked: the second landing changes nothing."""

    def item(number, day, text=None, kind="comment", title=None, kids=(), parent=None, deleted=False):
        at = dt.datetime(2024, day, 5)
        return (number, kind, "a", at, text, title, None, list(kids), parent, None, None, deleted, False)

    items = spark.createDataFrame(
        [
            item(1, 3, kind="story", title="Who is hiring? (March 2024)", kids=[2, 3, 4]),
            item(2, 3, "<p>Python &amp; React", parent=1, kids=[5]),
            item(3, 3, "rusty nail", parent=1),
            item(5, 3, "python3", parent=2),
            item(10, 4, kind="story", title="Who is hiring? (April 2024)", kids=[11, 12]),
            item(11, 4, "Rust programming", parent=10),
            item(12, 4, None, parent=10, deleted=True),
            item(99, 4, "python elsewhere", parent=98),
        ],
        ITEM,
    )
    users = spark.createDataFrame([("poster", [10, 1])], "id string, submitted array<bigint>")
    months = [dt.date(2024, m, 1) for m in (3, 4, 5)]
    bronze_path = str(tmp_path / "bronze")
    with pytest.raises(ValueError):
        ingest_months(users, items, months, bronze_path, dt.date(2024, 4, 30))
    as_of = dt.date(2024, 5, 20)
    for load in ("one", "two"):
        done = ingest_months(users, items, months, bronze_path, as_of, load)
        assert (done.rows, done.months_missing) == (8, [dt.date(2024, 5, 1)])
    bronze = read_bronze(spark, bronze_path)
    assert sorted(map(tuple, load_stats(bronze).collect())) == [("one", 8, 1), ("two", 8, 1)]
    taxonomy = default_taxonomy(spark)
    start = dt.date(2024, 1, 1)
    marts = rebuild(spark, bronze, taxonomy, str(tmp_path / "out"), as_of, start)
    assert sorted(r.id for r in marts.silver.collect()) == [2, 3, 5, 11]
    assert marts.trends.count() == 5 * 20
    counts = {
        (r.month.month, r.tech_key): (r.mention_count, r.total_jobs)
        for r in marts.trends.filter("mention_count > 0").collect()
    }
    assert counts == {(3, "python"): (2, 3), (3, "react"): (1, 3), (4, "rust"): (1, 1)}
    one_pass = trends_of_bronze(bronze, taxonomy, as_of, start)
    assert _collected(one_pass) == _collected(marts.trends)
    # A rebuild that fails on its way is never seen; old versions can be emptied.
    out = str(tmp_path / "out")
    before = current_version(spark, out)
    with pytest.raises(ValueError):
        rebuild(spark, bronze, taxonomy.withColumn("tech_key", F.lit(1)), out, as_of, start)
    assert current_version(spark, out) == before
    newer = rebuild(spark, bronze, taxonomy, out, as_of, start)
    assert current_version(spark, out) > before and newer.silver.count() == 4
    assert len(retire_versions(spark, out, 1, MART_TABLES)) == 1
    assert spark.read.parquet(f"{before}/silver").count() == 0
    marts = read_marts(spark, out)
    checks = check_marts(marts, bronze, as_of, start).filter("violations > 0")
    assert checks.isEmpty()
    # Faults of every kind at once: each check finds its own.
    silver, trends, dim = marts.silver, marts.trends, marts.dim
    wrong = trends.filter("tech_key = 'python'").limit(1)
    faulty = Marts(
        silver.unionByName(silver.limit(1).withColumn("author", F.lit(None).cast("string"))).withColumn(
            "posted_at", F.col("posted_at") + F.expr("interval 1 second")
        ),
        marts.bridge.unionByName(marts.bridge.limit(1).withColumn("tech_category", F.lit("Other"))).unionByName(
            marts.bridge.limit(1).withColumn("job_id", F.lit(None).cast("bigint"))
        ),
        dim.unionByName(dim.limit(1)),
        trends.filter("tech_key <> 'rust' and month < '2024-05-01'")
        .withColumn("mom_growth_pct", F.lit(1.0))
        .withColumn("pct_share", F.when(F.col("tech_key") == "sql", 2.0).otherwise(F.col("pct_share")))
        .unionByName(wrong.withColumn("tech_key", F.lit("unknown")).withColumn("tech_name", F.lit(None).cast("string"))),
    )
    seen = {r.check_name: r.violations for r in check_marts(faulty, bronze, dt.date(2024, 9, 1), start).collect()}
    assert len(seen) == 14 and not [name for name, n in seen.items() if n == 0]
    broken = Marts(marts.silver, marts.bridge, marts.dim.limit(19), marts.trends)
    assert {r.check_name for r in check_marts(broken, bronze, as_of, start).filter("violations > 0").collect()} == {
        "trends_keys_known"
    }


WORD_TERMS = [
    Term("go", "Go", "c", r"\b(go\s+programming|go)\b"),
    Term("node", "Node", "c", r"\b(node\.js|nodejs)\b"),
    Term("sharp", "Sharp", "c", r"\b(c#|c-sharp)"),
    Term("ki", "Ki", "c", r"\b(ski|kiss)\b"),
    Term("part", "Part", "c", r"(script)"),
    Term("end", "End", "c", r"(ing)\b"),
    Term("dash", "Dash", "c", r"\bgo-(to|on)\b"),
    Term("two", "Two", "c", r"\b(go|node)\b"),
    Term("wild", "Wild", "c", r"\b(n.de|g+o)\b"),
]
WORD_TEXTS = [
    "Go programming", "gopher", "NODE.JS", "nodeXjs nodejs", "c#", "C-Sharp x", "xc#", "\u017fki KISS", "go-to go-on",
    "javascript", "testing", "ing", "ego", "go", "éGo é", "node", "gooo nide", "", None, "go_on", "go.", "K\u0131ss k\u0130ss",
]


@pytest.mark.parametrize("indexed", [1, 10**9])
def test_terms_by_word_as_one_by_one(spark, monkeypatch, indexed):
    monkeypatch.setattr("tidegauge.operators.taxonomy.INDEXED_FROM", indexed)
    frame = spark.createDataFrame(list(enumerate(WORD_TEXTS)), "id int, text string")
    found = tag_taxonomy(frame, WORD_TERMS, "text", ["id"], rows_unique=True).collect()
    expected = []
    for t in WORD_TERMS:
        rows = frame.filter(re2_match("text", t.pattern)).select("id").collect()
        expected += [(r["id"], t.key) for r in rows]
    assert sorted((r["id"], r["tech_key"]) for r in found) == sorted(expected)


def test_many_terms_counted_by_pair(spark, monkeypatch):
    rows = [(i, text, dt.datetime(2024, 1 + i % 3, 1)) for i, text in enumerate(WORD_TEXTS)]
    frame = spark.createDataFrame(rows, "id int, text string, at timestamp")
    build = lambda: trends_from_text(frame, WORD_TERMS, "at", "text", dt.date(2023, 12, 1), dt.date(2024, 5, 1))
    plain = build()
    monkeypatch.setattr("tidegauge.operators.trends.COUNTED_BY_PAIR", 1)
    monkeypatch.setattr("tidegauge.operators.taxonomy.INDEXED_FROM", 1)
    by_pair = build()
    assert [(f.name, f.dataType) for f in by_pair.schema] == [(f.name, f.dataType) for f in plain.schema]
    assert sorted(map(str, by_pair.collect())) == sorted(map(str, plain.collect()))

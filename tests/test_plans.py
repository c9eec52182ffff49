"""Physical plans: what reaches the scan, what is shuffled, what stays in the JVM."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tidegauge.operators.compare import missing_keys
from tidegauge.operators.scan import ScanRule, scan_documents
from tidegauge.operators.series import page_after
from tidegauge.operators.taxonomy import Term, tag_taxonomy
from tidegauge.operators.trends import trends_from_text
from tidegauge.sources.tables import run_partitions


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = _plan(queries()["keyed_range_filter"](spark, sf_dir))
    assert "In(o_orderpriority" in plan and "GreaterThanOrEqual(o_orderdate" in plan
    backfill = _plan(queries()["months_backfill"](spark, sf_dir))
    assert "GreaterThanOrEqual(o_orderdate" in backfill and "LessThan(o_orderdate" in backfill
    assert "o_totalprice" not in backfill


@pytest.mark.parametrize(
    "name",
    ["taxonomy_bridge", "document_trends", "clean_html_pages", "staged_events", "doc_lines",
     "monthly_trends_of_orders", "latest_order_per_customer", "validate_records"],
)
def test_no_python_in_the_hot_path(spark, sf_dir, name):
    plan = _plan(queries()[name](spark, sf_dir))
    assert "Python" not in plan and "ArrowEval" not in plan


def test_tagging_large_text_needs_no_shuffle(spark):
    large = spark.range(10**12).selectExpr("id", "cast(id as string) as text")
    plan = _plan(tag_taxonomy(large, [Term("a", "", "", "1")], "text", ["id"], rows_unique=True))
    assert "Exchange" not in plan and "Join" not in plan


def test_many_terms_and_rules_read_the_text_once(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    terms = [Term(f"k{i}", f"K{i}", "", rf"\b(word{i})\b") for i in range(1000)]
    assert _plan(tag_taxonomy(documents, terms, "text", ["doc_id"], rows_unique=True)).count("FileScan") == 1
    rules = [ScanRule(rf"word{i}\s", f"r{i}") for i in range(1000)]
    assert _plan(scan_documents(documents, "text", rules)).count("FileScan") == 1


def test_flagship_reads_orders_twice(spark, sf_dir):
    """Once for the keys and once for the counts, which make no key distinct."""
    plan = _plan(queries()["monthly_trends_of_orders"](spark, sf_dir))
    assert plan.count("FileScan") == 2 and "count(distinct" not in plan


def test_pages_go_by_the_last_row(spark):
    rows = spark.range(10**9).select("id", (F.col("id") % 10).alias("k"))
    plan = _plan(page_after(rows, ["k", "id"], [3, 999], 20))
    assert "limit=20" in plan


def test_counting_large_text_shuffles_months_only(spark):
    large = spark.range(10**12).selectExpr(
        "id", "cast(id as string) as text", "timestamp_seconds(id) as at"
    )
    frame = trends_from_text(
        large, [Term("a", "A", "", "1")], "at", "text", dt.date(2020, 1, 1), dt.date(2020, 12, 1)
    )
    plan = _plan(frame)
    # month counts, their broadcast, and the window over the finished grid
    assert plan.count("Exchange hashpartitioning") == 2
    assert "partial_count" in plan


def test_repeated_keys_are_reduced_before_joins(spark):
    left = spark.range(10**9).select((F.col("id") % 7).alias("k"))
    plan = _plan(missing_keys(left, left, ["k"]))
    first_exchange = plan.rindex("Exchange hashpartitioning")
    assert "HashAggregate" in plan[first_exchange:]


def test_month_runs_filter_raw_stamps(spark, tmp_path):
    spark.sql("select timestamp'2024-01-05 00:00:00' as at, 1 as v").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    plan = _plan(run_partitions(rows, "at", [dt.date(2024, 1, 1)], lambda d: d, dt.date(2024, 2, 1)))
    assert "PushedFilters: [IsNotNull(at), GreaterThanOrEqual(at" in plan


def test_trend_checks_in_one_scan(spark):
    """Counts over faulty marts equal the numbers of rows of the checks one by one."""
    import datetime as dt

    from tidegauge.operators import quality

    start, as_of = dt.date(2023, 1, 1), dt.date(2024, 6, 15)
    months = [dt.date(2023 + m // 12, m % 12 + 1, 1) for m in range(18)]
    shares = [0.0, 0.25, None, 1.5, 0.5]
    rows = [
        (m, key, None if i % 7 == 3 else "n", i % 4, 4 if i % 5 else None, shares[(i + j) % 5], (i + j) % 3 * 1.0 or None, (i * j) % 2 * 1.0 or None)
        for j, key in enumerate(["a", "b", None]) for i, m in enumerate(months)
    ]
    schema = (
        "month date, tech_key string, tech_name string, mention_count long, total_jobs long, "
        "pct_share double, mom_growth_pct double, yoy_growth_pct double"
    )
    columns = ["month", "tech_key", "tech_name", "total_jobs", "pct_share"]
    for trends in (spark.createDataFrame(rows, schema), spark.createDataFrame(rows[:17], schema), spark.createDataFrame([], schema)):
        one_by_one = {
            "trends_not_null": quality.not_null(trends, columns),
            "trends_bounds": quality.bounds(trends),
            "growth_head": quality.growth_null_head(trends, start),
            "growth_zero_base": quality.growth_null_zero(trends),
            "recent_month": quality.recency(trends, as_of),
        }
        counted = dict(map(tuple, quality.trend_violations(trends, columns, start, as_of).collect()))
        assert counted == {name: frame.count() for name, frame in one_by_one.items()}
    everything = dict(map(tuple, quality.trend_violations(spark.createDataFrame(rows, schema), columns, start, as_of).collect()))
    assert all(everything[name] for name in ("trends_not_null", "trends_bounds", "growth_head", "growth_zero_base"))

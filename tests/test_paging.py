"""Pages by ranges equal offsets; tables compared by digests equal a comparison of all rows."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidegauge.operators.compare import changed_keys
from tidegauge.operators.paging import indexed_page, indexed_total, write_ordered

SCHEMA = "name string, id long, range int"


def test_pages_equal_offsets(spark, tmp_path):
    draw = random.Random(3)
    rows = [(draw.choice([None, "", "a", "b", "long " * 5000]), i, i) for i in range(500)]
    path, order = str(tmp_path / "pages"), ["name", "id"]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert write_ordered(frame, path, order, range_rows=40) == 500 == indexed_total(spark, path)
    everything = frame.orderBy(*order).collect()
    for limit, offset in [(20, 0), (0, 10), (7, 493), (100, 450), (10, 500), (10, 9000), (130, 111), (500, 0)]:
        page = indexed_page(spark, path, order, limit, offset)
        assert page.columns == frame.columns
        assert page.collect() == everything[offset : offset + limit], (limit, offset)
    deep = indexed_page(spark, path, order, 10, 480)._jdf.queryExecution().toString()
    assert "490" not in deep and "480" not in deep and "PartitionFilters" in deep
    for bad in ({"limit": -1}, {"limit": 1, "offset": -1}):
        with pytest.raises(ValueError):
            indexed_page(spark, path, order, **bad)


def test_pages_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    assert write_ordered(spark.createDataFrame([], SCHEMA), path, ["id"]) == 0
    assert indexed_page(spark, path, ["id"], 10).collect() == [] and indexed_total(spark, path) == 0
    with pytest.raises(ValueError):
        write_ordered(spark.createDataFrame([], SCHEMA), path, ["id"], range_rows=0)


def test_ranges_share_files(spark, tmp_path, monkeypatch):
    """Files follow the parts, however short the ranges are."""
    frame = spark.range(0, 3000, numPartitions=3).selectExpr("pmod(id * 7919, 3000) AS id")
    path = str(tmp_path / "short")
    assert write_ordered(frame, path, ["id"], range_rows=10) == 3000
    assert len(list(Path(path, "rows").rglob("*.parquet"))) == 1
    monkeypatch.setattr("tidegauge.operators.paging.PART_ROWS", 400)
    path = str(tmp_path / "parts")
    assert write_ordered(frame, path, [F.desc("id")], range_rows=10) == 3000
    assert 1 < len(list(Path(path, "rows").rglob("*.parquet"))) <= 8
    for limit, offset in [(20, 0), (5, 1234), (500, 333), (1700, 601), (3000, 0), (9, 2996), (0, 7), (3, 3000)]:
        page = indexed_page(spark, path, [F.desc("id")], limit, offset)
        assert [r["id"] for r in page.collect()] == list(range(3000))[::-1][offset : offset + limit], (limit, offset)
    one = indexed_page(spark, path, [F.desc("id")], 5, 1234)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(range__)" in one and "PartitionFilters: [isnotnull(part__" in one


ROWS = "key long, other string, value double"


def test_changed_keys(spark):
    old = [(i, "x", float(i)) for i in range(200)] + [(None, None, None), (1000, None, 1.0), (1001, "d", 1.0), (1001, "d", 2.0)]
    new = [r for r in old if r[0] not in (5, 1000)]
    new[7] = (new[7][0], "x", None)
    new += [(1000, "y", 1.0), (300, "x", 1.0)]
    frames = [spark.createDataFrame(rows, ROWS).repartition(3) for rows in (new, old)]
    expected = {(5, "removed"), (new[7][0], "changed"), (1000, "changed"), (300, "added")}
    for buckets in (1, 7, 4096):
        found = changed_keys(*frames, ["key"], ["other", "value"], buckets).collect()
        assert sorted(map(tuple, found)) == sorted(expected), buckets
    # A null in one column is no null in the other, as a key as well.
    found = changed_keys(*frames, ["key", "other"], ["value"]).filter("key = 1000").collect()
    assert sorted((r["other"] or "", r["change"]) for r in found) == [("", "removed"), ("y", "added")]
    with pytest.raises(ValueError):
        changed_keys(*frames, ["key"], ["value"], 0)


def test_equal_tables_compare_no_row(spark):
    rows = [(i % 50, "x", float(i)) for i in range(300)]
    frames = [spark.createDataFrame(r, ROWS) for r in (rows, rows[::-1])]
    same = changed_keys(*frames, ["key"], ["other", "value"])
    assert same.collect() == []
    plan = same._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" in plan and "Aggregate" not in plan
    nothing = spark.createDataFrame([], ROWS)
    assert changed_keys(nothing, nothing, ["key"], ["value"]).collect() == []
    assert changed_keys(frames[0], nothing, ["key"], ["value"]).filter("change <> 'added'").isEmpty()

"""Bucketed silver and the mart of signed changes equal a rebuild after every load."""

import datetime as dt
import json
import random

import pytest

from tidegauge.operators.staging import stage_records
from tidegauge.operators.taxonomy import terms_from
from tidegauge.plans.pipeline import trends_of_bronze
from tidegauge.sources import schemas
from tidegauge.streaming.buckets import (
    compact_buckets,
    merge_batch,
    read_buckets,
    read_trends,
    retire_steps,
    stream_buckets,
)
from tidegauge.streaming.jobs import run_to_end

TERMS = terms_from([("odd", "Odd", "Tool", r"\b[0-9]*[13579]\b"), ("new", "New", "Tool", r"\bnew\b")])
FIRST, LAST = dt.date(2023, 12, 1), dt.date(2024, 4, 1)


def _rows(seed, ids=40, count=300):
    draw = random.Random(seed)
    rows = []
    for _ in range(count):
        record = {
            # one record holds a third of all versions, some have no id, time or text
            "id": 7 if draw.random() < 0.33 else draw.choice([None, *range(ids)]),
            "type": draw.choice(["comment", "comment", "comment", "story", None]),
            "by": draw.choice(["a", "b", None]),
            "time": draw.choice([None, "2024-01-01T00:00:00+00:00", "2024-02-29T23:59:59+00:00", "2031-01-01T00:00:00+00:00"]),
            "text": draw.choice([None, "", "<p>new", f"<p>v {draw.randrange(1000)}", "long " * 2000 + "7"]),
            "parent": 1,
            "deleted": draw.choice([True, False, False, None]),
        }
        stamp = dt.datetime(2024, 1, draw.randrange(1, 28))
        rows.append((f"load-{draw.randrange(5)}", stamp, json.dumps(record)))
    return rows


def _plain(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


def _equal_rebuild(spark, out, rows):
    bronze = spark.createDataFrame(rows, schemas.BRONZE)
    assert _plain(read_buckets(spark, out)) == _plain(stage_records(bronze))
    columns = ["month", "tech_key", "tech_name", "mention_count", "total_jobs", "pct_share", "mom_growth_pct", "yoy_growth_pct"]
    rebuilt = trends_of_bronze(bronze, TERMS, LAST, FIRST).select(*columns)
    assert _plain(read_trends(spark, out, TERMS, LAST, FIRST).select(*columns)) == _plain(rebuilt)


def test_every_load_equals_a_rebuild(spark, tmp_path):
    bronze, out, checkpoint = str(tmp_path / "bronze"), str(tmp_path / "table"), str(tmp_path / "cp")
    assert read_buckets(spark, out).isEmpty() and compact_buckets(spark, out) == []
    assert read_trends(spark, out, TERMS, LAST, FIRST).filter("mention_count <> 0").isEmpty()
    everything = []
    for run in range(3):
        rows = _rows(run)
        everything += rows
        frame = spark.createDataFrame(rows, schemas.BRONZE).coalesce(2)
        frame.write.mode("append").parquet(bronze)
        run_to_end(stream_buckets(spark, bronze, out, checkpoint, TERMS, buckets=4, max_files=1))
        _equal_rebuild(spark, out, everything)
        if run == 1:
            assert compact_buckets(spark, out) == [0, 1, 2, 3]
            assert compact_buckets(spark, out) == []
            _equal_rebuild(spark, out, everything)
            assert "Exchange" not in read_buckets(spark, out)._jdf.queryExecution().executedPlan().toString()
    assert retire_steps(spark, out, keep=1)
    assert retire_steps(spark, out, keep=1) == []
    _equal_rebuild(spark, out, everything)


def test_a_batch_that_comes_again_or_fails_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "table")
    rows = _rows(5)
    frame = spark.createDataFrame(rows, schemas.BRONZE)
    assert merge_batch(frame, out, 0, TERMS, buckets=4)
    assert not merge_batch(frame, out, 0, TERMS, buckets=4)
    _equal_rebuild(spark, out, rows)
    # Half a step, which no state names: the next batch writes over it.
    for kind in ("silver/step=2/bucket=1", "mart/step=2"):
        folder = tmp_path / "table" / kind
        folder.mkdir(parents=True)
        (folder / "part-0.parquet").write_bytes(b"half")
    _equal_rebuild(spark, out, rows)
    more = _rows(6)
    assert merge_batch(spark.createDataFrame(more, schemas.BRONZE), out, 1, TERMS)
    _equal_rebuild(spark, out, rows + more)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    out = str(tmp_path / "table")
    rows = _rows(8)
    merge_batch(spark.createDataFrame(rows, schemas.BRONZE), out, 0, TERMS, buckets=16)
    one = [("load-9", dt.datetime(2024, 3, 1), json.dumps({"id": 3, "type": "comment", "deleted": False, "text": "new 1", "time": "2024-01-05T00:00:00+00:00"}))]
    merge_batch(spark.createDataFrame(one, schemas.BRONZE), out, 1, TERMS)
    _equal_rebuild(spark, out, rows + one)
    assert len(compact_buckets(spark, out)) == 1
    assert len([p for p in (tmp_path / "table/silver/step=3").iterdir() if p.name.startswith("bucket=")]) == 1
    _equal_rebuild(spark, out, rows + one)


def test_empty_batches_and_other_terms(spark, tmp_path):
    out = str(tmp_path / "table")
    empty = spark.createDataFrame([], schemas.BRONZE)
    assert merge_batch(empty, out, 0, TERMS, buckets=4)
    assert read_buckets(spark, out).isEmpty()
    rows = _rows(9, count=20)
    assert merge_batch(spark.createDataFrame(rows, schemas.BRONZE), out, 1, TERMS)
    _equal_rebuild(spark, out, rows)
    with pytest.raises(ValueError, match="taxonomy"):
        merge_batch(empty, out, 2, TERMS[:1])
    with pytest.raises(ValueError, match="taxonomy"):
        read_trends(spark, out, TERMS[:1], LAST, FIRST)
    with pytest.raises(ValueError, match="must stay"):
        retire_steps(spark, out, keep=0)

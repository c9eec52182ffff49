"""Loads and months that are there as a whole or not at all."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegauge.sources import schemas
from tidegauge.sources.ledger import (
    backfill_months,
    commit_load,
    compact_loads,
    ledger,
    month_states,
    read_loads,
    read_months,
)

STAMP = dt.datetime(2024, 5, 1, 12, 0, 0, 123456)


def _rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "payload string")


def _read(spark, path):
    return sorted((r.load_id, r.payload) for r in read_loads(spark, path).collect())


def test_loads_and_retries(spark, tmp_path):
    path = str(tmp_path / "t")
    assert _read(spark, path) == [] and ledger(spark, path).count() == 0
    assert commit_load(_rows(spark, "a", "b", None), path, "1", STAMP) == 3
    assert commit_load(_rows(spark, "a", "b"), path, "1", STAMP) == 0  # there already
    assert commit_load(_rows(spark), path, "2", STAMP) == 0
    assert commit_load(_rows(spark, "a"), path) == 1
    rows = read_loads(spark, path)
    assert rows.schema == schemas.BRONZE and rows.count() == 4
    assert rows.filter("load_id = '1'").select(F.unix_micros("ingested_at")).distinct().collect() == [(1714564800123456,)]
    assert commit_load(_rows(spark, "c"), path, "1", STAMP, replace=True) == 1
    assert [p for i, p in _read(spark, path) if i == "1"] == ["c"]
    assert {r.load_id: r.rows for r in ledger(spark, path).collect() if r.load_id in "12"} == {"1": 1, "2": 0}


def test_half_written_loads_are_not_there(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    commit_load(_rows(spark, "a"), path, "1", STAMP)
    broken = _rows(spark, "b", "c").select(F.when(F.col("payload") == "c", F.raise_error(F.lit("no"))).otherwise("b").alias("payload"))
    with pytest.raises(Exception, match="no"):
        commit_load(broken.repartition(2), path, "2", STAMP)
    # All files are written, and the driver dies before the ledger names them.
    with monkeypatch.context() as patch:
        patch.setattr("tidegauge.sources.ledger._commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            commit_load(_rows(spark, "d"), path, "3", STAMP)
    # A version of the ledger without its commit: a job that was killed.
    spark.range(1).selectExpr("'x' as load_id").write.parquet(f"{path}/ledger/_temporary/version=9")
    assert _read(spark, path) == [("1", "a")]
    assert commit_load(_rows(spark, "d"), path, "3", STAMP) == 1
    assert _read(spark, path) == [("1", "a"), ("3", "d")]


def test_two_writers_are_an_error(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    import tidegauge.sources.ledger as module

    commit = module._commit

    def late(spark, path, seen, rows):
        monkeypatch.setattr(module, "_commit", commit)
        commit_load(_rows(spark, "other"), path, "o", STAMP)
        commit(spark, path, seen, rows)

    monkeypatch.setattr(module, "_commit", late)
    with pytest.raises(Exception, match="EXISTS|exists"):
        commit_load(_rows(spark, "mine"), path, "m", STAMP)
    assert _read(spark, path) == [("o", "other")]


def test_compaction_keeps_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(6):
        commit_load(_rows(spark, *map(str, range(i))), path, f"l{i}", STAMP)
    before = _read(spark, path)
    assert compact_loads(spark, path, small=7) == 3  # 1 + 2 + 3 rows; 4 and 5 stay alone
    assert _read(spark, path) == before
    assert ledger(spark, path).filter("rows > 0").select("folder").distinct().count() == 3
    assert commit_load(_rows(spark, "x"), path, "l2", STAMP) == 0


def test_months_go_on_where_they_were(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = [(i, dt.datetime(2024, 1 + i % 4, 3)) for i in range(40)]
    frame = spark.createDataFrame(rows, "id int, at timestamp")
    months = [dt.date(2024, m, 1) for m in (1, 2, 3)]
    bad, seen = {dt.date(2024, 2, 1)}, []

    def transform(some):
        month = some.first()["month"]
        seen.append(month)
        if month in bad:
            raise ValueError("bad month")
        return some.groupBy("month").count()

    states = backfill_months(frame, "at", months, transform, path, dt.date(2024, 5, 1))
    assert {r.month.month: r.state for r in states.collect()} == {1: "done", 2: "failed", 3: "done"}
    assert "bad month" in states.filter("state = 'failed'").first().reason
    assert sorted(r.month.month for r in read_months(spark, path, "month date, count bigint").collect()) == [1, 3]
    bad.clear()
    seen.clear()
    backfill_months(frame, "at", [*months, dt.date(2024, 4, 9)], transform, path, dt.date(2024, 5, 1))
    assert [m.month for m in seen] == [2, 4]
    assert sorted(tuple(r) for r in read_months(spark, path, "month date, count bigint").collect()) == [(dt.date(2024, m, 1), 10) for m in (1, 2, 3, 4)]
    with pytest.raises(ValueError):
        backfill_months(frame, "at", [dt.date(2024, 6, 1)], transform, path, dt.date(2024, 5, 1))
    assert month_states(spark, path).count() == 4

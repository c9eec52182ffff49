"""Incremental jobs equal their batch counterparts, also when batches repeat."""

import datetime as dt
import json
import random

from tidegauge.operators.staging import stage_records
from tidegauge.sources import schemas
from tidegauge.sources.bronze import read_bronze
from tidegauge.streaming.jobs import compact_latest, read_latest, run_to_end, stream_bronze, stream_latest


def _land(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in records))


def test_bronze_stream(spark, tmp_path):
    landing, out, checkpoint = tmp_path / "landing", str(tmp_path / "bronze"), str(tmp_path / "cp")
    _land(landing, "a.json", [{"id": 1}, {"id": 2}])
    _land(landing, "b.json", [{"id": 3}])
    run_to_end(stream_bronze(spark, str(landing), out, checkpoint, max_files=1))
    rows = read_bronze(spark, out).collect()
    assert sorted(json.loads(r.payload)["id"] for r in rows) == [1, 2, 3]
    assert {r.load_id for r in rows} == {"stream-0", "stream-1"}
    _land(landing, "c.json", [{"id": 4}])
    run_to_end(stream_bronze(spark, str(landing), out, checkpoint))
    assert read_bronze(spark, out).count() == 4
    # Losing the checkpoint repeats the batches under the same load ids.
    run_to_end(stream_bronze(spark, str(landing), out, str(tmp_path / "new"), max_files=1))
    assert read_bronze(spark, out).count() == 4


def _bronze_rows(seed):
    draw = random.Random(seed)
    rows = []
    for _ in range(300):
        day = draw.randrange(1, 28)
        # one record holds a third of all versions
        number = 7 if draw.random() < 0.33 else draw.randrange(40)
        record = {
            "id": number,
            "type": draw.choice(["comment", "comment", "comment", "story", None]),
            "by": "a",
            "time": "2024-01-01T00:00:00+00:00",
            "text": f"<p>v{draw.randrange(1000)}",
            "parent": 1,
            "deleted": draw.choice([True, False, False, None]),
        }
        rows.append((f"load-{draw.randrange(5)}", dt.datetime(2024, 1, day), json.dumps(record)))
    return rows


def test_latest_stream_equals_batch(spark, tmp_path):
    bronze, out, checkpoint = str(tmp_path / "bronze"), str(tmp_path / "silver"), str(tmp_path / "cp")
    assert read_latest(spark, out).isEmpty()
    assert compact_latest(spark, out) is None
    everything = []
    for run in range(3):
        rows = _bronze_rows(run)
        everything += rows
        frame = spark.createDataFrame(rows, schemas.BRONZE)
        frame.write.mode("append").partitionBy("load_id").parquet(bronze)
        run_to_end(stream_latest(spark, bronze, out, checkpoint, max_files=3))
        batch = stage_records(spark.createDataFrame(everything, schemas.BRONZE))
        expected = sorted(map(tuple, batch.collect()))
        assert sorted(map(tuple, read_latest(spark, out).collect())) == expected
        if run == 1:
            assert compact_latest(spark, out) == compact_latest(spark, out)
            assert sorted(map(tuple, read_latest(spark, out).collect())) == expected
    # A repeated batch replaces its own folder.
    run_to_end(stream_latest(spark, bronze, out, str(tmp_path / "new"), max_files=100))
    assert sorted(map(tuple, read_latest(spark, out).collect())) == expected


def test_unfinished_batches_are_not_read(spark, tmp_path):
    bronze, out = str(tmp_path / "bronze"), tmp_path / "silver"
    spark.createDataFrame(_bronze_rows(1), schemas.BRONZE).write.parquet(bronze)
    run_to_end(stream_latest(spark, bronze, str(out), str(tmp_path / "cp")))
    before = read_latest(spark, str(out)).count()
    half = out / "delta" / "batch=9"
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"half")
    assert read_latest(spark, str(out)).count() == before

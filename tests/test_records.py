"""Landing, bronze, tables, validation, staging."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators.quality import enforce_contract
from tidegauge.operators.staging import latest_by, stage_records
from tidegauge.operators.validate import classify_items, validate_items, validate_users
from tidegauge.session import Scratch, shared_dir, spread, work_path
from tidegauge.sources import schemas
from tidegauge.sources.bronze import append_bronze, load_stats, read_bronze, to_payload
from tidegauge.sources.landing import (
    default_taxonomy,
    read_landing,
    read_scan_rules,
    read_taxonomy,
    reject_bad_payloads,
)
from tidegauge.sources.tables import (
    check_months,
    ensure_table,
    run_partitions,
    table_count,
    table_exists,
    write_months,
)


def _payloads(spark, *records):
    texts = [(r if isinstance(r, str) or r is None else json.dumps(r),) for r in records]
    return spark.createDataFrame(texts, "payload string")


def test_landing_and_bronze(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.json").write_text('{"id":1,"by":"x"}\n{"id":2}\n')
    (landing / "b.json").write_text("{broken\n")
    good, bad = reject_bad_payloads(read_landing(spark, str(landing)))
    assert [r.payload for r in bad.collect()] == ["{broken"]
    path, stamp = str(tmp_path / "bronze"), dt.datetime(2024, 5, 1, 12, 0, 0, 123456)
    assert append_bronze(good, path, "7", stamp) == 2
    assert append_bronze(good, path, "7", stamp) == 2  # batches of one load add up
    assert append_bronze(good.limit(0), path, "8") == 0
    assert append_bronze(good, path) == 2
    rows = read_bronze(spark, path)
    assert table_count(rows) == 6
    assert rows.schema == schemas.BRONZE
    first = rows.filter("load_id = '7'")
    assert first.select(F.unix_micros("ingested_at")).distinct().collect() == [(1714564800123456,)]
    assert append_bronze(good, path, "7", stamp, replace_load=True) == 2
    assert table_count(read_bronze(spark, path)) == 4
    typed = read_landing(spark, str(landing), T.StructType.fromDDL("id bigint, by string"))
    assert sorted((r.id or 0) for r in typed.collect()) == [0, 1, 2]


def test_payload_fidelity(spark):
    rows = spark.createDataFrame(
        [(1, None, [1, 2], 'quote " back\\slash é\n', dt.datetime(2024, 1, 1, 0, 0, 0, 5))],
        "id bigint, by string, kids array<bigint>, text string, at timestamp_ntz",
    )
    payload = json.loads(to_payload(rows).first()[0])
    assert payload == {
        "id": 1,
        "by": None,
        "kids": [1, 2],
        "text": 'quote " back\\slash é\n',
        "at": "2024-01-01T00:00:00.000005",
    }


def test_load_stats(spark):
    rows = [("a", '{"is_tombstone":true}'), ("a", '{"is_tombstone":false}'), ("b", "{}")]
    stats = load_stats(spark.createDataFrame(rows, "load_id string, payload string"))
    assert sorted(map(tuple, stats.collect())) == [("a", 2, 1), ("b", 1, 0)]


def test_taxonomy_csv(spark, tmp_path):
    path = tmp_path / "taxonomy.csv"
    path.write_text(
        'tech_key,display_name,category,regex_pattern\n'
        'node,Node.js,Framework,"\\b(node\\.js|nodejs)\\b"\n'
        'odd,"a ""b"", c",Tool,"x\\s+""y"""\n'
    )
    assert [tuple(r) for r in read_taxonomy(spark, str(path)).collect()] == [
        ("node", "Node.js", "Framework", r"\b(node\.js|nodejs)\b"),
        ("odd", 'a "b", c', "Tool", r'x\s+"y"'),
    ]
    default = default_taxonomy(spark)
    assert default.count() == 20
    assert default.filter(~F.col("category").isin(schemas.CATEGORIES)).isEmpty()


def test_scan_rule_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('{"pattern":"\\\\bx\\\\b","exceptions":["a.md"]}\n{"pattern":"y","description":"Y"}\n')
    rules = sorted(map(tuple, read_scan_rules(spark, str(path)).collect()))
    assert rules == [(r"\bx\b", "Unnamed rule", ["a.md"]), ("y", "Y", [])]


def test_ensure_table(spark, tmp_path):
    name = "landing_table"
    assert not table_exists(spark, name)
    for _ in range(2):
        ensure_table(spark, name, schemas.BRONZE, str(tmp_path / "t"))
    assert table_exists(spark, name) and spark.table(name).schema == schemas.BRONZE
    spark.sql(f"drop table {name}")


def test_months(spark, tmp_path):
    assert check_months([dt.date(2024, 1, 31)], dt.date(2024, 1, 1)) == [dt.date(2024, 1, 1)]
    with pytest.raises(ValueError, match="2024-02-01"):
        check_months([dt.date(2024, 2, 1)], dt.date(2024, 1, 31))
    rows = spark.sql(
        "select id, timestamp'2023-11-30 12:00:00' + make_dt_interval(cast(id as int) * 20) as at from range(8)"
    )
    months = [dt.date(2023, 12, 1), dt.date(2024, 2, 1)]
    picked = run_partitions(rows, "at", months, lambda df: df, dt.date(2024, 12, 1))
    assert sorted({r.month for r in picked.collect()}) == months
    assert run_partitions(rows, "at", [], lambda df: df, dt.date(2024, 1, 1)).isEmpty()
    path = str(tmp_path / "months")
    write_months(run_partitions(rows, "at", months, lambda df: df, dt.date(2024, 12, 1)), path)
    before = spark.read.parquet(path).count()
    write_months(picked.filter(F.col("month") == months[0]).limit(1), path)
    counts = dict(spark.read.parquet(path).groupBy("month").count().collect())
    assert counts[months[0]] == 1 and counts[months[1]] == before - picked.filter(
        F.col("month") == months[0]
    ).count()


ITEMS = [
    ({"id": 4321, "type": "story", "time": 1600000000, "kids": [1, 2], "score": 55, "x": {"y": 1}}, None),
    ({"id": 654321, "type": "comment", "time": 1400000000, "deleted": True}, None),
    ({"id": "7", "type": "job", "time": "2024-01-01T00:00:00Z"}, None),
    ({"id": 1.0, "type": "poll", "time": 1.5}, None),
    ({"type": "story", "time": 1}, "missing_id"),
    ({"id": None, "type": "story", "time": 1}, "missing_id"),
    ({"id": "x", "type": "story", "time": 1}, "bad_id"),
    ({"id": 1, "time": 1}, "missing_type"),
    ({"id": 1, "type": "story"}, "missing_time"),
    ({"id": 1, "type": "story", "time": "soon"}, "bad_time"),
    ({"id": 1, "type": "user", "time": 1}, "unknown_type"),
    ({"id": 1, "type": "story", "time": 1, "kids": ["a"]}, "bad_field"),
    ({"id": 1, "type": "story", "time": 1, "score": 1.5}, "bad_field"),
    ({"id": 1, "type": "story", "time": 1, "dead": "perhaps"}, "bad_field"),
    ('{"id":1,"type":"job","time":5} x', "invalid_json"),
    ("[1]", "invalid_json"),
    (None, "missing_payload"),
]


def test_validate_items(spark):
    frame = _payloads(spark, *[i[0] for i in ITEMS]).coalesce(1)
    classified = classify_items(frame)
    assert [r.reason for r in classified.select("reason").collect()] == [i[1] for i in ITEMS]
    good_plan = classified.filter("reason is null")._jdf.queryExecution().executedPlan().toString()
    assert good_plan.count("from_json") == 1
    good, bad = validate_items(frame)
    assert good.schema == schemas.ITEM or good.columns == schemas.ITEM.names
    assert [r.id for r in good.collect()] == [4321, 654321, 7, 1]
    story = good.first()
    assert (story.kids, story.parts, story.deleted, story.dead, story.by) == ([1, 2], [], False, False, None)
    assert bad.count() == len(ITEMS) - 4
    enforce_contract(good, schemas.ITEM)


def test_validate_users(spark):
    good, bad = validate_users(
        _payloads(
            spark,
            {"id": "w", "created": 1600000000, "karma": 12, "submitted": [31, 30]},
            {"id": "x", "created": 1},
            {"id": "y", "created": "?", "karma": 1},
        )
    )
    assert [(r.id, r.karma, r.about, r.submitted) for r in good.collect()] == [
        ("w", 12, None, [31, 30])
    ]
    assert sorted(r.reason for r in bad.collect()) == ["bad_created", "missing_karma"]


def _version(number, text, load, day, kind="comment", deleted=False):
    record = {"id": number, "type": kind, "by": "a", "time": "2024-01-01T00:00:00-05:00",
              "text": text, "parent": 9, "deleted": deleted}
    return load, dt.datetime(2024, 1, day), json.dumps(record)


def test_staging(spark):
    rows = [
        _version(1, "old", "l1", 1),
        _version(1, "<p>new &amp; clean", "l2", 2),
        _version(1, "gone", "l3", 3, deleted=True),  # falls back to the last live version
        _version(2, None, "l1", 1),
        _version(3, "x", "l1", 1, kind="story"),
        _version(4, "x", "l1", 1, deleted=None),
        _version(5, "tie a", "l1", 1),
        _version(5, "tie b", "l2", 1),
        ("l1", dt.datetime(2024, 1, 1), json.dumps({"id": 6, "type": None, "deleted": True})),
    ]
    bronze = spark.createDataFrame(rows, "load_id string, ingested_at timestamp, payload string")
    staged = stage_records(bronze)
    expected = [(1, "new & clean", "new & clean", "l2"), (2, None, "", "l1"), (5, "tie b", "tie b", "l2")]
    columns = ["id", "text", "full_text", "load_id"]
    assert sorted(map(tuple, staged.select(columns).collect())) == expected
    assert staged.select(F.unix_seconds("posted_at")).distinct().collect() == [(1704085200,)]
    again = stage_records(bronze.unionByName(bronze))
    assert sorted(map(tuple, again.select(columns).collect())) == expected


def test_latest_is_cut_before_the_shuffle(spark):
    frame = spark.range(1000).selectExpr("id % 3 as key", "id as at", "id as v")
    newest = latest_by(frame, ["key"], ["at"])
    assert sorted(map(tuple, newest.collect())) == [(0, 999, 999), (1, 997, 997), (2, 998, 998)]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.index("== Initial Plan ==") :] if "Initial" in plan else plan
    partial, final = initial.index("Partial"), initial.index("Final")
    assert final < initial.index("Exchange hashpartitioning") < partial


def test_contract(spark):
    frame = spark.createDataFrame([("n", "k")], "tech_name string, tech_key string")
    assert enforce_contract(frame, schemas.TAXONOMY_DIM).columns == ["tech_key", "tech_name"]
    with pytest.raises(ValueError, match="tech_key: bigint instead of string"):
        enforce_contract(frame.selectExpr("1L as tech_key", "tech_name"), schemas.TAXONOMY_DIM)
    with pytest.raises(ValueError, match="absent"):
        enforce_contract(frame.drop("tech_name"), schemas.TAXONOMY_DIM)


class _Session:
    """As much of a session as the folder lookup asks for."""

    def __init__(self, setting, already, master):
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}
        self.sparkContext = self
        self.getCheckpointDir = lambda: already
        self.master = master


def test_shared_dir_follows_the_session(spark):
    assert work_path(spark, "x").startswith(shared_dir(spark))
    assert shared_dir(_Session("hdfs://x/work/", None, "yarn")) == "hdfs://x/work"
    assert shared_dir(_Session(None, "s3a://y/work", "yarn")) == "s3a://y/work"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Session(None, None, "yarn"))


def test_spread_only_on_request(spark):
    rows = spark.range(100).coalesce(1)
    assert spread(rows, None) is rows
    assert spread(rows, 3).rdd.getNumPartitions() == 3


def test_scratch_is_emptied(spark):
    with Scratch(spark, "test") as work:
        table, n = work.write(spark.range(5), "t", None, 0)
        table, n = work.write(spark.range(7), "t", F.col("id") > 2, 1)
        assert (table.count(), n) == (12, 4)
    assert spark.read.parquet(f"{work.path}/t").count() == 0

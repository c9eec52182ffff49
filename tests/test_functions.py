"""Text, date, metric and JSON functions."""

import datetime as dt
import io
import random
import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.dates import (
    month_label,
    month_of,
    months_between_inclusive,
    parse_month_title,
    to_utc,
)
from tidegauge.functions.jsonfields import is_json, json_project
from tidegauge.functions.metrics import growth_pct, pct_diff, safe_share
from tidegauge.functions.text import (
    NFKC_UNSAFE_PATTERN,
    clean_html,
    contains_ignore_case,
    needs_nfkc,
    nfkc_lower,
)
from tidegauge.operators.scan import to_lines


def _map(spark, values, column):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in frame.orderBy("i").select(column).collect()]


CLEANING = [
    (None, None),
    ("", ""),
    ("Python<p>React", "PythonReact"),
    ("a &lt;b&gt; c", "a <b> c"),
    ("&amp;quot;", '"'),
    ("&amp;lt;", "&lt;"),
    ("it&#X27;s", "it's"),
    ("it&#39;s it&apos;s", "it's it's"),
    ("&LT;", "&LT;"),
    ("a&#x2F;b", "a&#x2F;b"),
    ("a\r\n\r\nb", "a b"),
    ("a \n  \n b", "a b"),
    ("a\tb", "a\tb"),
    (" x　", "x"),
    ("\tx\t", "\tx\t"),
    ("&#x26;#X26;", "&#X26;"),
    ("&#38;#x26;", "&"),
    ("a&#160;&nbsp;&#xA0;b", "a b"),
    ("&#60;&#x3C;&#62;&#x3e;", "<<>>"),
    ("<a\nhref='x'>y</a>", "y"),
    ("a < b", "a < b"),
    ("<>x", "<>x"),
]


def test_clean_html(spark):
    got = _map(spark, [c[0] for c in CLEANING], clean_html("v"))
    assert got == [c[1] for c in CLEANING]
    assert _map(spark, ["Python<p>React"], clean_html("v", tag_replacement=" ")) == ["Python React"]


def test_nfkc_lower(spark):
    values = ["ＡＢＣ", "ﬁn", "Ⅳ x²", "É", "Straße", "ΑΣ ΑΣΑ", "İ", "plain ASCII", None, "é", "K"]
    expected = [None if v is None else unicodedata.normalize("NFKC", v).lower() for v in values]
    assert _map(spark, values, nfkc_lower("v")) == expected


def test_characters_kept_in_the_jvm_are_stable():
    import re

    unsafe = re.compile(NFKC_UNSAFE_PATTERN)
    safe = [chr(c) for c in range(0x250) if not unsafe.match(chr(c))]
    assert len(safe) > 300
    assert all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in safe)
    random.seed(1)
    text = "".join(random.choice(safe) for _ in range(5000))
    assert unicodedata.normalize("NFKC", text) == text


def test_one_range_is_tried_at_characters_kept_in_the_jvm(spark):
    """A class of many ranges, tried at every character, took most of a scan."""
    import re

    ahead, held = re.fullmatch(r"\(\?=(\[.-.\])\)(\[[^^].*\])", NFKC_UNSAFE_PATTERN).groups()
    every = [chr(c) for c in range(0x110000)]
    assert not any(re.match(ahead, c) for c in every[:0xA0])
    assert all(re.match(ahead, c) for c in every if re.match(held, c))
    # The pattern as it was, and as Spark reads it.
    kept = re.compile(
        "[\u0000-\u009f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb"
        "\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e]"
    )
    assert all(bool(re.match(held, c)) != bool(kept.match(c)) for c in every)
    some = [*every[:0x250], "\u0301", "\ufb01", "\uffff", "\U0001d400", "\U0010ffff"]
    assert _map(spark, ["aé" + c for c in some], needs_nfkc(F.col("v"))) == [not kept.match(c) for c in some]


def test_lines_like_universal_newlines(spark):
    texts = ["a\nb", "a\r\nb\rc\n", "", "\n", "\n\n", "x y\x0bz", "\r\n\r\n", "end\n\n"]
    frame = spark.createDataFrame(list(enumerate(texts)), "d int, text string")
    got: dict[int, list] = {}
    for r in to_lines(frame, "d", "text").orderBy("d", "line_no").collect():
        got.setdefault(r.d, []).append((r.line_no, r.line))
    for i, text in enumerate(texts):
        # newline=None translates every line end, as files are opened
        lines = [x.rstrip("\n") for x in io.TextIOWrapper(io.BytesIO(text.encode()), "utf-8")]
        assert got.get(i, []) == list(enumerate(lines, 1))


TITLES = [
    ("Ask us: Who is hiring? (November 2023)", (2023, 11)),
    ("Ask us: Who's hiring? (March 2024)", (2024, 3)),
    ("Who is hiring? (January 2020)", (2020, 1)),
    ("ASK US: WHO IS HIRING? (DECEMBER 2019)", (2019, 12)),
    ("Ask us: Who is hiring (April 2018)", (2018, 4)),
    ("Who is hiring?(April 2011)", (2011, 4)),
    ("My new project", None),
    ("Freelancer? Seeking freelancer? (November 2023)", None),
    ("Who wants to be hired? (November 2023)", None),
    ("Who is hiring? (Smarch 2023)", None),
    ("Who is hiring? (Nov 2023)", None),
    ("Who is hiring? (November 23)", None),
    (None, None),
]


def test_month_titles(spark):
    got = _map(spark, [t[0] for t in TITLES], parse_month_title("v"))
    assert [None if g is None else tuple(g) for g in got] == [t[1] for t in TITLES]


def test_to_utc(spark):
    texts = ["1175714200", "2007-04-04T19:16:40Z", "2007-04-04T14:16:40-05:00", "0", "soon", None]
    at = dt.datetime(2007, 4, 4, 19, 16, 40)
    got = _map(spark, texts, to_utc("v").cast("timestamp_ntz"))
    assert got == [at, at, at, dt.datetime(1970, 1, 1), None, None]
    typed = spark.createDataFrame([(1175714200,)], "v bigint")
    assert typed.select(to_utc("v", T.LongType()).cast("timestamp_ntz")).first()[0] == at
    stamped = typed.select(F.timestamp_seconds("v").alias("v"))
    same = stamped.select(to_utc("v", T.TimestampType()).cast("timestamp_ntz"))
    assert same.first()[0] == at


def test_months(spark):
    row = (
        spark.sql("select timestamp'2024-02-29 23:59:59' as v")
        .select(month_of("v"), month_label("v"))
        .first()
    )
    assert tuple(row) == (dt.date(2024, 2, 1), "2024-02")
    months = months_between_inclusive(dt.date(2011, 6, 15), dt.date(2026, 1, 1))
    assert (len(months), months[0], months[-1]) == (176, dt.date(2011, 6, 1), dt.date(2026, 1, 1))


def test_guarded_arithmetic(spark):
    rows = [(1, 4), (1, 0), (None, 4), (1, None), (0, 0), (None, None)]
    frame = spark.createDataFrame(rows, "a bigint, b bigint").coalesce(1)
    got = frame.select(
        safe_share(F.col("a"), F.col("b")), growth_pct(F.col("a"), F.col("b")), pct_diff(F.col("a"), F.col("b"))
    ).collect()
    assert [r[0] for r in got] == [0.25, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert [r[1] for r in got] == [-75.0, None, None, None, None, None]
    assert [r[2] for r in got] == [75.0, None, 100.0, None, None, None]


def test_search(spark):
    assert _map(spark, ["Node.js", "JS", "x"], contains_ignore_case("v", " jS ")) == [True, True, False]
    assert _map(spark, ["a", "b"], contains_ignore_case("v", "  ")) == [True, True]


def test_json_project(spark):
    payload = (
        '{"id":8863,"big":9007199254740991,"pi":3.14159265359,"by":"dhouston","dead":false,'
        '"metadata":{"source":"api","version":"v0","tags":["a","b"]},"kids":[456,789,101112,131415],'
        '"nothing":null,"object":{"x":1}}'
    )
    frame = spark.createDataFrame([(payload,), ('{"id":"7"}',)], "payload string").coalesce(1)
    fields = {
        "id": ("id", "bigint"),
        "id_text": ("id", "string"),
        "big": ("big", "bigint"),
        "pi": ("pi", "double"),
        "by": ("by", "string"),
        "dead": ("dead", "boolean"),
        "source": ("metadata.source", "string"),
        "tag": ("metadata.tags[1]", "string"),
        "kids": ("kids", "bigint[]"),
        "first": ("kids[0]", "string"),
        "last": ("kids[3]", "bigint"),
        "beyond": ("kids[9]", "bigint"),
        "nothing": ("nothing", "string"),
        "object": ("object", "string"),
    }
    first, second = json_project(frame, "payload", fields, keep=[]).collect()
    assert first.asDict() == {
        "id": 8863,
        "id_text": "8863",
        "big": 9007199254740991,
        "pi": 3.14159265359,
        "by": "dhouston",
        "dead": False,
        "source": "api",
        "tag": "b",
        "kids": [456, 789, 101112, 131415],
        "first": "456",
        "last": 131415,
        "beyond": None,
        "nothing": None,
        "object": '{"x":1}',
    }
    assert second["id"] == 7 and second["kids"] is None and second["source"] is None
    with pytest.raises(ValueError):
        json_project(frame, "payload", {"a": ("kids[0]", "int"), "b": ("kids.x", "int")})


def test_one_parse_per_row(spark):
    """A filter on extracted fields must not parse the text again."""
    frame = spark.createDataFrame([('{"a":1,"b":2}',)], "payload string")
    fields = {"a": ("a", "int"), "b": ("b", "int")}
    filtered = json_project(frame, "payload", fields).filter("a = 1 and b = 2")
    plan = filtered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_is_json(spark):
    good = ['{"a":1}', "[1,2]", '"s"', "null", "1", '{"a":{"b":[1]}}']
    bad = ['{"a":1', '{"a":1} x', "1] [2", '1} {"b":2', "1,2", "", "  ", None, "{a}", '{"a":1}]', '{"k": 6']
    assert _map(spark, good, is_json("v")) == [True] * len(good)
    assert _map(spark, bad, is_json("v")) == [False] * len(bad)

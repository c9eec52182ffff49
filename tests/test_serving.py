"""Series requests, listings, paging, pivot."""

import datetime as dt

import pytest

from tidegauge.operators.compare import missing_keys, reconcile
from tidegauge.operators.series import (
    fetch_all,
    fetch_one,
    flatten_series,
    get_trends,
    list_terms,
    lookup_names,
    page,
    page_info,
    pivot_series,
    search_terms,
    selected_keys,
    series_points,
    trend_request,
)
from tidegauge.operators.validate import series_violations, term_violations


@pytest.fixture(scope="module")
def trends(spark):
    python = zip([(2023, 12), (2024, 1), (2024, 2), (2024, 3), (2024, 4)], [95, 100, 120, 110, 130])
    react = zip([(2024, 1), (2024, 2), (2024, 3)], [80, 90, 95])
    postgres = zip([(2024, 1), (2024, 2), (2024, 3)], [50, None, 60])
    rows = [
        (key, name, dt.date(y, m, 1), n)
        for key, name, points in (
            ("python", "Python", python), ("react", "React", react), ("postgresql", "PostgreSQL", postgres)
        )
        for (y, m), n in points
    ]
    return spark.createDataFrame(rows, "tech_key string, tech_name string, month date, mention_count bigint")


JAN, MAR = dt.date(2024, 1, 1), dt.date(2024, 3, 31)


def test_series(trends):
    rows = get_trends(trends, ["react", "python", "postgresql", "cobol"], JAN, MAR).collect()
    got = [(r.tech_key, r.name, [(p["month"], p["count"]) for p in r.data]) for r in rows]
    assert got == [
        ("postgresql", "PostgreSQL", [("2024-01", 50), ("2024-02", 0), ("2024-03", 60)]),
        ("python", "Python", [("2024-01", 100), ("2024-02", 120), ("2024-03", 110)]),
        ("react", "React", [("2024-01", 80), ("2024-02", 90), ("2024-03", 95)]),
    ]
    assert get_trends(trends, [], JAN, MAR).isEmpty()
    assert get_trends(trends, ["python"], MAR, JAN).isEmpty()
    assert get_trends(trends, ["python"], dt.date(2024, 1, 2), dt.date(2024, 2, 1)).first().data[0]["month"] == "2024-02"
    flat = flatten_series(get_trends(trends, ["python"], JAN, MAR))
    assert flat.columns == ["tech_key", "name", "month", "count"] and flat.count() == 3


def test_pivot(trends):
    points = series_points(trends, ["python", "react"], dt.date(2023, 12, 1), MAR)
    wide = pivot_series(points, ["python", "react"])
    assert wide.columns == ["date", "python", "react"]
    assert [tuple(r) for r in wide.collect()] == [
        ("2023-12", 95, None), ("2024-01", 100, 80), ("2024-02", 120, 90), ("2024-03", 110, 95),
    ]


def test_requests():
    as_of = dt.date(2024, 3, 31)
    request = trend_request(" python, react ,", as_of=as_of)
    assert (request.keys, request.start, request.end) == (("python", "react"), dt.date(2023, 3, 28), as_of)
    assert trend_request(["a"], end="2024-02-29").start == dt.date(2023, 2, 28)
    assert trend_request(["a"], start="2020-01-01", end="2025-01-31").start == dt.date(2020, 1, 1)
    assert len(trend_request([f"k{i}" for i in range(10)], as_of=as_of).keys) == 10
    for bad in (None, "", " , ", [], ["a b"], ["a;drop"], ["é"], ["a\n"], [f"k{i}" for i in range(11)]):
        if bad == ["a\n"]:
            assert trend_request(bad, as_of=as_of).keys == ("a",)  # surrounding space is dropped
            continue
        with pytest.raises(ValueError):
            trend_request(bad, as_of=as_of)
    with pytest.raises(ValueError, match="60"):
        trend_request(["a"], start="2020-01-01", end="2025-02-01")
    with pytest.raises(ValueError):
        trend_request(["a"], start="01/02/2024")


TERMS = [
    ("python", "Python", "Language"), ("react", "React", "Framework"), ("aws", "AWS", "Cloud"),
    ("postgresql", "PostgreSQL", "Database"), ("orphan", "Orphan", "Tool"),
]


def test_listing_and_lookup(spark):
    taxonomy = spark.createDataFrame(TERMS, "tech_key string, display_name string, category string")
    facts = spark.createDataFrame([("python",)] * 3 + [("react",), ("aws",), ("postgresql",)], "tech_key string")
    listed = list_terms(taxonomy, facts)
    assert [r.name for r in listed.collect()] == ["AWS", "PostgreSQL", "Python", "React"]
    found = search_terms(listed, " P", ["python"])
    assert [r.name for r in found.collect()] == ["PostgreSQL"]
    assert search_terms(listed, "", []).count() == 4
    named = lookup_names(selected_keys(spark, ["react", "cobol", "python"]), listed).orderBy("position")
    assert [(r.key, r.name) for r in named.collect()] == [("react", "React"), ("cobol", "cobol"), ("python", "Python")]
    assert term_violations(listed).isEmpty()


def test_paging(spark):
    rows = spark.createDataFrame(
        [(i, n, v) for i, (n, v) in enumerate([("alpha", 1.5), ("beta", 2.5), ("gamma", 3.5), ("delta", 4.5), ("epsilon", 5.5)], 1)],
        "id int, name string, value double",
    )
    assert [r.id for r in page(rows, ["id"]).collect()] == [1, 2, 3, 4, 5]
    assert [r.id for r in page(rows, ["id"], 2, 1).collect()] == [2, 3]
    assert page(rows, ["id"], 0).isEmpty() and page(rows, ["id"], 5, 9).isEmpty()
    for limit, offset in ((-1, 0), (1, -1)):
        with pytest.raises(ValueError):
            page(rows, ["id"], limit, offset)
    assert tuple(page_info(rows, 2, 2).first()) == (5, 2, 2, True)
    assert page_info(rows, 5, 1).first().has_more is False
    query = "select id, name from {t} where value > ? order by id"
    assert fetch_all(spark, query, [2.0], t=rows).count() == 4
    assert fetch_one(spark, query, [4.0], t=rows) == {"id": 4, "name": "delta"}
    assert fetch_one(spark, query, [9.0], t=rows) is None


def test_shape_checks(spark):
    schema = "tech_key string, name string, data array<struct<month:string,count:bigint>>"
    rows = [
        ("ok", "Ok", [("2024-01", 0)]),
        ("empty", "Ok", []),
        ("", "x", []),
        ("a", None, []),
        ("b", "x", [("2024-1", 1)]),
        ("c", "x", [("2024-01", 1), ("2024-02", -1)]),
        ("d", "x", [("2024-01\n", 1)]),
        ("e", "x", [("2024-01", None)]),
        ("f", "x", None),
    ]
    bad = series_violations(spark.createDataFrame(rows, schema))
    assert sorted(r.tech_key for r in bad.collect()) == ["", "a", "b", "c", "d", "e", "f"]


def test_reconcile(spark):
    mart = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), ("e", 300)], "k string, n bigint")
    source = spark.createDataFrame([("a", 11), ("b", 1001), ("d", 1), ("e", 302)], "k string, m bigint")
    rows = {r.k: tuple(r)[1:] for r in reconcile(mart, source, ["k"], "n", "m").collect()}
    assert rows["a"] == (11, 10, 1, 100.0 / 11)
    assert rows["c"] == (0, 5, 5, None)
    assert rows["d"] == (1, 0, 1, 100.0)
    assert rows["e"][2] == 2 and "b" not in rows
    assert sorted(r.k for r in missing_keys(mart, source, ["k"]).collect()) == ["c"]

"""Leaks against a plain alignment of templates."""

import pytest
from pyspark.sql import functions as F

from tests.llm.data import SCHEMA, no_documents, odd_documents, prose, row
from tidegauge.llm import decontaminate

ITEMS = "item_id long, text string, words string"
QUESTION = "If Alice walks 12 km in 3 hours and rests twice on the way, how long does Alice need for 30 km at the same speed?"
OTHER = "If Bob walks 7.5 miles in 2 days and rests twice on the way, how long does Bob need for 21 miles at the same speed?"
MIXED = "If Bob walks 7 miles in 2 days and rests twice on the way, how long does Carol need for 21 feet at the same speed?"


def found_in(spark, rows, items):
    documents = spark.createDataFrame(rows, SCHEMA)
    return sorted((r["doc_id"], r["item_id"], r["verbatim"]) for r in decontaminate.leaks(documents, spark.createDataFrame(items, ITEMS)).collect())


def test_reparameterised_questions(spark):
    items = [(1, QUESTION, "x"), (2, "too short an item", "x"), (3, None, "x"), (4, "", "x"), (1, QUESTION, "x"), (5, "1 2 3 4 5 6 7 8 9 10 11", "x")]
    rows = [
        row(1, f"{prose(1, 30)} {QUESTION} {prose(2, 30)}"),
        row(2, f"{prose(3, 7)} {OTHER.replace(' ', '  ')}"),
        row(3, MIXED),
        row(4, prose(4, 200)),
        row(5, QUESTION[:60]),
        row(6, QUESTION.upper() + " " + QUESTION),
        row(7, QUESTION + " " + OTHER),
        row(8, "1 2 3 4 5 6 7 8 9 10 11 12"),
        row(9, "too short an item"),
        row(10, QUESTION.replace("the way", "the way or so")),
        # Before the insertion no window has enough plain words: 15 of 26 words are aligned.
        row(12, QUESTION.replace("twice", "twice or so")),
        row(11, None),
        row(11, QUESTION),
        row(11, QUESTION),
    ]
    found = found_in(spark, rows, items)
    assert [f for f in found if f[0] != 7] == [(1, 1, True), (2, 1, False), (6, 1, True), (10, 1, True), (11, 1, True)]


def test_template_and_values_keep_step(spark):
    texts = [QUESTION, OTHER, "3km 3.5 Km m 5 m,x7y Émile's İstanbul McDonald \ue001 ñandú 1,000,000 ½", "", "42"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in frame.select("text", decontaminate.template(frame.text).alias("a"), decontaminate.values(frame.text).alias("b")).collect():
        assert len(r["a"]) == len(r["b"])
    row_ = frame.select(decontaminate.template(frame.text).alias("a")).collect()[0]["a"]
    assert row_[:7] == ["\ue003", "\ue003", "walks", "\ue001", "\ue002", "in", "\ue001"]


@pytest.mark.parametrize("size", [12, 40])
def test_passages_at_every_offset(spark, size):
    items = [(i, prose(100 + i, size), "x") for i in range(5)]
    rows = [row(10 * i + k, f"{prose(i, 20 + k)} {items[i][1]} {prose(50 + i, k)}") for i in range(5) for k in range(5)]
    assert found_in(spark, rows, items) == sorted((10 * i + k, i, True) for i in range(5) for k in range(5))


def test_values_that_coincide_and_edited_slots(spark):
    same = QUESTION.replace("12", "4").replace("3 hours", "4 hours")
    head, tail = "Alice " + " ".join(prose(30, 11).lower().split()), " ".join(prose(31, 30).lower().split())
    long = f"{head} Alice {tail}"
    items = [(1, QUESTION, "x"), (2, long, "x")]
    rows = [
        row(1, f"{prose(1, 30)} {same}"),
        row(2, f"{prose(2, 30)} {head} Alicia {tail}"),
        row(3, f"{prose(3, 30)} Bob {head[6:]} Carol {prose(4, 30).lower()}"),
        row(4, MIXED),
    ]
    assert found_in(spark, rows, items) == [(1, 1, False), (2, 2, False)]


@pytest.mark.parametrize("size", [8, 9, 10])
def test_short_items_at_every_offset(spark, size):
    items = [(i, prose(100 + i, size), "x") for i in range(3)]
    rows = [row(10 * i + k, f"{prose(i, 20 + k)} {items[i][1]} {prose(50 + i, 9)}") for i in range(3) for k in range(5)]
    assert found_in(spark, rows, items) == sorted((10 * i + k, i, True) for i in range(3) for k in range(5))


def test_both_joins_agree(spark, monkeypatch):
    items = [(i, prose(100 + i, 30), "x") for i in range(4)]
    rows = [row(i, f"{prose(i, 25)} {items[i % 4][1]}") for i in range(30)]
    broadcast = found_in(spark, rows, items)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert found_in(spark, rows, items) == broadcast and len(broadcast) == 30


def test_odd_documents(spark):
    items = spark.createDataFrame([(1, prose(99, 80), "x")], ITEMS)
    documents = odd_documents(spark)
    assert sorted(r["doc_id"] for r in decontaminate.leaks(documents, items).collect()) == [4, 5, 6]
    kept = decontaminate.without_leaks(documents, items)
    assert kept.columns == documents.columns and kept.count() == 17
    assert decontaminate.leaks(no_documents(spark), items).collect() == []
    assert decontaminate.leaks(documents, spark.createDataFrame([], ITEMS)).collect() == []
    assert decontaminate.without_leaks(documents, spark.createDataFrame([], ITEMS)).count() == 20


def test_long_lists_of_numbers(spark):
    lists = [mark.join(["1", "22"] * 50_000) for mark in (",", ".", ", ", " km ", "1")]
    rows = [row(i, text) for i, text in enumerate(lists)] + [row(9, lists[0] + " " + QUESTION)]
    assert found_in(spark, rows, [(1, QUESTION, "x"), (2, lists[0], "x")]) == [(9, 1, True)]
    words = spark.createDataFrame(rows, SCHEMA).select(decontaminate.template(F.col("text")).alias("w"), decontaminate.values(F.col("text")).alias("v"))
    assert all(len(r["w"]) == len(r["v"]) for r in words.collect())

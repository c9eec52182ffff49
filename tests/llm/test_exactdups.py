"""Exact dedup against a plain grouping of normalised texts."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.data import no_documents, odd_documents, odd_rows, prose, row, SCHEMA
from tidegauge.llm import exactdups


def plain(rows):
    """(doc_id, keep_id, group_size, kept, digest) of rows of (doc_id, text)."""
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", text or "") for _, text in rows]
    ids = defaultdict(list)
    for (doc, _), text in zip(rows, texts):
        ids[text].append(doc)
    out = []
    for (doc, _), text in zip(rows, texts):
        keep = min((i for i in ids[text] if i is not None), default=None)
        out.append((doc, keep, len(ids[text]), doc == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def many_rows():
    white = ["a b", "a  b", "a\tb", "a \n b", "a b", " a b", "a b ", "a\x0bb", "a\x1cb", " " * 50_000 + "x"]
    rows = odd_rows() + [row(100 + i, text) for i, text in enumerate(white)]
    rows += [row(200 - i, prose(50, 40)) for i in range(60)] + [row(300 + i, prose(i, 20)) for i in range(30)]
    return rows + [row(None, prose(50, 40)), row(None, "only nulls"), row(None, "only\nnulls")]


def collected(found):
    lists = found.withColumn("digest", F.lower(F.hex("digest"))).collect()
    return sorted((tuple(r) for r in lists), key=repr)


@pytest.mark.parametrize("salts", [1, 32])
def test_as_plain_grouping(spark, monkeypatch, salts):
    monkeypatch.setattr(exactdups, "SALTS", salts)
    rows = many_rows()
    documents = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert collected(exactdups.exact_duplicates(documents)) == plain([r[:2] for r in rows])


def test_colliding_digests_do_not_merge_texts(spark):
    rows = many_rows()
    documents = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for weak in (lambda c: F.lit(1), lambda c: F.crc32(c.cast("binary")) % 3):
        found = exactdups.exact_duplicates(documents, digest=weak).drop("digest").collect()
        assert sorted(map(tuple, found), key=repr) == sorted((x[:4] for x in plain([r[:2] for r in rows])), key=repr)
        kept = exactdups.keep_one_of_each(documents, digest=weak)
        assert kept.count() == len({x[4] for x in plain([r[:2] for r in rows])})


def test_whole_rows_that_stay(spark):
    documents = odd_documents(spark)
    kept = exactdups.keep_one_of_each(documents)
    assert kept.columns == documents.columns
    expected = {(x[1], x[4]) for x in plain([r[:2] for r in odd_rows()])}
    texts = [(r["doc_id"], hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "").encode()).hexdigest()) for r in kept.collect()]
    assert len(texts) == len(expected) and set(texts) == expected


def test_empty_table(spark):
    assert exactdups.exact_duplicates(no_documents(spark)).collect() == []
    assert exactdups.keep_one_of_each(no_documents(spark)).collect() == []


def test_no_python_and_no_content_in_the_last_join(spark):
    plan = exactdups.exact_duplicates(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|NestedLoop|Cartesian", plan)
    assert not re.search(r"Exchange hashpartitioning\(digest_#\d+, \d+\).*\n.*content_", plan)

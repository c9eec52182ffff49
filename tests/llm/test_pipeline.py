"""Registered queries and the pipeline."""

import zlib

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tests.llm.data import no_documents, odd_documents, odd_rows
from tests.oracle import connect, difference
from tidegauge.llm.queries import ORACLE, QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, spark, sf_dir):
    assert difference(spark, connect(sf_dir), name, sf_dir) is None


@pytest.mark.parametrize("name", ["op5_hypergeometric_shards", "op9_token_counts", "op10_bpe_codec"])
def test_query_returns_every_document(name, spark, sf_dir):
    found = queries()[name](spark, sf_dir)
    assert sorted(r["doc_id"] for r in found.select("doc_id").collect()) == list(range(200))


def test_shard_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries()["op5_hypergeometric_shards"](spark, sf_dir).collect():
        text = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "rows", None)


def through(spark, docs, folder):
    for _, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, folder)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == columns
    return docs


def test_odd_documents(spark, sf_dir):
    found = through(spark, odd_documents(spark), sf_dir).collect()
    ids = [r["doc_id"] for r in found]
    assert all(r["round_trip"] for r in found)
    assert {1, 4, 5, 6, 13, 17} <= set(ids) and not {2, 7, 8, 9, 10} & set(ids)
    assert ids.count(15) == 1
    assert through(spark, no_documents(spark), sf_dir).collect() == []


def test_documents_of_a_folder(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert 150 < len(found) <= 200 and len({r["doc_id"] for r in found}) == len(found)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in found)
    assert len(odd_rows()) == 20

"""Exact sizes, whole slots, and an even deal."""

import zlib

import numpy as np
import pytest

from tests.llm.data import no_documents, odd_documents, odd_rows
from tidegauge.llm import shards


def test_odd_documents(spark):
    found = shards.shuffle_into_shards(odd_documents(spark), 6).collect()
    want = [(r[0], 1 + len((r[1] or "").encode()), None if r[1] is None else zlib.crc32(r[1].encode())) for r in odd_rows()]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in found), key=str) == sorted(want, key=str)
    by_shard = {}
    for r in found:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(map(len, by_shard.values())) == [3, 3, 3, 3, 4, 4]
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())


def test_more_shards_than_rows(spark):
    found = shards.shuffle_into_shards(odd_documents(spark).limit(3), 16).collect()
    assert len(found) == 3 and {r["slot"] for r in found} == {0}
    assert shards.shuffle_into_shards(no_documents(spark)).collect() == []


def test_many_blocks_and_seeds(spark, monkeypatch):
    monkeypatch.setattr(shards, "BLOCK_ROWS", 50)
    table = spark.range(1000).selectExpr("id AS doc_id", "cast(id AS string) AS text").repartition(7)
    deal = {seed: shards.shuffle_into_shards(table, 4, seed).collect() for seed in (1, 2)}
    for rows in deal.values():
        assert sorted(r["doc_id"] for r in rows) == list(range(1000))
        for shard in range(4):
            assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(250))
        # Neighbouring ids do not stay together.
        order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
        assert abs(np.corrcoef(order, range(1000))[0, 1]) < 0.15
    assert {r["doc_id"]: r["shard"] for r in deal[1]} != {r["doc_id"]: r["shard"] for r in deal[2]}


def test_matrix_sums_and_law():
    sizes, targets = [7, 0, 5, 8], [5, 5, 5, 5]
    first = []
    for seed in range(3000):
        m = shards.matrix(sizes, targets, seed)
        assert m.sum(axis=1).tolist() == sizes and m.sum(axis=0).tolist() == targets
        first.append(m[0, 0])
    # Hypergeometric: 7 of 20 rows, 5 places.
    assert np.mean(first) == pytest.approx(1.75, abs=0.06)
    assert np.var(first) == pytest.approx(7 * 0.25 * 0.75 * 13 / 19, abs=0.08)


def test_large_hypergeometric_agrees_with_library(monkeypatch):
    args = 400_000, 600_000, 1000
    draw = np.random.default_rng(1)
    library = [shards.hypergeometric(draw, *args) for _ in range(4000)]
    monkeypatch.setattr(shards, "LIBRARY_ROWS", 0)
    own = [shards.hypergeometric(draw, *args) for _ in range(4000)]
    assert np.mean(own) == pytest.approx(np.mean(library), abs=1.2)
    assert np.std(own) == pytest.approx(np.std(library), rel=0.06)
    assert shards.hypergeometric(draw, 3, 0, 2) == 2 and shards.hypergeometric(draw, 0, 5, 2) == 0
    assert 4e11 < shards.hypergeometric(draw, 10**12, 10**12, 10**12) < 6e11

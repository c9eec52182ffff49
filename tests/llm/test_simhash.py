"""Fingerprints, the trie join and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tests.llm.data import no_documents, odd_documents, odd_rows, prose, row, SCHEMA
from tidegauge.llm import components, simhash


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, budget=2):
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= budget:
                up[root(a)] = root(b)
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [least.get(root(i)) for i in range(len(ids))]


def test_odd_documents(spark):
    rows = odd_rows()
    prints = [plain_fingerprint(r[1]) for r in rows]
    want = sorted(
        ((str(r[0]), format(p, "016x"), c) for r, p, c in zip(rows, prints, plain_components([r[0] for r in rows], prints))), key=str
    )
    found = simhash.near_duplicates(odd_documents(spark)).collect()
    assert sorted(((str(x["doc_id"]), x["fingerprint"], x["component_id"]) for x in found), key=str) == want


def test_empty_table(spark):
    assert simhash.near_duplicates(no_documents(spark)).collect() == []
    assert simhash.keep_one_of_each(no_documents(spark)).collect() == []


def test_one_of_each_stays(spark):
    documents = odd_documents(spark)
    rows = odd_rows()
    named = plain_components([r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows])
    kept = simhash.keep_one_of_each(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({c for c in named if c is not None})


def edited(text, seed, edits):
    draw, words = random.Random(seed), text.split()
    for k in draw.sample(range(len(words)), edits):
        words[k] = f"w{seed}x{k}"
    return " ".join(words)


def test_pipeline_stage_keeps_the_least_id_of_each_component(spark, sf_dir):
    rows = []
    for i in range(12):
        base = prose(i, 600)
        rows += [row(10 * i + 9, base)] + [row(10 * i + k, edited(base, 10 * i + k, edits)) for k, edits in enumerate((1, 1, 2, 6, 60))]
    rows += [row(1000 + i, prose(500, 3) if i % 2 else "") for i in range(6)] + [row(2000, None)]
    prints = [plain_fingerprint(r[1]) for r in rows]
    want = sorted(set(plain_components([r[0] for r in rows], prints)))
    kept = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, SCHEMA), sf_dir)
    # Some copies join their base and some edited texts stay.
    assert 15 < len(want) < len(rows) - 10
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_pipeline_stage_on_odd_and_empty_tables(spark, sf_dir):
    kept = corpus_pipeline.simhash_near_dedup(spark, odd_documents(spark), sf_dir)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd_documents(spark).columns and {1, 4, 5, 6, 13, 14, 17} <= set(ids)
    assert not {2, 8, 9} & set(ids) and ids.count(15) == 1
    assert corpus_pipeline.simhash_near_dedup(spark, no_documents(spark), sf_dir).collect() == []


def test_many_near_copies_in_one_group(spark):
    base = prose(3, 400).split()
    rows = [row(i, " ".join(base[:200] + [f"w{i % 40}"] + base[200:])) for i in range(400)] + [row(1000 + i, prose(i, 50)) for i in range(50)]
    prints = [plain_fingerprint(r[1]) for r in rows]
    found = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == dict(zip((r[0] for r in rows), plain_components([r[0] for r in rows], prints)))


@pytest.mark.parametrize(("count", "bits"), [(300, 8), (2000, 12), (400, 64)])
def test_trie_links(count, bits, monkeypatch):
    monkeypatch.setattr(simhash, "WALKED", 500)
    draw = np.random.default_rng(bits)
    values = draw.integers(0, 2**bits, count, dtype=np.uint64) << np.uint64(64 - bits)
    values = np.unique(np.r_[values, values ^ np.uint64(1 << 63), values ^ np.uint64(5)])
    found = {tuple(p) for pairs in simhash.trie_links(values, values, True, 2) for p in pairs.T.tolist()}
    close = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    assert found == {(i, j) for i, j in np.argwhere(close).tolist() if i < j}
    half = len(values) // 2
    found = {tuple(p) for pairs in simhash.trie_links(values[:half], values[half:], False, 2) for p in pairs.T.tolist()}
    assert found == {(i, j - half) for i, j in np.argwhere(close).tolist() if i < half <= j}


def test_node_pairs_cover_all_links():
    draw = np.random.default_rng(1)
    values = np.unique(draw.integers(0, 2**12, 1500, dtype=np.uint64) << np.uint64(52))
    counts = {}
    for v in values.tolist():
        counts[v >> 56] = counts.get(v >> 56, 0) + 1
    nodes = simhash.cut_trie(counts, 8, 20)
    pairs = set(simhash.node_pairs(nodes, 2))
    node = {v: next(i for i, (n, p) in enumerate(nodes) if v >> (64 - n) == p) for v in values.tolist()}
    for a in values.tolist():
        for b in values.tolist():
            if (a ^ b).bit_count() <= 2:
                assert (min(node[a], node[b]), max(node[a], node[b])) in pairs


def test_components_of_long_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 300)] + [(7, 7), (None, 3)]
    found = {r["u"]: r["v"] for r in components.stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, **{500 + i: 500 for i in range(1, 300)}}

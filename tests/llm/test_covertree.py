"""Top-k search against all products."""

import math

import numpy as np
import pytest

from tidegauge.llm import covertree

SCHEMA = "vec_id long, embedding array<float>, rank string, pivot string"


def plain(rows, k, every):
    least = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(1024 * float(np.float32(x))) for x in v]
        least[i] = min(least.get(i, whole), whole)
    out = []
    for q in (i for i in least if i % every == 0):
        scores = [(-sum(a * b for a, b in zip(least[q], v)), i) for i, v in least.items() if i != q]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found_in(spark, rows, k=10, every=100):
    table = spark.createDataFrame([(i, v, "x", "x") for i, v in rows], SCHEMA)
    return sorted(map(tuple, covertree.top_inner_products(table, k, every).collect()))


def test_odd_vectors(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(0, 0.2, 6).tolist()) for i in range(60)]
    rows += [(i, [0.5] * 6) for i in range(100, 400)]  # one vector three hundred times
    rows += [(500, None), (501, []), (502, [None] * 6), (503, [float("nan")] * 6), (504, [float("inf")] * 6)]
    rows += [(None, [0.1] * 6), (600, [0.1, 0.2]), (700, [0.0] * 6), (700, [0.0] * 6), (800, [0.3] * 6), (800, [-0.3] * 6)]
    assert found_in(spark, rows) == plain(rows, 10, 100)


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, -1.0])]
    assert found_in(spark, rows) == plain(rows, 10, 100)
    assert found_in(spark, [(0, [1.0])]) == []
    assert found_in(spark, []) == []


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(covertree, "CANDIDATES_PER_BLOCK", 60)
    monkeypatch.setattr(covertree, "QUERIES_PER_BLOCK", 10)
    monkeypatch.setattr(covertree, "BLOCKS_PER_GROUP", 2)
    draw = np.random.default_rng(2)
    centres = draw.normal(0, 0.5, (12, 8))
    rows = [(i, (centres[i % 12] + draw.normal(0, 0.01, 8)).tolist()) for i in range(900)]
    assert found_in(spark, rows, 7, 9) == plain(rows, 7, 9)


@pytest.mark.parametrize("spread", [0.0, 0.01, 1.0])
def test_tree_invariants_and_search(spread):
    draw = np.random.default_rng(3)
    points = np.floor(1024 * (draw.normal(0, 1, (9, 5))[draw.integers(0, 9, 1500)] + draw.normal(0, spread, (1500, 5))))
    tree = covertree.Tree(points)
    assert (tree.points == points[tree.order]).all()
    for n in range(len(tree.lows)):
        inside = tree.points[tree.lows[n] : tree.highs[n]]
        assert (np.linalg.norm(inside - tree.centres[n], axis=1) <= tree.radii[n] + 1e-6).all()
        spans = sorted((tree.lows[c], tree.highs[c]) for c in tree.children[n])
        assert not spans or (spans[0][0], spans[-1][1]) == (tree.lows[n], tree.highs[n])
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    queries = covertree.Tree(points[:40])
    best = covertree.dual_search(queries, tree, [[i] for i in range(1500)], 5, np.full(40, -np.inf))
    for q in range(40):
        scores = points @ queries.points[q]
        want = sorted((-int(s), i) for i, s in enumerate(scores))[:5]
        assert best.found[q] == want


def test_groups_are_pruned():
    """Far clusters are given up: fewer products than all pairs."""
    draw = np.random.default_rng(5)
    centres = 1000 * np.eye(16)
    points = np.floor(np.repeat(centres, 200, axis=0) + draw.normal(0, 5, (3200, 16)))
    tree, queries = covertree.Tree(points), covertree.Tree(points[:100])
    seen = []
    best = covertree.Best.add
    try:
        covertree.Best.add = lambda self, q, s, i: (seen.append(len(s)), best(self, q, s, i))[1]
        covertree.dual_search(queries, tree, [[i] for i in range(3200)], 10, np.full(100, -np.inf))
    finally:
        covertree.Best.add = best
    assert sum(seen) < 100 * 400

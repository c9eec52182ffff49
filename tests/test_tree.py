"""Closures against a plain breadth-first search, thread lookup, tombstones."""

import datetime as dt
import random
from collections import deque

import pytest

from tidegauge.operators import tree
from tidegauge.operators.tree import (
    collect_threads,
    descendants,
    find_threads,
    mark_missing,
    tombstones,
    tree_edges,
)

ITEM = "id bigint, kids array<bigint>"


def _search(kids: dict, roots, max_depth=None):
    out = set()
    for root in roots:
        depth, queue = {root: 0}, deque([root])
        while queue:
            here = queue.popleft()
            if max_depth is not None and depth[here] >= max_depth:
                continue
            for child in kids.get(here, []):
                if child not in depth:
                    depth[child] = depth[here] + 1
                    queue.append(child)
        out |= {(root, node, d) for node, d in depth.items()}
    return out


def _closure(spark, kids, roots, max_depth=None):
    items = spark.createDataFrame(list(kids.items()), ITEM)
    starts = spark.createDataFrame([(r,) for r in roots], "root bigint")
    rows = [tuple(r) for r in descendants(items, starts, max_depth).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


TREES = {
    "single": ({1: []}, [1]),
    "children": ({1: [2, 3], 2: [], 3: []}, [1]),
    "nested": ({1: [2], 2: [3], 3: [4], 4: []}, [1]),
    "missing": ({1: [2, 9], 2: [8]}, [1]),
    "missing root": ({1: [2]}, [7]),
    "kid listed twice": ({1: [2, 2], 2: [3]}, [1]),
    "two parents": ({1: [2, 3], 2: [4], 3: [4], 4: [5]}, [1]),
    "cycle": ({1: [2], 2: [3], 3: [1, 4]}, [1]),
    "cycle aside": ({1: [2], 5: [6], 6: [7], 7: [5]}, [1]),
    "own kid": ({1: [1, 2]}, [1]),
    "root under root": ({1: [2], 2: [3], 3: []}, [1, 2]),
    "two threads": ({1: [2], 2: [], 10: [11], 11: [12]}, [1, 10, 10]),
    "unreached": ({1: [2], 3: [4]}, [1]),
    "wide": ({1: list(range(2, 202))}, [1]),
}


@pytest.mark.parametrize("name", TREES)
def test_hand_made(spark, name):
    kids, roots = TREES[name]
    assert _closure(spark, kids, roots) == _search(kids, roots)


@pytest.mark.parametrize("depth", [0, 1, 3])
@pytest.mark.parametrize("name", ["nested", "two parents"])
def test_max_depth(spark, name, depth):
    kids, roots = TREES[name]
    assert _closure(spark, kids, roots, depth) == _search(kids, roots, depth)


@pytest.mark.parametrize("seed", range(4))
def test_random_forest(spark, seed):
    draw = random.Random(seed)
    kids: dict[int, list] = {}
    for node in range(1, 300):
        # deep and skewed: a third of all nodes hang below one parent
        parent = 5 if node > 5 and draw.random() < 0.33 else draw.randrange(max(0, node - 6), node)
        kids.setdefault(parent, []).append(node)
    assert _closure(spark, kids, [0]) == _search(kids, [0])


@pytest.mark.parametrize("seed", range(4))
def test_random_graph(spark, seed):
    draw = random.Random(seed)
    kids = {n: [draw.randrange(60) for _ in range(draw.randrange(4))] for n in range(50)}
    roots = [0, 3, 59]
    assert _closure(spark, kids, roots) == _search(kids, roots)


def _rounds(spark, monkeypatch, kids, roots=(0,)):
    """Closure, tables written, and the length of the result's plan."""
    written, write = [], tree.Scratch.write
    monkeypatch.setattr(tree.Scratch, "write", lambda self, *a: written.append(a[1]) or write(self, *a))
    found = _closure(spark, kids, list(roots))
    monkeypatch.setattr(tree.Scratch, "write", write)
    return found, written.count("pointers"), written.count("reached")


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    found, doublings, _ = _rounds(spark, monkeypatch, {n: [n + 1] for n in range(2000)})
    assert len(found) == 2001 and doublings < 15


def test_repeat_elsewhere_adds_no_round(spark, monkeypatch):
    chain = {n: [n + 1] for n in range(200)}
    plain = _rounds(spark, monkeypatch, chain)
    aside = {1000: [1002], 1001: [1002], 1002: [1003]}
    assert _rounds(spark, monkeypatch, chain | aside) == plain
    with_repeat = _rounds(spark, monkeypatch, chain | {500: [50], 1: [2, 500]})
    assert with_repeat[0] == _search(chain | {500: [50], 1: [2, 500]}, [0])
    assert with_repeat[1] <= plain[1] and with_repeat[2] <= 4


def test_plan_does_not_grow_with_depth(spark):
    lengths = []
    for depth in (20, 200):
        items = spark.createDataFrame([(n, [n + 1]) for n in range(depth)], ITEM)
        frame = descendants(items, spark.createDataFrame([(0,)], "root bigint"))
        lengths.append(len(frame._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert lengths[0] == lengths[1]


def test_each_id_once(spark):
    items = spark.createDataFrame([_item(10, kids=[11]), _item(11), _item(11), _item(11, kids=[12])], FULL)
    roots = spark.createDataFrame([(10,)], "id bigint")
    records = collect_threads(items, roots).collect()
    assert sorted((r.id, r.is_tombstone) for r in records) == [(10, False), (11, False), (12, True)]


def test_tombstones(spark):
    items = spark.createDataFrame([(1, [2, 3]), (2, [3, 4])], ITEM)
    stones = tombstones(tree_edges(items), items).orderBy("id").collect()
    assert [s.id for s in stones] == [3, 4]
    assert stones[0].asDict() == {
        "id": 3, "type": None, "by": None, "time": None, "text": None, "title": None, "url": None,
        "kids": [], "parent": None, "score": None, "descendants": None, "deleted": True,
        "dead": False, "is_tombstone": True,
    }
    closure = descendants(items, spark.createDataFrame([(1,)], "root bigint"))
    marked = {(r.id, r.is_tombstone) for r in mark_missing(closure, items).collect()}
    assert marked == {(1, False), (2, False), (3, True), (4, True)}


FULL = (
    "id bigint, type string, by string, time timestamp, text string, title string, url string, "
    "kids array<bigint>, parent bigint, score bigint, descendants bigint, deleted boolean, dead boolean"
)


def _item(number, kind="comment", title=None, kids=()):
    return (number, kind, "a", dt.datetime(2024, 1, 1), None, title, None, list(kids), None, None, None, False, False)


def test_threads(spark):
    items = spark.createDataFrame(
        [
            _item(10, "story", "Who is hiring? (March 2024)", [11, 12]),
            _item(11, kids=[13]),
            _item(13, kids=[99]),
            _item(20, "story", "Who is hiring? (April 2024)"),
            _item(21, "story", "Who's hiring? (April 2024)"),
            _item(22, "comment", "Who is hiring? (May 2024)"),
            _item(23, "story", "Who wants to be hired? (May 2024)"),
            _item(24, "story", None),
        ],
        FULL,
    )
    users = spark.createDataFrame(
        [("poster", [24, 77, 23, 22, 21, 20, 10, 21]), ("other", [20, 21])],
        "id string, submitted array<bigint>",
    )
    threads = {tuple(r) for r in find_threads(users, items).collect()}
    assert threads == {("poster", 2024, 3, 10), ("poster", 2024, 4, 21), ("other", 2024, 4, 20)}
    only = find_threads(users, items, [dt.date(2024, 3, 1)]).collect()
    assert [tuple(r) for r in only] == [("poster", 2024, 3, 10)]
    records = collect_threads(items, spark.createDataFrame([(10,)], "id bigint")).collect()
    assert {(r.id, r.is_tombstone) for r in records} == {
        (10, False), (11, False), (13, False), (12, True), (99, True),
    }

"""Rules on urls, and ranks against a plain iteration."""

import numpy as np
import pytest

from tidegauge.llm import linkgraph
from tidegauge.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, html string, host string, rank string, kind string"


def page(i, url, html=None):
    return (i, url, html, "x", "x", "x")


CASES = [
    ("https://WWW.Example.ORG/es/1", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://badexample.org/es/2", "badexample.org", "/es/2", "org/", "allow"),
    ("http://a.com/fr/?q=/de/", "a.com", "/fr/", "com/fr/", "allow"),
    ("http://a.com/de/#x", "a.com", "/de/", "com/de/", "block"),
    ("http://org", "org", "", None, "allow"),
    ("http://b.net?x://y.org/z", "b.net", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("HTTP://Ä.ORG/ü", "Ä.org", "/ü", "org/", "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([page(i, case[0]) for i, case in enumerate(CASES)], SCHEMA)
    found = {r["page_id"]: r for r in linkgraph.judge_urls(pages, URL_RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        assert (found[i]["host"], found[i]["path"], found[i]["rule"], found[i]["verdict"]) == (host, path, rule, verdict)


def plain_ranks(seeds, edges, damping, rounds):
    hosts = sorted(set(seeds) | {x for e in edges for x in e[:2]})
    index = {h: i for i, h in enumerate(hosts)}
    move = np.zeros((len(hosts), len(hosts)))
    for u, v, n in edges:
        move[index[u], index[v]] += n
    for i, row in enumerate(move):
        move[i] = row / row.sum() if row.sum() else np.eye(len(hosts))[i]
    start = np.array([float(seeds.get(h, 0)) for h in hosts])
    rank = start
    for _ in range(rounds):
        rank = (1 - damping) * start + damping * rank @ move
    return dict(zip(hosts, rank))


@pytest.mark.parametrize("rounds", [5, 12])
def test_ranks(spark, rounds):
    draw = np.random.default_rng(2)
    edges = {(f"h{a}", f"h{b}"): int(n) for a, b, n in zip(draw.integers(0, 12, 40), draw.integers(0, 12, 40), draw.integers(1, 9, 40)) if a != b}
    edges = [(u, v, n) for (u, v), n in edges.items()]
    seeds = {"h1": 5, "h3": 2, "lone": 4}
    found = linkgraph.spread(
        spark.createDataFrame([("t", h, m) for h, m in seeds.items()], "kind string, host string, mass long"),
        spark.createDataFrame([("t", *e) for e in edges], "kind string, u string, v string, n long"),
        0.85,
        rounds,
    )
    got = {r["host"]: r["rank"] for r in found.collect()}
    want = {h: r for h, r in plain_ranks(seeds, edges, 0.85, rounds).items() if h in got or r > 0}
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(sum(seeds.values()))


def test_links_carry_verdicts(spark):
    link = '<a href="{}">'.format
    rules = {"good.org/": "allow", "bad.org/": "block"}
    pages = [
        page(1, "http://good.org/1", link("https://Friend.net/x") + link("/own")),
        page(2, "http://bad.org/1", link("//friend.net/y")),
        page(3, "http://farm.net/1", link("http://bad.org/") * 3 + link("http://friend.net/")),
        page(4, "http://friend.net/1", None),
        page(4, "http://friend.net/1", None),
        page(5, "http://blog.farm.net/1", ""),
        page(6, "http://far.net/", "<a>"),
    ]
    found = linkgraph.judge_urls(spark.createDataFrame(pages, SCHEMA), rules).collect()
    verdicts = sorted((r["page_id"], r["verdict"]) for r in found)
    assert verdicts == [(1, "allow"), (2, "block"), (3, "block"), (4, "allow"), (4, "allow"), (5, "block"), (6, "allow")]


def test_empty_table(spark):
    assert linkgraph.judge_urls(spark.createDataFrame([], SCHEMA), URL_RULES).collect() == []

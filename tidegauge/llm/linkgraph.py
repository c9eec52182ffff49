"""URL verdicts: rules first, then trust and distrust spread over the graph of hosts.

A rule is a host with a path, like ``example.org/es/``, and fits the host and all of its
subdomains where the url's path starts with the rule's; the longest fitting rule decides.
Other urls go by their host. Pages that rules allow or block are the seeds: trust walks
from allowed pages' hosts along links, as personalised PageRank with restarts at the seeds
in proportion to their pages, and distrust walks from blocked pages' hosts against the
links. A host is blocked if its distrust exceeds ``ratio`` times its trust.

Edges are the links in the pages' HTML to other hosts, weighted by their number, and, both
ways, a host and the host one label above it if both have pages (``blog.site.net`` and
``site.net``), as relative links stay within a host. A host without edges keeps its rank.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and
is allowed unless the empty host earned distrust, which it cannot; null HTML has no links;
repeated rows are judged each and weigh as pages; other columns are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import stored

DAMPING = 0.85
ROUNDS = 30
# Rounds in one plan; after these the ranks are written to the shared folder.
ROUNDS_PER_PLAN = 5
ALLOW, BLOCK = "allow", "block"


def _lower(value: Column) -> Column:
    return F.translate(value, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for name, word in sorted(rules.items(), key=lambda item: (len(item[0]), item[0])):
        own, slash, rest = name.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def judged_by_rules(pages: DataFrame, rules: dict[str, str], url: str, id_column: str) -> DataFrame:
    located = pages.select(F.col(id_column), F.col(url).cast("string").alias("url_"))
    located = located.select(id_column, host_of(F.col("url_")).alias("host"), path_of(F.col("url_")).alias("path"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    return located.select(id_column, "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def host_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Edges (u, v, n) between different hosts, each once."""
    links = F.regexp_extract_all(F.col("html_"), F.lit(r"""(?i)href\s*=\s*["']\s*((?:https?:)?//[^"']*)"""), F.lit(1))
    texts = pages.select(host_of(F.col(url).cast("string")).alias("u"), F.col(html).cast("string").alias("html_"))
    linked = texts.select("u", F.explode(links).alias("target")).select(
        "u", host_of(F.concat(F.lit("http:"), F.regexp_replace("target", "^(?i)https?:", ""))).alias("v"), F.lit(1).alias("n")
    )
    hosts = pages.select(host_of(F.col(url).cast("string")).alias("u")).distinct()
    above = hosts.select("u", F.regexp_replace("u", r"^[^.]*\.", "").alias("v")).filter("u <> v")
    above = above.join(hosts.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v", F.lit(1).alias("n"))
    both = above.union(above.select(F.col("v").alias("u"), F.col("u").alias("v"), "n"))
    return linked.union(both).filter("u <> v and u <> '' and v <> ''").groupBy("u", "v").agg(F.sum("n").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Ranks (kind, host, rank) from seeds (kind, host, mass) over edges (kind, u, v, n).

    The mass of a kind stays the sum of its seeds. A host without outgoing edges passes
    its rank to itself.
    """
    total = edges.groupBy("kind", "u").agg(F.sum("n").alias("total"))
    moves = edges.join(total, ["kind", "u"]).select("kind", "u", "v", (F.col("n") / F.col("total")).alias("part"))
    ends = seeds.select("kind", F.col("host").alias("u")).union(edges.select("kind", F.col("v").alias("u"))).distinct()
    loops = ends.join(total, ["kind", "u"], "left_anti").select("kind", "u", F.col("u").alias("v"), F.lit(1.0).alias("part"))
    moves = stored(moves.union(loops), "host-moves")
    restart = stored(seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("rank")), "host-seeds")
    ranks = seeds.select("kind", "host", F.col("mass").cast("double").alias("rank"))
    for first in range(0, rounds, ROUNDS_PER_PLAN):
        for _ in range(min(ROUNDS_PER_PLAN, rounds - first)):
            at = ranks.select("kind", F.col("host").alias("u"), "rank")
            moved = moves.join(at, ["kind", "u"]).select(
                "kind", F.col("v").alias("host"), (F.col("rank") * F.col("part") * damping).alias("rank")
            )
            ranks = moved.union(restart).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        ranks = stored(ranks, "host-ranks")
    return ranks


def judge_urls(
    pages: DataFrame,
    rules: dict[str, str],
    ratio: float = 1.0,
    url: str = "url",
    html: str = "html",
    id_column: str = "page_id",
    damping: float = DAMPING,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Per page: id, ``host``, ``path``, ``rule`` and ``verdict``, with its host's ``trust`` and ``distrust``."""
    judged = judged_by_rules(pages, rules, url, id_column)
    counted = judged.filter("verdict is not null").groupBy(F.col("verdict").alias("kind"), "host").agg(F.count("*").alias("mass"))
    edges = stored(host_edges(pages, url, html), "host-edges")
    both = edges.select(F.lit(ALLOW).alias("kind"), "u", "v", "n").union(
        edges.select(F.lit(BLOCK).alias("kind"), F.col("v").alias("u"), F.col("u").alias("v"), "n")
    )
    ranks = spread(stored(counted, "host-counts"), both, damping, rounds)
    kinds = (F.round(F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)), 6) for kind in (ALLOW, BLOCK))
    hosts = ranks.groupBy("host").agg(*(x.alias(name) for x, name in zip(kinds, ("trust", "distrust"))))
    joined = judged.join(hosts, "host", "left").fillna(0.0, ["trust", "distrust"])
    own = F.when(F.col("distrust") > ratio * F.col("trust"), BLOCK).otherwise(ALLOW)
    return joined.select(id_column, "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "trust", "distrust")

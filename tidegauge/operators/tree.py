"""Reply trees: closure from roots, stand-ins for missing records, thread lookup.

Items are rows with ``id`` and ``kids`` (array of child ids). Each round's result
is a table in the shared work folder, so lineage stays one round long and lost
executors cost a retry of tasks, not of rounds. Round inputs are joined on keys
that may be hot (a comment with millions of replies); these are plain inner and
left joins whose skewed partitions AQE splits.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.dates import parse_month_title
from tidegauge.operators.staging import latest_by
from tidegauge.session import Scratch, work_path

# Content of a tombstone record, in field order.
TOMBSTONE = [
    ("id", "bigint", "ID"),
    ("type", "string", None),
    ("by", "string", None),
    ("time", "timestamp", None),
    ("text", "string", None),
    ("title", "string", None),
    ("url", "string", None),
    ("kids", "array<bigint>", []),
    ("parent", "bigint", None),
    ("score", "bigint", None),
    ("descendants", "bigint", None),
    ("deleted", "boolean", True),
    ("dead", "boolean", False),
    ("is_tombstone", "boolean", True),
]


def tree_edges(items: DataFrame) -> DataFrame:
    """Distinct (parent, child) pairs of the kid lists; an item is not its own kid."""
    pairs = items.select(F.col("id").alias("parent"), F.explode("kids").alias("child"))
    return pairs.filter(F.col("parent") != F.col("child")).distinct()


def missing_children(edges: DataFrame, items: DataFrame, child: str = "child",
                     item_id: str = "id") -> DataFrame:
    """Distinct referenced ids (as ``id``) without an item of their own."""
    referenced = edges.select(F.col(child).alias("id")).filter(F.col("id").isNotNull()).distinct()
    known = items.select(F.col(item_id).alias("id")).distinct()
    return referenced.join(known, "id", "left_anti")


def as_tombstones(ids: DataFrame) -> DataFrame:
    """Full stand-in records for a column of ids."""
    columns = []
    for name, kind, value in TOMBSTONE:
        if name == "id":
            columns.append(F.col("id").cast(kind).alias(name))
        elif isinstance(value, list):
            columns.append(F.array().cast(kind).alias(name))
        else:
            columns.append(F.lit(value).cast(kind).alias(name))
    return ids.select(*columns)


def tombstones(edges: DataFrame, items: DataFrame, child: str = "child",
               item_id: str = "id") -> DataFrame:
    """Stand-in records for referenced-but-missing ids."""
    return as_tombstones(missing_children(edges, items, child, item_id))


def descendants(items: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All ids reachable from each root: ``root, id, depth`` (the root has depth 0).

    Each id appears once per root, at its smallest depth; cycles are safe; ids
    without an item of their own are included. The result is a table in the work
    folder; what the rounds wrote is emptied before this returns.

    Roots and ids with several parents are tops. Cut above each top, the edges are
    trees, and pointer doubling finds every id's top and its depth below it in
    log2(depth) rounds, whatever else repeats. Distances from the roots are then
    followed from top to top, one round per repeated id on the way, over tops only;
    a repeat that no root reaches adds no round. Pointers that lead to an id with
    neither a parent nor a mark are dropped as soon as they get there.
    """
    spark = items.sparkSession
    result = work_path(spark, "closure")
    with Scratch(spark, "closure-rounds") as work:
        closure = _closure(items, roots, work, max_depth)
        if max_depth is not None:
            closure = closure.filter(F.col("depth") <= max_depth)
        closure.write.parquet(result)
    return spark.read.schema("root bigint, id bigint, depth bigint").parquet(result)


def _closure(items: DataFrame, roots: DataFrame, work: Scratch, max_depth: int | None) -> DataFrame:
    starts, _ = work.write(
        roots.select(F.col(roots.columns[0]).cast("bigint").alias("root")).filter("root is not null").distinct(), "roots"
    )
    pairs = items.select(
        F.col("id").cast("bigint").alias("parent"), F.explode(F.col("kids").cast("array<bigint>")).alias("child")
    )
    edges, n_edges = work.write(pairs.filter("parent <> child").distinct(), "edges")
    several = edges.groupBy("child").count().filter("count > 1").select(F.col("child").alias("top"))
    tops, _ = work.write(several.union(starts.select("root")).distinct(), "tops")
    marked = tops.withColumn("is_top", F.lit(True))
    ends = edges.join(marked.select(F.col("top").alias("child"), F.col("is_top").alias("to_top")), "child", "left").join(
        marked.select(F.col("top").alias("parent"), F.col("is_top").alias("from_top")), "parent", "left"
    )
    ends, _ = work.write(ends, "ends")
    # On a cycle without a top pointers never end; no path is longer than the edges are many.
    limit = n_edges if max_depth is None else max_depth
    below = _depths_below_tops(ends.filter("to_top is null"), work, limit)
    hops, _ = work.write(_hops(ends.filter("to_top"), below), "hops")
    reached = _reached_tops(starts, hops, work, max_depth)
    inside = reached.withColumnRenamed("id", "top").join(below.withColumnRenamed("depth", "more"), "top")
    return reached.union(inside.select("root", "id", (F.col("depth") + F.col("more")).alias("depth")))


def _depths_below_tops(ends: DataFrame, work: Scratch, limit: int) -> DataFrame:
    """``top, id, depth`` by pointer doubling: each round replaces an ancestor by its own.

    ``ptr`` is an ancestor ``depth`` levels up; once it is a top, ``top`` is set and the
    row is final. A chain of a million replies takes twenty rounds.
    """
    is_open = F.col("top").isNull()
    rows = ends.select(
        F.col("child").alias("id"),
        F.when(F.col("from_top").isNull(), F.col("parent")).alias("ptr"),
        F.when(F.col("from_top"), F.col("parent")).alias("top"),
        F.lit(1).cast("bigint").alias("depth"),
    ).filter(F.col("depth") <= limit)
    number = 0
    table, n_open = work.write(rows, "pointers", is_open, number)
    while n_open:
        latest = is_open & (F.col("round") == number)
        upper = table.filter(~is_open | latest).select(
            F.col("id").alias("ptr"), F.col("ptr").alias("next_ptr"), F.col("top").alias("next_top"), F.col("depth").alias("more")
        )
        # Inner join: a pointer to an id without parent that is no top leads nowhere.
        doubled = table.filter(latest).select("id", "ptr", "depth").join(upper, "ptr").select(
            "id", F.col("next_ptr").alias("ptr"), F.col("next_top").alias("top"), (F.col("depth") + F.col("more")).alias("depth")
        )
        number += 1
        table, n_open = work.write(doubled.filter(F.col("depth") <= limit), "pointers", is_open, number)
    return table.filter(~is_open).select("top", "id", "depth")


def _hops(into_tops: DataFrame, below: DataFrame) -> DataFrame:
    """Shortest ways from a top to the tops that come next: ``top, next, steps``."""
    direct = into_tops.filter("from_top").select(F.col("parent").alias("top"), F.col("child").alias("next"), F.lit(1).cast("bigint").alias("steps"))
    through = (
        into_tops.filter("from_top is null")
        .join(below.withColumnRenamed("id", "parent"), "parent")
        .select("top", F.col("child").alias("next"), (F.col("depth") + 1).alias("steps"))
    )
    return direct.union(through).groupBy("top", "next").agg(F.min("steps").alias("steps"))


def _reached_tops(starts: DataFrame, hops: DataFrame, work: Scratch, max_depth: int | None) -> DataFrame:
    """Tops that each root reaches, ``root, id, depth``: rounds go on while a way is shorter."""
    number = 0
    rows = starts.select("root", F.col("root").alias("id"), F.lit(0).cast("bigint").alias("depth"))
    table, n_new = work.write(rows, "reached", None, number)
    while n_new:
        found = (
            table.filter(F.col("round") == number)
            .join(hops.withColumnRenamed("top", "id"), "id")
            .groupBy("root", F.col("next").alias("id"))
            .agg(F.min(F.col("depth") + F.col("steps")).alias("depth"))
        )
        if max_depth is not None:
            found = found.filter(F.col("depth") <= max_depth)
        best = table.groupBy("root", "id").agg(F.min("depth").alias("best"))
        shorter = found.join(best, ["root", "id"], "left").filter("best is null or depth < best")
        number += 1
        table, n_new = work.write(shorter.select("root", "id", "depth"), "reached", None, number)
    return table.groupBy("root", "id").agg(F.min("depth").alias("depth"))


def mark_missing(closure: DataFrame, items: DataFrame) -> DataFrame:
    """Add ``is_tombstone``: the id was referenced but has no item."""
    known = items.select(F.col("id").cast("bigint").alias("id")).distinct()
    return closure.join(known.withColumn("known", F.lit(True)), "id", "left").select(
        "root", "id", "depth", F.col("known").isNull().alias("is_tombstone")
    )


def collect_threads(
    items: DataFrame, roots: DataFrame, newest_first: list[str | Column] | None = None
) -> DataFrame:
    """Records of whole threads, ready to land: items reached from the roots plus
    tombstones for missing ones, each id once, with ``is_tombstone``.

    Of several versions of an item the first by ``newest_first`` lands, else the
    greatest by all of its fields. The tree follows the kids of all versions.
    """
    reached = descendants(items, roots).select("id").distinct()
    names = [name for name, _, _ in TOMBSTONE if name != "is_tombstone"]
    found = items.join(reached, "id", "left_semi")
    order = [*(newest_first or []), *(name for name in names if name != "id")]
    found = latest_by(found, ["id"], order).select(*names, F.lit(False).alias("is_tombstone"))
    missing = reached.join(items.select("id").distinct(), "id", "left_anti")
    return found.unionByName(as_tombstones(missing))


def first_match(
    listing: DataFrame, owner: list[str | Column], item: str, position: list[str]
) -> DataFrame:
    """Per owner, the item with the smallest position; a partial aggregate, no list is built."""
    return listing.groupBy(*owner).agg(F.min_by(item, F.struct(*position)).alias(item))


def find_threads(
    users: DataFrame, items: DataFrame, months: list[dt.date] | None = None
) -> DataFrame:
    """Thread of each month: ``user, year, month, thread_id``.

    Walks each user's ``submitted`` list in order and takes the first story whose
    title names the month. All months (or the given ones) are solved in one job.
    """
    titled = (
        items.filter((F.col("type") == "story") & F.col("title").isNotNull())
        .select(F.col("id").alias("thread_id"), parse_month_title("title").alias("named"))
        .filter(F.col("named").isNotNull())
        .select("thread_id", "named.year", "named.month")
    )
    if months is not None:
        wanted = [m.year * 12 + m.month for m in months]
        titled = titled.filter((F.col("year") * 12 + F.col("month")).isin(wanted))
    # One row per (user, item): an item listed over and over is not a hot key.
    listed = (
        users.select(F.col("id").alias("user"), F.posexplode("submitted").alias("pos", "thread_id"))
        .groupBy("user", "thread_id")
        .agg(F.min("pos").alias("pos"))
    )
    return first_match(
        listed.join(titled, "thread_id"),
        ["user", "year", "month"],
        "thread_id",
        ["pos", "thread_id"],
    )

"""Exact top-k inner products by a dual-tree search on cover trees.

Vectors are scaled to integers. Candidates lie in blocks of bounded size around pivots, each
block a cover tree; the queries lie in blocks and trees of their own. The search walks a
query tree and a candidate tree together, best bound first: for nodes with points q, c and
covering radii r, s no pair below scores over ``q.c + r|c| + s|q| + rs``, and a pair of nodes
is given up once this lies below the worst k-th score of the query group. Two small nodes are
multiplied out.

The first round meets every query block with one candidate block of its own pivot, which
gives each query a k-th score; the second meets it with all other blocks whose bound
reaches the block's worst one. Blocks that meet are brought together by key; a candidate
block goes over the network once for each group of query blocks.

Equal vectors are one point of a tree, with its ``k + 1`` least ids: more of them can never be
among the k best of any query. This is exact.

Defined results: vectors that are null, empty, or hold a null or a non-finite number, and rows
without id, take no part; missing last components count as zero; repeated rows count once;
of different vectors under one id the least takes part; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import stored

SCALE = 1024
PIVOTS = 8
# Vectors from which the pivots are chosen.
SAMPLE = 2048
CANDIDATES_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 512
# Query blocks that meet a candidate block in one task.
BLOCKS_PER_GROUP = 32
# Points of a node that is not split further; how much a child's radius is smaller at least.
LEAF = 64
SHRINK = 1.3
EXACT = 2.0**52


def scaled(vectors: DataFrame, vector: str, id_column: str, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, vector) of all vectors that take part, as arrays of longs of one length."""
    value = F.col(vector)
    sound = F.forall(value, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    rows = vectors.filter(F.col(id_column).isNotNull() & value.isNotNull() & (F.size(value) > 0) & sound)
    whole = F.transform(value, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    found = rows.select(F.col(id_column).cast("long").alias("vec_id"), whole.alias("vector"))
    found = stored(found.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    size = found.agg(F.max(F.size("vector"))).first()[0] or 0
    return found.select(
        "vec_id", F.concat("vector", F.array_repeat(F.lit(0).cast("long"), size - F.size("vector"))).alias("vector")
    )


class Tree:
    """A cover tree built from the top: points in an order that keeps every node together.

    A node is split by choosing far points until all lie within a smaller radius of a
    chosen one. A node that would need very many of these stays a leaf.
    """

    def __init__(self, points: np.ndarray) -> None:
        self.order = np.arange(len(points))
        self.points = points.astype(np.float64)
        self.lows, self.highs, self.centres, self.radii, self.children = [], [], [], [], []
        open_ = [self._node(0, len(points), 0)] if len(points) else []
        while open_:
            node = open_.pop()
            for low, high, centre in self._split(node):
                child = self._node(low, high, centre)
                self.children[node].append(child)
                open_.append(child)
        self.norms = [float(np.linalg.norm(c)) for c in self.centres]

    def _node(self, low: int, high: int, centre: int) -> int:
        """A node over points low..high around one of them."""
        self.lows.append(low)
        self.highs.append(high)
        self.centres.append(self.points[centre].copy())
        self.radii.append(float(np.sqrt(((self.points[low:high] - self.points[centre]) ** 2).sum(axis=1).max())))
        self.children.append([])
        return len(self.lows) - 1

    def _split(self, node: int) -> list[tuple[int, int, int]]:
        low, high = self.lows[node], self.highs[node]
        count, bound = high - low, self.radii[node] / SHRINK
        if count <= LEAF or bound == 0:
            return []
        points = self.points[low:high]
        near = ((points - self.centres[node]) ** 2).sum(axis=1)
        chosen, owner = [int(near.argmin())], np.zeros(count, np.int64)
        while near.max() > bound * bound:
            if len(chosen) > count // LEAF + 8:
                return []
            far = int(near.argmax())
            distance = ((points - points[far]) ** 2).sum(axis=1)
            owner[distance < near] = len(chosen)
            near = np.minimum(near, distance)
            chosen.append(far)
        order = np.argsort(owner, kind="stable")
        self.points[low:high] = points[order]
        self.order[low:high] = self.order[low:high][order]
        ends = np.cumsum(np.bincount(owner, minlength=len(chosen)))
        place = np.empty(count, np.int64)
        place[order] = np.arange(count)
        return [(low + int(end - size), low + int(end), low + int(place[c])) for c, end, size in zip(chosen, ends, np.diff(np.r_[0, ends])) if size]


class Best:
    """The k best (score, id) of each query, and what is known to be the k-th score at least."""

    def __init__(self, k: int, known: np.ndarray) -> None:
        self.k, self.worst = k, known.copy()
        self.found: list[list[tuple[int, int]]] = [[] for _ in known]

    def add(self, query: int, scores: np.ndarray, ids: list[list[int]]) -> None:
        own = self.found[query]
        own += [(-int(score), i) for score, some in zip(scores, ids) for i in some]
        own.sort()
        del own[self.k :]
        if len(own) == self.k:
            self.worst[query] = max(self.worst[query], -own[-1][0])


def dual_search(queries: Tree, candidates: Tree, ids: list[list[int]], k: int, known: np.ndarray) -> Best:
    """The best candidates of each query (in the tree's order) that reach its known score."""
    best = Best(k, known)
    if not len(queries.points) or not len(candidates.points):
        return best
    largest = np.abs(queries.points).max() * np.abs(candidates.points).max() * queries.points.shape[1]
    exact = largest < EXACT

    def bound(q: int, c: int) -> float:
        r, s = queries.radii[q], candidates.radii[c]
        top = float(queries.centres[q] @ candidates.centres[c]) + r * candidates.norms[c] + s * queries.norms[q] + r * s
        return top + 1e-9 * abs(top) + 1e-6

    open_ = [(-bound(0, 0), 0, 0)]
    while open_:
        top, q, c = heapq.heappop(open_)
        low, high = queries.lows[q], queries.highs[q]
        if -top < best.worst[low:high].min():
            continue
        wide = candidates.children[c] and (candidates.radii[c] >= queries.radii[q] or not queries.children[q])
        if wide:
            for child in candidates.children[c]:
                heapq.heappush(open_, (-bound(q, child), q, child))
        elif queries.children[q]:
            for child in queries.children[q]:
                heapq.heappush(open_, (-bound(child, c), child, c))
        else:
            first, last = candidates.lows[c], candidates.highs[c]
            left, right = queries.points[low:high], candidates.points[first:last]
            scores = left @ right.T if exact else left.astype(np.int64) @ right.astype(np.int64).T
            for i, row in enumerate(scores):
                good = np.flatnonzero(row >= best.worst[low + i])
                if len(good) > k:  # all that tie with the k-th stay
                    good = good[row[good] >= np.partition(row[good], len(good) - k)[len(good) - k]]
                if len(good):
                    best.add(low + i, row[good], [ids[candidates.order[first + j]] for j in good])
    return best


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Points of the sample, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _blocks(points: DataFrame, pivots: np.ndarray, size: int, name: str) -> DataFrame:
    """Trees of points (vector, ids): one row for each block of about ``size`` of them."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(0)).astype(np.float64)
            distance = (pivots**2).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
            pivot = pa.array(distance.argmin(axis=1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pivot], names=["vector", "ids", "pivot"])

    placed = stored(points.select("vector", "ids").mapInArrow(assign, "vector array<long>, ids array<long>, pivot int"), name)
    # One count for each pivot.
    counts = {row[0]: row[1] for row in placed.groupBy("pivot").count().collect()}
    parts = F.create_map(*(F.lit(x) for pivot, n in counts.items() for x in (pivot, -(-n // size)))) if counts else F.lit(None)
    block = F.pmod(F.xxhash64("vector"), parts[F.col("pivot")]).cast("int") if counts else F.lit(0)

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        vectors = _matrix(group.column("vector").combine_chunks())
        pivot = group.column("pivot")[0].as_py()
        tree = Tree(vectors)
        radius = float(np.sqrt(((vectors - pivots[pivot]) ** 2).sum(axis=1).max()))
        return pa.table(
            {
                "pivot": pa.array([pivot], pa.int32()),
                "block": pa.array([group.column("block")[0].as_py()], pa.int32()),
                "radius": pa.array([radius]),
                "tree": pa.array([pickle.dumps((tree, group.column("ids").to_pylist()))], pa.binary()),
            }
        )

    grouped = placed.withColumn("block", block).groupBy("pivot", "block")
    return stored(grouped.applyInArrow(build, "pivot int, block int, radius double, tree binary"), name)


def _search(pairs: DataFrame, queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Rows (rep, score, vec_id): the best of each query in each block it meets.

    ``pairs`` has query pivot and block, candidate pivot and block; ``queries`` also the known
    k-th scores by representative.
    """
    group = F.floor(F.col("query_block") / BLOCKS_PER_GROUP).cast("int").alias("part")
    met = pairs.select("query_pivot", "query_block", "pivot", "block", group)
    left = met.join(
        queries.select(F.col("pivot").alias("query_pivot"), F.col("block").alias("query_block"), "tree", "known"),
        ["query_pivot", "query_block"],
    ).select("pivot", "block", "query_pivot", "part", "tree", "known")
    keys = ["pivot", "block", "query_pivot", "part"]
    right = met.select(*keys).distinct().join(candidates.select("pivot", "block", "tree"), ["pivot", "block"])
    # Names of its own, as both sides come from the same rows.
    right = right.select(*(F.col(key).alias(f"at_{key}") for key in keys), F.col("tree").alias("points"))

    def run(own: pa.Table, other: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        for blob in other.column("points").to_pylist():
            candidate, ids = pickle.loads(blob)
            for row, known in zip(own.column("tree").to_pylist(), own.column("known").to_pylist()):
                query, reps = pickle.loads(row)
                known = dict(known or [])
                rep = [reps[i][0] for i in query.order]
                least = np.array([known.get(r, -np.inf) for r in rep], np.float64)
                best = dual_search(query, candidate, ids, k, least)
                out += [(r, -score, i) for r, found in zip(rep, best.found) for score, i in found]
        columns = list(zip(*out)) if out else [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("rep", "score", "vec_id"), columns)})

    return left.groupBy(*keys).cogroup(right.groupBy(*(f"at_{key}" for key in keys))).applyInArrow(run, "rep long, score long, vec_id long")


def top_inner_products(
    vectors: DataFrame, k: int = 10, every: int = 100, vector: str = "embedding", id_column: str = "vec_id", scale: int = SCALE
) -> DataFrame:
    """For rows whose id is divisible by ``every``: ``query_id``, ``rank``, ``vec_id`` and ``score`` of the k best."""
    spark = vectors.sparkSession
    rows = scaled(vectors, vector, id_column, scale)
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    points = stored(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "points")
    sample = points.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = choose_pivots(np.array([row[0] for row in sample], np.float64))
    asked = rows.filter(F.col("vec_id") % every == 0)
    named = asked.groupBy("vector").agg(F.min("vec_id").alias("rep"))
    candidates = _blocks(points, pivots, CANDIDATES_PER_BLOCK, "candidate-trees")
    queries = _blocks(named.select("vector", F.array("rep").alias("ids")), pivots, QUERIES_PER_BLOCK, "query-trees")

    # Round one: one block of the query's own pivot.
    nothing = queries.withColumn("known", F.lit(None).cast("array<struct<rep:bigint,least:bigint>>"))
    own = queries.select(F.col("pivot").alias("query_pivot"), F.col("block").alias("query_block"), "pivot", F.lit(0).alias("block"))
    first = stored(_search(own.join(candidates.select("pivot", "block"), ["pivot", "block"], "left_semi"), nothing, candidates, k + 1), "first-round")
    place = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    least = first.withColumn("n", F.row_number().over(place)).filter(F.col("n") == k + 1)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                reps = [x[0] for x in pickle.loads(batch.column(2)[i].as_py())[1]]
                here = [pa.array([batch.column(c)[i].as_py()] * len(reps), pa.int32()) for c in range(2)]
                yield pa.RecordBatch.from_arrays([*here, pa.array(reps, pa.int64())], names=["pivot", "block", "rep"])

    inside = queries.select("pivot", "block", "tree").mapInArrow(members, "pivot int, block int, rep long")
    known = inside.join(least.select("rep", F.col("score").alias("least")), "rep", "left").groupBy("pivot", "block")
    known = known.agg(
        F.collect_list(F.when(F.col("least").isNotNull(), F.struct("rep", "least"))).alias("known"),
        # Without a k-th score for all of its queries a block gives up nothing.
        F.when(F.count("least") == F.count("*"), F.min("least")).alias("worst"),
    )
    asking = stored(queries.join(known, ["pivot", "block"]), "known-trees")

    # Round two: every other block that the bound of the two blocks does not rule out.
    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = np.linalg.norm(pivots, axis=1)
        for batch in batches:
            pivot, block, radius, worst = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for p, b, r, w in zip(pivot, block, radius, worst):
                # With a candidate block of radius s: base + s * slope is the most that any pair scores.
                base, slope = pivots @ pivots[p] + r * norm, np.full(len(pivots), norm[p] + r)
                columns = (np.full(len(pivots), p, np.int32), np.full(len(pivots), b, np.int32), np.arange(len(pivots), dtype=np.int32), base, slope, np.full(len(pivots), w, np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_pivot", "query_block", "pivot", "base", "slope", "worst"])

    schema = "query_pivot int, query_block int, pivot int, base double, slope double, worst double"
    worst = F.coalesce(F.col("worst").cast("double"), F.lit(float("-inf")))
    open_ = asking.select("pivot", "block", "radius", worst.alias("worst")).mapInArrow(bounds, schema)
    pairs = open_.join(candidates.select("pivot", "block", "radius"), "pivot").filter(
        (F.col("base") + F.col("radius") * F.col("slope") + 1 >= F.col("worst"))
        & ~((F.col("pivot") == F.col("query_pivot")) & (F.col("block") == 0))
    )
    second = _search(pairs, asking, candidates, k + 1)

    every_best = first.union(second).withColumn("n", F.row_number().over(place)).filter(F.col("n") <= k + 1)
    members_of = asked.join(named, "vector").select(F.col("vec_id").alias("query_id"), "rep")
    answers = members_of.join(every_best.select("rep", "vec_id", "score"), "rep").filter("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

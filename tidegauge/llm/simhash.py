"""SimHash fingerprints and their self-join by a traversal of the binary trie.

The distinct fingerprints form a binary trie. Pairs of trie nodes are walked down
together; a pair is given up as soon as its prefixes differ in more bits than allowed.
The top of the trie, a bounded number of nodes cut where few fingerprints are left
below, is walked once to find the pairs of subtrees that can hold links; each such pair
is a group of rows that one task walks to the end. A task returns a spanning forest of
the links it finds, not the links themselves.

Defined results: null and empty texts, and texts of white space, have fingerprint zero
and are linked like any other; a component is named by its least non-null doc_id
(null if it has none); repeated rows share a fingerprint; other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import stored
from tidegauge.llm.components import stars

BITS = 64
# Fingerprints below a cut of the trie, and nodes of the top part.
SUBTREE = 4096
MAX_TOP_BITS = 14
# Shingles hashed at a time, node pairs walked at a time, and the product of two
# nodes' sizes from which their fingerprints are compared one by one.
HASHED = 50_000
WALKED = 500_000
SMALL = 32


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles: bits set in over half of the hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    total = max(1, len(words) - size + 1)
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for first in range(0, total, HASHED):
        part = words[first : min(first + HASHED, total) + size - 1]
        grams = zip(*(part[i:] for i in range(size))) if len(part) >= size else [part]
        hashes = np.array([digest(b" ".join(gram), seed) for gram in grams], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def with_fingerprint(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = 3) -> DataFrame:
    """The kept columns and ``bits``, the fingerprint as a signed long."""
    names = [*keep]
    schema = T.StructType([documents.schema[name] for name in names]).add("bits", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py(), size) for x in batch.column(len(names))]
            signed = pa.array(np.array(values, np.uint64).view(np.int64))
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, signed], names=schema.names)

    return documents.select(*names, F.col(text).cast("string").alias("text_")).mapInArrow(run, schema)


def as_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def cut_trie(counts: dict[int, int], depth: int, most: int) -> list[tuple[int, int]]:
    """Nodes (length, prefix) that hold at most ``most`` fingerprints or lie at ``depth``."""
    sums = np.zeros(1 << depth, np.int64)
    for prefix, count in counts.items():
        sums[prefix] = count
    sums = np.concatenate([[0], np.cumsum(sums)])
    nodes, open_ = [], [(0, 0)]
    while open_:
        length, prefix = open_.pop()
        low, high = prefix << (depth - length), (prefix + 1) << (depth - length)
        inside = sums[high] - sums[low]
        if inside and (inside <= most or length == depth):
            nodes.append((length, prefix))
        elif inside:
            open_ += [(length + 1, 2 * prefix), (length + 1, 2 * prefix + 1)]
    return sorted(nodes)


def node_pairs(nodes: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    """Index pairs (i <= j) of nodes whose common length differs in at most ``budget`` bits."""
    index = {node: i for i, node in enumerate(nodes)}
    inner = {(k, prefix >> (length - k)) for length, prefix in nodes for k in range(length)}
    below = lambda node: [node] if node in index else [(node[0] + 1, 2 * node[1] + bit) for bit in (0, 1)]
    known = lambda node: node in index or node in inner
    found: set[tuple[int, int]] = set()
    seen, open_ = set(), [((0, 0), (0, 0))]
    while open_:
        a, b = open_.pop()
        if a in index and b in index:
            found.add((min(index[a], index[b]), max(index[a], index[b])))
            continue
        for x in below(a):
            for y in below(b):
                pair = (min(x, y), max(x, y))
                common = min(x[0], y[0])
                differ = (x[1] >> (x[0] - common)) ^ (y[1] >> (y[0] - common))
                if pair not in seen and known(x) and known(y) and differ.bit_count() <= budget:
                    seen.add(pair)
                    open_.append(pair)
    return sorted(found)


def trie_links(left: np.ndarray, right: np.ndarray, same: bool, budget: int) -> Iterator[np.ndarray]:
    """Index pairs of two sorted arrays of distinct numbers that differ in few bits.

    A node is a range of a sorted array. All open node pairs of a depth are split at
    once; two small nodes are compared number by number.
    """
    start = np.array([[0], [len(left)], [0], [len(right)], [budget]])
    open_ = [(BITS - 1, start)] if len(left) and len(right) else []
    while open_:
        bit, nodes = open_.pop()
        if nodes.shape[1] > WALKED:
            half = nodes.shape[1] // 2
            open_ += [(bit, nodes[:, :half]), (bit, nodes[:, half:])]
            continue
        small = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2]) <= SMALL
        if small.any():
            yield _compare(left, right, nodes[:, small], same, budget)
            nodes = nodes[:, ~small]
        if not nodes.shape[1]:
            continue
        la, lb, ra, rb, rest = nodes
        lm, rm = _middle(left, la, lb, bit), _middle(right, ra, rb, bit)
        own = (la == ra) & (lb == rb) if same else np.zeros(len(la), bool)
        children = [(la, lm, ra, rm, rest), (lm, lb, rm, rb, rest), (la, lm, rm, rb, rest - 1)]
        children = [np.array(x) for x in children]
        children.append(np.array((lm, lb, ra, rm, rest - 1))[:, ~own])
        nodes = np.concatenate(children, axis=1)
        kept = (nodes[0] < nodes[1]) & (nodes[2] < nodes[3]) & (nodes[4] >= 0)
        if kept.any():
            open_.append((bit - 1, nodes[:, kept]))


def _middle(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    one = np.uint64(1 << bit)
    upper = values[low] & ~np.uint64((1 << (bit + 1)) - 1)
    return np.clip(np.searchsorted(values, upper | one), low, high)


def _compare(left: np.ndarray, right: np.ndarray, nodes: np.ndarray, same: bool, budget: int) -> np.ndarray:
    wide = nodes[3] - nodes[2]
    sizes = (nodes[1] - nodes[0]) * wide
    pair = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    i, j = nodes[0][pair] + within // wide[pair], nodes[2][pair] + within % wide[pair]
    close = np.bitwise_count(left[i] ^ right[j]) <= budget
    if same:
        close &= i < j
    return np.stack([i[close], j[close]])


class Forest:
    """Union-find over indices; ``join`` says whether two were apart."""

    def __init__(self, size: int) -> None:
        self.up = list(range(size))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def group_links(fingerprints: np.ndarray, sides: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one pair of subtrees."""
    left, right = np.sort(fingerprints[sides == 0]), np.sort(fingerprints[sides == 1])
    same = not len(right)
    if same:
        right = left
    forest, ends = Forest(len(left) + (0 if same else len(right))), []
    shift = 0 if same else len(left)
    for pairs in trie_links(left, right, same, budget):
        new = [forest.join(i, j + shift) for i, j in pairs.T.tolist()]
        ends.append(pairs[:, np.array(new, bool)])
    i, j = np.concatenate([np.zeros((2, 0), np.int64), *ends], axis=1)
    return left[i], right[j]


def links(bits: DataFrame, budget: int = 2, column: str = "bits") -> DataFrame:
    """Links (u, v) between the distinct fingerprints of a table, as spanning forests."""
    spark = bits.sparkSession
    distinct = stored(bits.select(F.col(column).alias("bits")).distinct(), "fingerprints")
    count = distinct.count()
    depth = min(MAX_TOP_BITS, max(0, math.ceil(math.log2(max(1, count / SUBTREE)))) + 4)
    top = F.shiftrightunsigned("bits", BITS - depth).cast("int")
    # At most 2**depth rows: the numbers of fingerprints below the nodes of that depth.
    counts = {row[0]: row[1] for row in distinct.groupBy(top.alias("top")).count().collect()}
    nodes = cut_trie(counts, depth, SUBTREE)
    pairs = node_pairs(nodes, budget)
    rows = [(i, k, side) for k, pair in enumerate(pairs) for side, i in enumerate(dict.fromkeys(pair))]
    sides = spark.createDataFrame(rows, "node int, pair int, side int") if rows else spark.createDataFrame([], "node int, pair int, side int")
    node_of = np.zeros(1 << depth, np.int32)
    for i, (length, prefix) in enumerate(nodes):
        node_of[prefix << (depth - length) : (prefix + 1) << (depth - length)] = i

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            node = node_of[(values >> np.uint64(BITS - depth)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node)], names=["bits", "node"])

    def walk(group: pa.Table) -> pa.Table:
        values = group.column("bits").to_numpy().view(np.uint64)
        u, v = group_links(values, group.column("side").to_numpy(), budget)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    placed = distinct.mapInArrow(place, "bits long, node int")
    return placed.join(sides, "node").select("pair", "side", "bits").groupBy("pair").applyInArrow(walk, "u long, v long")


def rooted(fingerprints: DataFrame, budget: int = 2, id_column: str = "doc_id") -> DataFrame:
    """Every distinct ``bits`` with its least id and ``root``, the least bits of its component."""
    star = stars(links(fingerprints, budget), "simhash")
    least = fingerprints.groupBy("bits").agg(F.min(id_column).alias("least_id"))
    found = least.join(star.select(F.col("u").alias("bits"), F.col("v").alias("root")), "bits", "left")
    return found.withColumn("root", F.coalesce("root", "bits"))


def components(fingerprints: DataFrame, budget: int = 2, id_column: str = "doc_id") -> DataFrame:
    """``component_id`` of every distinct ``bits``: the least id reachable over links."""
    found = rooted(fingerprints, budget, id_column)
    named = found.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return found.join(named, "root").select("bits", "component_id")


def near_duplicates(documents: DataFrame, text: str = "text", id_column: str = "doc_id", budget: int = 2, size: int = 3) -> DataFrame:
    """Per document: its id, ``fingerprint`` in hexadecimal and ``component_id``."""
    marked = stored(with_fingerprint(documents, text, (id_column,), size), "simhash-documents")
    named = stored(components(marked, budget, id_column), "simhash-components")
    return marked.join(named, "bits").select(id_column, as_hex(F.col("bits")).alias("fingerprint"), "component_id")


def keep_one_of_each(documents: DataFrame, text: str = "text", id_column: str = "doc_id", budget: int = 2, size: int = 3) -> DataFrame:
    """One document of each component, with all columns: the one with the least id.

    Ids that are null come last; of several texts under the least id the one with the least
    hash stays; rows equal in id and text are one document.
    """
    value = F.col(text).cast("string")
    row = [F.xxhash64(id_column, value).alias("row__"), F.crc32(F.coalesce(value, F.lit("")).cast("binary")).alias("crc__")]
    keyed = documents.select(F.col(id_column).alias("id__"), value.alias("text__"), *row)
    marked = stored(with_fingerprint(keyed, "text__", ("id__", "row__", "crc__"), size), "simhash-documents")
    named = rooted(marked, budget, "id__").select("bits", "root")
    first = F.min(F.struct(F.col("id__").isNull(), "id__", "row__", "crc__")).alias("first")
    # The least of each fingerprint, then of each component: one row for each task and key.
    least = marked.groupBy("bits").agg(first).join(named, "bits").groupBy("root").agg(F.min("first").alias("first"))
    kept = stored(least.select("first.row__", "first.crc__"), "simhash-kept").distinct()
    found = documents.select("*", *row).join(kept, ["row__", "crc__"], "left_semi")
    return found.dropDuplicates(["row__", "crc__"]).select(*documents.columns)

"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Every task permutes its rows, block by block of bounded size, and writes for each row
   its block and its place in the block's permutation.
2. How many rows of each block go to each shard is drawn as for cards dealt at random: a
   matrix with the blocks' sizes as row sums and the exact shard sizes as column sums. A
   block's first places go to shard 0, the next to shard 1, and so on.
3. The rows are exchanged, and within each shard permuted again: sorted by a random number
   over the whole cluster, and numbered by the sizes of the sorted parts.

Every permutation of all rows is equally likely to fill the slots. Random numbers follow
from the seed and what is already written, so a task that runs again deals the same.

Defined results: a null text has size 1 and no checksum; repeated rows are rows of their
own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import crc32_of, stored

SHARDS = 16
BLOCK_ROWS = 65_536
# From this many rows on the library's sampler of the hypergeometric law does not go.
LIBRARY_ROWS = 1_000_000_000


def hypergeometric(draw: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """How many good ones are among ``taken`` of ``good + bad``."""
    if good + bad < LIBRARY_ROWS:
        return int(draw.hypergeometric(good, bad, taken))
    # Weights of all likely outcomes from their exact ratios, outwards from the mean.
    total = good + bad
    low, high = max(0, taken - bad), min(taken, good)
    deviation = (taken * (good / total) * (bad / total)) ** 0.5
    mean = min(max(round(taken * (good / total)), low), high)
    low, high = max(low, int(mean - 12 * deviation - 20)), min(high, int(mean + 12 * deviation + 20))
    k = np.arange(low, high, dtype=np.float64)
    ratios = np.log((good - k) * (taken - k)) - np.log((k + 1) * (bad - taken + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(ratios)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(weights, draw.random() * weights[-1], "right"))


def matrix(blocks: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Rows of each block (given by size) that go to each shard; sums are exact."""
    draw, left = np.random.default_rng(seed), list(shards)
    out = np.zeros((len(blocks), len(shards)), np.int64)
    for i, size in enumerate(blocks):
        rest = sum(left)
        for j in range(len(shards)):
            rest -= left[j]
            out[i, j] = taken = hypergeometric(draw, left[j], rest, size) if size else 0
            left[j] -= taken
            size -= taken
    return out


def exact_sizes(rows: int, shards: int) -> list[int]:
    """Sizes that differ by one at most, the larger ones first."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def _permuted(rows: DataFrame, seed: int) -> DataFrame:
    """Rows with ``block`` and ``place``, a random permutation within the block."""
    schema = T.StructType([*rows.schema.fields]).add("block", "long").add("place", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number, held = 0, []

        def block() -> pa.RecordBatch:
            nonlocal number, held
            table = pa.Table.from_batches(held).combine_chunks()
            order = np.random.default_rng([seed, task, number]).permutation(len(table)).astype(np.int32)
            here = pa.array(np.full(len(table), task * 2**32 + number))
            number, held = number + 1, []
            return table.append_column("block", here).append_column("place", pa.array(order)).to_batches()[0]

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK_ROWS - sum(b.num_rows for b in held))
                batch = batch.slice(part.num_rows)
                held.append(part)
                if sum(b.num_rows for b in held) == BLOCK_ROWS:
                    yield block()
        if held:
            yield block()

    return rows.mapInArrow(run, schema)


def _numbered(rows: DataFrame, seed: int) -> DataFrame:
    """Rows with ``slot``, their place in a random order of their shard, without gaps."""
    key = F.xxhash64(F.lit(seed), "block", "place")
    sorted_ = rows.withColumn("key", key).repartitionByRange("shard", "key", "block", "place")
    sorted_ = sorted_.sortWithinPartitions("shard", "key", "block", "place")
    schema = T.StructType([*rows.schema.fields]).add("part", "integer").add("within", "long")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            shards = batch.column(names.index("shard")).to_numpy()
            within = np.empty(len(shards), np.int64)
            for shard in np.unique(shards).tolist():
                mine = shards == shard
                count = int(mine.sum())
                within[mine] = np.arange(count) + seen.get(shard, 0)
                seen[shard] = seen.get(shard, 0) + count
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(shards), part, np.int32)), pa.array(within)], names=schema.names)

    numbered = stored(sorted_.mapInArrow(run, schema), "shard-order")
    # One row for each sorted part and shard in it: a few more than there are parts.
    sizes = numbered.groupBy("shard", "part").count().collect()
    before, offsets = {}, []
    for shard, part, count in sorted(map(tuple, sizes)):
        offsets.append((shard, part, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + count
    starts = rows.sparkSession.createDataFrame(offsets, "shard int, part int, start long")
    joined = numbered.join(starts, ["shard", "part"])
    return joined.withColumn("slot", F.col("start") + F.col("within"))


def shuffle_into_shards(documents: DataFrame, shards: int = SHARDS, seed: int = 20240801, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Every row's id, ``size``, ``text_crc32``, ``shard`` and ``slot`` in it."""
    value = F.col(text).cast("string")
    rows = documents.select(
        F.col(id_column),
        (F.coalesce(F.octet_length(value), F.lit(0)) + 1).cast("long").alias("size"),
        crc32_of(value).alias("text_crc32"),
    )
    permuted = stored(_permuted(rows, seed), "shard-blocks")
    # One number for each block of up to BLOCK_ROWS rows.
    sizes = sorted(map(tuple, permuted.groupBy("block").count().collect()))
    if not sizes:
        return permuted.select(id_column, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    counts = matrix([n for _, n in sizes], exact_sizes(sum(n for _, n in sizes), shards), seed)
    bounds = [(block, row.tolist()) for (block, _), row in zip(sizes, np.cumsum(counts, axis=1))]
    dealt = permuted.join(documents.sparkSession.createDataFrame(bounds, "block long, bounds array<long>"), "block")
    shard = F.size(F.filter("bounds", lambda bound: bound <= F.col("place")))
    dealt = dealt.select(id_column, "size", "text_crc32", "block", "place", shard.alias("shard"))
    return _numbered(dealt, seed).select(id_column, "size", "text_crc32", "shard", "slot")

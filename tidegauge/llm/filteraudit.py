"""Filter interaction audit as a stream that retracts.

All files of a table go through one availableNow query, some files a micro-batch. Four
filters look at a text alone, so their failures are a mask of bits computed where the
text is read; the fifth fails a text that a smaller id has too, which later files may
still change. Every row is first counted, under its part and mask, as such a copy. State
keyed by the text's digest holds the smallest id seen and what hangs on it; the rows of
that id are moved to the mask without the copy's bit, and when a later file brings a
smaller id, the earlier rows are moved back. A batch hands on sums per part and mask
only; a repeated batch replaces its own. All orders of the filters follow from these
sums, at most 32 a part.

Digests are kept in buckets, one state value each, whose number grows with the table, so
a value stays small and arrays, not single rows, are worked on. Tasks combine their rows
before the shuffle: a text or a part with a third of all rows sends one row a task slice.

Defined results: a null text counts as empty, a null part as the empty string. A null id
is larger than any other and no smaller than another null. Rows that repeat the smallest
id with the same text are ties: none of them is a copy. Of labels listed twice any 1
counts; a null label is none. Texts are the same when their SHA-256 is. An empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import work_path

# The filters' letters; the last one is failed by copies.
LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
WORDS_BETWEEN = r"[\x20\x09-\x0D]+"

# Micro-batches per run, texts per state value, rows a task combines at a time.
BATCHES = 4
TEXTS_PER_BUCKET = 2_000
ROWS_PER_SLICE = 50_000

COUNTS = ["n", "good", "toxic"]
COUNTERS = "part string, mask int, moved boolean, n long, good long, toxic long"
COMBINED = f"bucket long, digest binary, id long, {COUNTERS}"
STATE = "holders binary"


def failures(text: Column) -> Column:
    """Bits of the filters that a text alone decides."""
    words = F.filter(F.split(text, WORDS_BETWEEN), lambda w: w != "")
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    failed = {
        "A": count < 200,
        "B": 100 * distinct < 50 * count,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }
    bits = [F.when(test, F.lit(1 << LETTERS.index(letter))).otherwise(F.lit(0)) for letter, test in failed.items()]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def _labelled(labels: DataFrame) -> DataFrame:
    """One row per labelled id: 1 where any row of it says so."""
    flags = [F.max(F.when(F.col(name) == 1, 1).otherwise(0)).cast("long").alias(to) for name, to in (("quality", "good"), ("toxic", "toxic"))]
    return labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(*flags)


def _rows(documents: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """What a row takes along instead of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), part.alias("part"), text.alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    rows = rows.select("id", "part", failures(F.col("text")).alias("mask"), digest.alias("digest"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    # Rows without an id find no label; they are dealt out by their text.
    keyed = rows.withColumn("spread", F.when(F.col("id").isNull(), F.col("bucket")).otherwise(F.lit(-1)))
    known = _labelled(labels).withColumn("spread", F.lit(-1).cast("long"))
    joined = keyed.join(known, ["id", "spread"], "left")
    zero = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("good", "toxic")]
    return joined.select("bucket", "digest", "id", "part", "mask", F.lit(1).cast("long").alias("n"), *zero)


def _least(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows that hold the smallest id of their digest; a missing id is the largest."""
    ordered = rows.sort_values("id", na_position="last", kind="stable")
    first = ordered.drop_duplicates("digest")[["digest", "id"]]
    # Missing ids merge with missing ids.
    return ordered.merge(first, on=["digest", "id"])


def _summed(rows: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    return rows.groupby(by, dropna=False, sort=False, as_index=False)[COUNTS].sum()


def _frame(table: pa.Table) -> pd.DataFrame:
    """Pandas without a detour of long numbers over floats."""
    return table.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice of a task: rows with the least id of each text, and sums per part and mask."""
    from pyspark import TaskContext

    schema = pa.schema(
        [("bucket", pa.int64()), ("digest", pa.binary()), ("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32())]
        + [("moved", pa.bool_()), *((name, pa.int64()) for name in COUNTS)]
    )
    task = TaskContext.get().partitionId()

    def out(slice_: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _frame(pa.Table.from_batches(slice_))
        least = _summed(_least(rows), ["bucket", "digest", "id", "part", "mask"]).assign(moved=True)
        sums = _summed(rows, ["part", "mask"]).assign(bucket=-1 - task, digest=None, id=None, moved=False)
        for frame in (least, sums):
            yield from pa.Table.from_pandas(frame, schema, preserve_index=False).to_batches(ROWS_PER_SLICE)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= ROWS_PER_SLICE:
            yield from out(held)
            held, size = [], 0
    if size:
        yield from out(held)


HOLDERS = pa.schema([("digest", pa.binary()), ("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), *((n, pa.int64()) for n in COUNTS)])


def _packed(holders: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HOLDERS) as writer:
        writer.write_table(pa.Table.from_pandas(holders, HOLDERS, preserve_index=False))
    return sink.getvalue().to_pybytes()


def held_ids(held: pd.DataFrame | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """New holders of the smallest ids, and the moves that lead to them.

    A move takes ``n`` rows from the copies to the mask without that bit; it is negative
    where rows that held an id so far have met a smaller one.
    """
    own = ["digest", "id", "part", "mask"]
    fresh = _summed(_least(rows), own).assign(seen=False)
    both = fresh if held is None else pd.concat([held.assign(seen=True), fresh], ignore_index=True)
    stay = _least(both)
    gained = stay[~stay["seen"].astype(bool)]
    moves = [gained]
    if held is not None:
        gone = held.merge(stay[["digest", "id"]].drop_duplicates(), on=["digest", "id"], how="left", indicator=True)
        gone = gone[gone["_merge"] == "left_only"]
        moves.append(gone.assign(**{name: -gone[name] for name in COUNTS}))
    return _summed(stay, own), _summed(pd.concat(moves, ignore_index=True), ["part", "mask"])


def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """State of one bucket of texts; rows that are sums already go straight through."""
    names = ["part", "mask", "moved", *COUNTS]
    if key[0] < 0:
        for frame in frames:
            yield frame[names]
        return
    rows = pd.concat(list(frames), ignore_index=True)
    rows["id"] = rows["id"].astype("Int64")
    held = None
    if state.exists:
        held = _frame(pa.ipc.open_stream(state.get[0]).read_all())
    holders, moves = held_ids(held, rows)
    state.update((_packed(holders),))
    if len(moves):
        yield moves.assign(moved=True)[names]


def _streamed(path: str, files: list[str]) -> str:
    """A path the streaming source takes: a table that is a single file is named by a pattern."""
    name = path.rstrip("/").rpartition("/")[2]
    single = len(files) == 1 and files[0].rpartition("/")[2] == name
    return f"{path[:-1]}[{path[-1]}]" if single else path


def part_counters(
    spark: SparkSession,
    documents: str,
    labels: DataFrame,
    batches: int = BATCHES,
    texts_per_bucket: int = TEXTS_PER_BUCKET,
) -> DataFrame:
    """Rows per part and failure mask (bits in the order of the letters), with good and toxic ones.

    ``documents`` is the path of a Parquet table, whose files become ``batches``
    micro-batches. The sums of a batch may be read while later ones still run.
    """
    table = spark.read.parquet(documents)
    # Row counts come from the files' footers.
    buckets = max(1, math.ceil(table.count() / texts_per_bucket))
    paths = table.inputFiles()
    files = max(1, math.ceil(len(paths) / batches))
    # Files of any age count; the source would skip those a week older than the newest.
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).option("maxFileAge", "100000d")
    rows = _rows(reader.parquet(_streamed(documents, paths)), labels, buckets).mapInArrow(combine, COMBINED)
    changes = rows.groupBy("bucket").applyInPandasWithState(update, COUNTERS, STATE, "append", "NoTimeout")
    out = work_path(spark, "audit-counters")

    def add(batch: DataFrame, number: int) -> None:
        mask, moved = F.col("mask"), F.col("moved")
        copies = mask.bitwiseOR(F.lit(COPY))
        sign = F.struct(copies.alias("mask"), F.when(moved, -1).otherwise(1).alias("sign"))
        signs = F.when(moved, F.array(F.struct(mask.alias("mask"), F.lit(1).alias("sign")), sign)).otherwise(F.array(sign))
        each = batch.select("part", *COUNTS, F.explode(signs).alias("s"))
        sums = each.groupBy("part", "s.mask").agg(*(F.sum(F.col(name) * F.col("s.sign")).alias(name) for name in COUNTS))
        sums.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={number}")

    schema = "part string, mask int, n long, good long, toxic long, batch int"
    spark.createDataFrame([], schema).drop("batch").write.parquet(f"{out}/batch=-1")
    writer = changes.writeStream.foreachBatch(add).option("checkpointLocation", work_path(spark, "audit-state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    counters = spark.read.schema(schema).parquet(out)
    sums = counters.groupBy("part", "mask").agg(*(F.sum(name).alias(name) for name in COUNTS))
    return sums.filter("n <> 0")


def audit(counters: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: what the step keeps, removes and costs.

    A part's sums are at most 32, so its rows come from one small array.
    """
    masks = F.collect_list(F.struct("mask", *COUNTS)).alias("masks")
    orders = ["".join(p) for p in permutations(LETTERS)]
    steps = counters.groupBy("part").agg(masks).select("part", "masks", F.explode(F.lit(orders)).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))

    def bits(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(LETTERS)), F.lit(0))

    own = F.substring("filter_order", F.col("step"), F.lit(1))
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    steps = steps.select("part", "masks", "filter_order", "step", bits(own).alias("own"), bits(earlier).alias("earlier"))

    def fails(mask: Column, which: str) -> Column:
        return mask.bitwiseAND(F.col(which)) != 0

    def total(test, value=lambda m: m["n"]) -> Column:
        chosen = F.filter("masks", lambda m: test(m["mask"]))
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda all_, m: all_ + value(m))

    def removed(mask: Column) -> Column:
        return fails(mask, "own") & ~fails(mask, "earlier")

    # Of the filters a row fails, each comes first in an equal share of the orders.
    share = math.factorial(len(LETTERS))
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: ~fails(m, "own") & ~fails(m, "earlier")).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: fails(m, "own") & fails(m, "earlier")).alias("redundant"),
        total(lambda m: m == F.col("own")).alias("unique_fails"),
        total(removed, lambda m: m["good"]).alias("good_lost"),
        total(removed, lambda m: m["toxic"]).alias("toxic_lost"),
        total(lambda m: fails(m, "own"), lambda m: m["n"] * (F.lit(share) / F.bit_count(m["mask"])).cast("long")).alias("shapley"),
    )

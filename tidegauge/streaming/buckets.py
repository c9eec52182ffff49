"""Silver and trend mart kept up by micro-batches, at the price of what a batch touches.

Versions lie in buckets by a hash of their id, cleaned and tagged when they arrive. A batch
adds a step: a folder with one part per bucket that it touches, and the signed change of the
monthly counts, in which a new version takes back what the one before it had counted. Silver
is the newest version of each id over all steps, and only buckets that lie in several steps
need a shuffle to find it; the mart is the sum of all changes. ``compact_buckets`` rewrites
those buckets and no other.

A step counts once a version of the state names it: a small table written in one file and
renamed into place. A batch that fails half way or comes again changes nothing, and writes
over what it had left. Writers to one table take turns; two at once are an error.

Defined results: the live filter runs before the choice of version, so a deletion falls back
to the last live version; records without an id are one record; rows without a time have no
month and are in no count.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections import Counter
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.functions.dates import month_of
from tidegauge.functions.text import clean_html, text_or_empty
from tidegauge.operators.staging import NEWEST_FIRST, SILVER_COLUMNS, latest_by, newest_versions
from tidegauge.operators.taxonomy import Term, found_terms, plan_terms, prepare_text
from tidegauge.operators.trends import SPINE_START, mart_of_counts
from tidegauge.streaming.jobs import VERSIONS, bronze_stream, start_batches

# Buckets of a table, fixed by its first batch. A bucket is what a compaction rewrites.
BUCKETS = 256

SILVER = f"{VERSIONS}, text string, full_text string, terms array<int>"
CHANGES = "month date, number int, rows bigint"
STATE = "kind string, step bigint, buckets array<int>, batch bigint, taxonomy string"


@dataclass(frozen=True)
class _State:
    """What counts: steps with the buckets read from them, steps of the mart, last batch."""

    version: int = 0
    batch: int = -1
    buckets: int = 0
    taxonomy: str | None = None
    silver: dict[int, list[int]] = field(default_factory=dict)
    mart: list[int] = field(default_factory=list)


def _states(spark: SparkSession, out: str) -> DataFrame:
    try:
        return spark.read.schema(f"{STATE}, version bigint").parquet(f"{out}/state")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{STATE}, version bigint")


def _state(spark: SparkSession, out: str) -> _State:
    """The newest state; it has a row per step since the last compaction."""
    every = _states(spark, out)
    last = every.agg(F.max("version")).first()[0]
    if last is None:
        return _State()
    rows = every.filter(F.col("version") == last).collect()
    table = next(r for r in rows if r["kind"] == "table")
    return _State(
        version=last,
        batch=table["batch"],
        buckets=table["buckets"][0],
        taxonomy=table["taxonomy"],
        silver={r["step"]: r["buckets"] for r in rows if r["kind"] == "silver"},
        mart=[r["step"] for r in rows if r["kind"] == "mart"],
    )


def _commit(spark: SparkSession, out: str, state: _State) -> None:
    """Write a state under its version; the job fails if another writer had that version."""
    rows = [("table", None, [state.buckets], state.batch, state.taxonomy)]
    rows += [("silver", step, buckets, None, None) for step, buckets in state.silver.items() if buckets]
    rows += [("mart", step, None, None, None) for step in state.mart]
    frame = spark.createDataFrame(rows, STATE).coalesce(1)
    frame.write.mode("errorifexists").parquet(f"{out}/state/version={state.version}")


def _rows(spark: SparkSession, out: str, silver: dict[int, list[int]]) -> DataFrame:
    """All versions in the given buckets of the given steps; other parts are not read."""
    if not silver:
        return spark.createDataFrame([], f"{SILVER}, step bigint, bucket int")
    every = spark.read.schema(f"{SILVER}, step bigint, bucket int").option("basePath", f"{out}/silver")
    chosen = F.lit(False)
    for step, buckets in silver.items():
        chosen = chosen | ((F.col("step") == step) & F.col("bucket").isin(buckets))
    return every.parquet(*[f"{out}/silver/step={step}" for step in silver]).filter(chosen)


def _only(silver: dict[int, list[int]], buckets: set[int]) -> dict[int, list[int]]:
    kept = {step: [b for b in own if b in buckets] for step, own in silver.items()}
    return {step: own for step, own in kept.items() if own}


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def _write_step(rows: DataFrame, out: str, step: int) -> None:
    """``rebalance`` cuts a bucket that holds most rows over several tasks."""
    target = f"{out}/silver/step={step}"
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)


def _digest(terms: list[Term]) -> str:
    return hashlib.sha256(repr([(t.key, t.pattern) for t in terms]).encode()).hexdigest()


def _signed_changes(known: DataFrame, arrived: DataFrame) -> DataFrame:
    """What a batch does to the counts per month and term; term -1 stands for all rows.

    ``known`` are the versions stored so far, several per id perhaps; only ids that arrive
    are looked at. One aggregate per id finds the newest version before and after; an id
    whose newest version stays is left out.
    """
    columns = ["id", *NEWEST_FIRST, "terms"]
    ids = arrived.select(F.col("id").alias("__id"))
    met = known.select(*columns).join(ids, F.col("id").eqNullSafe(F.col("__id")), "left_semi")
    both = met.withColumn("new", F.lit(False)).unionByName(arrived.select(*columns).withColumn("new", F.lit(True)))
    order = F.struct(*NEWEST_FIRST)
    counted = F.struct(month_of("posted_at").alias("month"), F.concat(F.array(F.lit(-1)), "terms").alias("numbers"))
    ends = both.groupBy("id").agg(
        F.max_by(counted, F.when(~F.col("new"), order)).alias("before"), F.max_by(counted, order).alias("after")
    )

    def signed(side: str, sign: int) -> Column:
        own = F.transform(
            F.col(f"{side}.numbers"),
            lambda number: F.struct(F.col(f"{side}.month").alias("month"), number.alias("number"), F.lit(sign).cast("bigint").alias("rows")),
        )
        return F.coalesce(own, F.array().cast("array<struct<month:date,number:int,rows:bigint>>"))

    return (
        ends.filter(~F.col("before").eqNullSafe(F.col("after")))
        .select(F.explode(F.concat(signed("before", -1), signed("after", 1))).alias("change"))
        .select("change.*")
        .filter(F.col("month").isNotNull())
        .groupBy("month", "number")
        .agg(F.sum("rows").alias("rows"))
        .filter("rows <> 0")
    )


def merge_batch(
    bronze: DataFrame,
    out: str,
    batch: int,
    taxonomy: DataFrame | list[Term] = (),
    *,
    type_value: str = "comment",
    tag_replacement: str = "",
    buckets: int = BUCKETS,
) -> bool:
    """Take the bronze rows of one batch in; false if the table has that batch already.

    The taxonomy is part of the table: rows hold the numbers of their terms, so another
    one is an error. Its number of buckets is that of the first batch.
    """
    spark, terms = bronze.sparkSession, plan_terms(taxonomy if isinstance(taxonomy, DataFrame) else list(taxonomy))
    state = _state(spark, out)
    if batch <= state.batch:
        return False
    if state.version and state.taxonomy != _digest(terms):
        raise ValueError("the table was built with another taxonomy; build it anew")
    buckets, step = state.buckets or buckets, state.version + 1
    cleaned = newest_versions(bronze, type_value).withColumn("text", clean_html("raw_text", tag_replacement))
    columns = cleaned.withColumn("full_text", text_or_empty("text")).withColumn("bucket", _bucket(buckets))
    tagged = prepare_text(columns.withColumn("__full", F.col("full_text")), "__full", columns.columns)
    numbers = F.transform(found_terms(terms), lambda t: t["number"]) if terms else F.array().cast("array<int>")
    _write_step(tagged.select(*columns.columns, numbers.alias("terms")), out, step)
    arrived = spark.read.schema(f"{SILVER}, bucket int").parquet(f"{out}/silver/step={step}")
    # At most as many rows as the table has buckets.
    touched = sorted(r["bucket"] for r in arrived.select("bucket").distinct().collect())
    known = _rows(spark, out, _only(state.silver, set(touched)))
    changes = _signed_changes(known, arrived)
    changes.write.mode("overwrite").parquet(f"{out}/mart/step={step}")
    _commit(
        spark,
        out,
        _State(step, batch, buckets, _digest(terms), {**state.silver, step: touched}, [*state.mart, step]),
    )
    return True


def stream_buckets(
    spark: SparkSession,
    bronze: str,
    out: str,
    checkpoint: str,
    taxonomy: DataFrame | list[Term] = (),
    *,
    type_value: str = "comment",
    tag_replacement: str = "",
    buckets: int = BUCKETS,
    max_files: int | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Keep silver and the counts of the mart up with a growing bronze folder."""
    terms = plan_terms(taxonomy if isinstance(taxonomy, DataFrame) else list(taxonomy))

    def fold(batch: DataFrame, batch_id: int) -> None:
        merge_batch(
            batch, out, batch_id, terms, type_value=type_value, tag_replacement=tag_replacement, buckets=buckets
        )

    return start_batches(bronze_stream(spark, bronze, max_files), fold, checkpoint, interval)


def _open_buckets(state: _State, steps: int = 2) -> set[int]:
    """Buckets that lie in so many steps or more."""
    places = Counter(b for own in state.silver.values() for b in own)
    return {bucket for bucket, count in places.items() if count >= steps}


def read_buckets(spark: SparkSession, out: str) -> DataFrame:
    """The silver table as of the last batch.

    Buckets in one step are read as they are; rows of the others are compared by id.
    """
    state = _state(spark, out)
    several = _open_buckets(state)
    settled = _only(state.silver, {b for own in state.silver.values() for b in own} - several)
    rows = _rows(spark, out, settled).select(*SILVER_COLUMNS)
    if not several:
        return rows
    newest = latest_by(_rows(spark, out, _only(state.silver, several)), ["bucket", "id"], NEWEST_FIRST)
    return rows.unionByName(newest.select(*SILVER_COLUMNS)) if settled else newest.select(*SILVER_COLUMNS)


def _counts(spark: SparkSession, out: str, state: _State) -> DataFrame:
    if not state.mart:
        return spark.createDataFrame([], CHANGES)
    paths = [f"{out}/mart/step={step}" for step in state.mart]
    changes = spark.read.schema(CHANGES).parquet(*paths)
    return changes.groupBy("month", "number").agg(F.sum("rows").alias("rows")).filter("rows <> 0")


def read_trends(
    spark: SparkSession,
    out: str,
    taxonomy: DataFrame | list[Term],
    end: dt.date,
    start: dt.date = SPINE_START,
) -> DataFrame:
    """The trend mart as of the last batch: the sum of all changes, no record is read."""
    terms, state = plan_terms(taxonomy), _state(spark, out)
    if state.version and state.taxonomy != _digest(terms):
        raise ValueError("the table was built with another taxonomy")
    return mart_of_counts(spark, _counts(spark, out, state), terms, start, end)


def compact_buckets(spark: SparkSession, out: str, steps: int = 2) -> list[int]:
    """Rewrite the buckets that lie in ``steps`` or more steps; returns their numbers.

    Only these are read and written. The changes of the mart are summed as well.
    """
    state = _state(spark, out)
    several = _open_buckets(state, max(steps, 2))
    if not several:
        return []
    step = state.version + 1
    newest = latest_by(_rows(spark, out, _only(state.silver, several)), ["bucket", "id"], NEWEST_FIRST)
    _write_step(newest.drop("step"), out, step)
    _counts(spark, out, state).write.mode("overwrite").parquet(f"{out}/mart/step={step}")
    every = {b for own in state.silver.values() for b in own}
    silver = {**_only(state.silver, every - several), step: sorted(several)}
    _commit(spark, out, replace(state, version=step, silver=silver, mart=[step]))
    return sorted(several)


def retire_steps(spark: SparkSession, out: str, keep: int = 2) -> list[int]:
    """Empty the steps that none of the newest ``keep`` states names; returns them.

    Readers that started on an older state lose their files, so keep enough of them.
    """
    if keep < 1:
        raise ValueError("the current state must stay")
    states = _states(spark, out)
    versions = [r["version"] for r in states.select("version").distinct().orderBy(F.desc("version")).collect()]
    if len(versions) <= keep:
        return []
    last = versions[keep - 1]
    held = F.max(F.col("version") >= last)
    old = states.filter("step IS NOT NULL").groupBy("kind", "step").agg(held.alias("held")).filter("NOT held").collect()
    for row in old:
        spark.range(0).write.mode("overwrite").parquet(f"{out}/{row['kind']}/step={row['step']}")
    for version in versions[keep:]:
        spark.createDataFrame([], STATE).write.mode("overwrite").parquet(f"{out}/state/version={version}")
    return sorted({r["step"] for r in old if r["kind"] == "silver"})

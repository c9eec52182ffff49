"""Exact dedup by skew-safe combining, in DataFrame functions only.

Texts are equal when they are identical after every run of space, tab, line feed,
vertical tab, form feed and carriage return has become one space. Each task first
combines its own equal rows (the partial aggregation); what is left goes by digest,
content and a salt that stands for the task, so a text that fills a third of all rows
reaches one place at most once per task and is spread over ``SALTS`` places; the winners
of the salts are combined once more. The whole content is a grouping key in every one
of these stages, next to its digest. Rows then find their group by the digest alone
where the last stage has seen one content under it, and by digest and content where it
has seen several, so a collision never merges texts.

Defined results: a null text counts as empty, and equals every empty text; ties do not
occur between different ids, as the smallest one stays; a null id is larger than any
other, so ``keep_id`` is null only where all ids of a group are; rows that repeat both id
and text are one document listed more than once: each is counted in ``group_size`` and
says ``kept`` if its id stays (``keep_one_of_each`` returns one of them); texts of
any length are compared whole; an empty table gives no rows; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidegauge.llm.common import stored

# Places over which the copies of one text are dealt before the last combination.
SALTS = 32


def normalised(text: Column) -> Column:
    """The text with one space for each run of ASCII white space; null gives empty.

    A single space is left alone rather than replaced by itself.
    """
    runs = r"[\x20\x09-\x0D]{2,}+|[\x09-\x0D]"
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), runs, " ")


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def _contents(documents: DataFrame, text: str, id_: str, digest: Callable[[Column], Column]) -> DataFrame:
    """``id_``, ``content_`` and ``digest_`` of every row."""
    content = documents.select(F.col(id_).alias("id_"), normalised(F.col(text)).alias("content_"))
    return content.withColumn("digest_", digest(F.col("content_")))


def _combined(contents: DataFrame, best: Column, rows: Column) -> DataFrame:
    """One row per digest and content: equal rows meet in tasks, then by salt, then over all."""
    salted = (
        contents.withColumn("salt_", F.spark_partition_id() % SALTS)
        .groupBy("digest_", "content_", "salt_")
        .agg(best.alias("best_"), rows.alias("rows_"))
    )
    winners = salted.groupBy("digest_", "content_")
    return winners.agg(F.min("best_").alias("best_"), F.sum("rows_").alias("rows_"))


def exact_duplicates(
    documents: DataFrame,
    text: str = "text",
    id_: str = "doc_id",
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """For every row: its id, ``keep_id``, ``group_size``, ``kept`` and the digest of its text."""
    contents = _contents(documents, text, id_, digest)
    found = _combined(contents, F.min("id_"), F.count(F.lit(1))).groupBy("digest_").agg(
        F.min("best_").alias("keep_"), F.sum("rows_").alias("rows_"), F.count(F.lit(1)).alias("texts_")
    )
    # Only groups of several rows need looking up; who finds none is alone.
    seen = Observation()
    several = found.filter("rows_ > 1").observe(seen, F.count_if(F.col("texts_") > 1).alias("mixed"))
    groups = stored(several, "exact-groups")
    alone, one_text = F.col("texts_").isNull(), F.col("texts_") == 1
    looked_up = contents.join(groups, "digest_", "left")
    if not seen.get["mixed"]:
        return _judged(looked_up.drop("content_"), id_, alone)
    # Different texts under one digest: these rows are looked up by their content as well.
    mixed = contents.join(groups.filter("texts_ > 1"), "digest_", "left_semi")
    exact = _combined(mixed, F.min("id_"), F.count(F.lit(1))).withColumnRenamed("best_", "keep_")
    again = mixed.join(exact, ["digest_", "content_"])
    plain = _judged(looked_up.filter(alone | one_text).drop("content_"), id_, alone)
    return plain.unionByName(_judged(again, id_, F.lit(False)))


def _judged(rows: DataFrame, id_: str, alone: Column) -> DataFrame:
    keep = F.when(alone, F.col("id_")).otherwise(F.col("keep_"))
    return rows.select(
        F.col("id_").alias(id_),
        keep.alias("keep_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("rows_")).cast("long").alias("group_size"),
        F.col("id_").eqNullSafe(keep).alias("kept"),
        F.col("digest_").alias("digest"),
    )


def keep_one_of_each(
    documents: DataFrame,
    text: str = "text",
    id_: str = "doc_id",
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One whole row of every text: that with the smallest id (of repeated rows, the least
    by the other columns, which must be sortable). Rows travel in the same three stages."""
    own = [F.col(id_).isNull().alias("no_id_"), F.col(id_).alias("order_"), F.struct("*").alias("row_")]
    rows = documents.select(F.struct(*own).alias("whole_"), normalised(F.col(text)).alias("content_"))
    rows = rows.withColumn("digest_", digest(F.col("content_")))
    return _combined(rows, F.min("whole_"), F.count(F.lit(1))).select("best_.row_.*")

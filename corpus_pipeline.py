"""The corpus pipeline: documents in, cleaned and tokenised documents out.

``STAGES`` names the stages in order. Each takes (spark, docs, sf_dir) and works on all that
the stage before has kept; all but the last return the columns of ``documents``.

Defined results: a null or empty text has no language and goes in the first stage; equal
rows are one document from the second stage on; rows without doc_id count after all
others; columns other than doc_id, text, lang and n_chars are passed on as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.bpecodec import encode
from tidegauge.llm.common import stored
from tidegauge.llm.decontaminate import without_leaks
from tidegauge.llm.langid import keep_identified
from tidegauge.llm.simhash import keep_one_of_each
from tidegauge.llm.suffixes import without_repeats
from tidegauge.session import prepare

# Operator 8's shingle length and greatest distance of fingerprints.
NEAR_WORDS, NEAR_BITS = 3, 2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network can tell (operator 7)."""
    prepare(spark)
    return keep_identified(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id (operator 8).

    Near means fingerprints of 3-word shingles that differ in 2 bits or fewer; a group is all
    that such links reach.
    """
    prepare(spark)
    return keep_one_of_each(docs, budget=NEAR_BITS, size=NEAR_WORDS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier in the corpus (operator 3)."""
    prepare(spark)
    kept = without_repeats(docs)
    if "n_chars" not in docs.columns:
        return kept
    counted = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", counted).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of the benchmark (operator 4)."""
    prepare(spark)
    benchmark = spark.read.parquet(f"{str(sf_dir).rstrip('/')}/benchmark.parquet")
    return without_leaks(docs, benchmark)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it (operator 10)."""
    prepare(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    held = docs.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_sha256"), "text")
    encoded = encode(held, ranks, keep=("doc_id", "text_sha256"), decoded=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.col("ids").alias("token_ids"),
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"),
    )


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]
# Neither the network nor XXH64 nor the merges can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of a folder; each result is a table in between."""
    docs = prepare(spark).read.parquet(f"{str(sf_dir).rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

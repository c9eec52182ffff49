"""Registered queries of the subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.alignment import align
from tidegauge.llm.bpecodec import encode
from tidegauge.llm.bpecount import count_tokens
from tidegauge.llm.common import table
from tidegauge.llm.covertree import top_inner_products
from tidegauge.llm.decontaminate import leaks
from tidegauge.llm.exactdups import exact_duplicates
from tidegauge.llm.filteraudit import audit, part_counters
from tidegauge.llm.langid import identify
from tidegauge.llm.linkgraph import judge_urls
from tidegauge.llm.shards import shuffle_into_shards
from tidegauge.llm.simhash import near_duplicates
from tidegauge.llm.suffixes import repeated_passages
from tidegauge.llm.toxicity import score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of session and folder under its own name."""

    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return add


# The rules of the query over pages.
URL_RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}


@query(
    """
    WITH whole AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    ), scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
    ), ranked AS (
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
        vec_id, score
      FROM scored
    )
    SELECT * FROM ranked WHERE rank <= 10
    """
)
def op1_dual_cover_tree(spark: SparkSession, folder: str) -> DataFrame:
    return top_inner_products(table(spark, folder, "embeddings"))


@query()
def op2_counterfactual_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    r"""
    WITH words AS (
      SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w
      FROM documents
    ), windows AS (
      SELECT doc_id, unnest(range(len(w) - 49)) AS position, unnest(list_transform(
        range(len(w) - 49), lambda i: list_slice(w, i + 1, i + 50))) AS win
      FROM words WHERE len(w) >= 50
    ), marked AS (
      SELECT doc_id, position, count(*) OVER (PARTITION BY win) AS n,
        row_number() OVER (PARTITION BY win ORDER BY doc_id, position) = 1 AS is_first
      FROM windows
    ), runs AS (
      SELECT *, CASE WHEN position - lag(position) OVER (PARTITION BY doc_id ORDER BY position) <= 50
        THEN 0 ELSE 1 END AS breaks
      FROM marked WHERE n > 1
    ), numbered AS (
      SELECT *, sum(breaks) OVER (PARTITION BY doc_id ORDER BY position) AS run FROM runs
    )
    SELECT doc_id, CAST(min(position) AS INT) AS first_word, CAST(max(position) + 49 AS INT) AS last_word,
      CAST(max(position) + 50 - min(position) AS INT) AS n_words, bool_and(is_first) AS has_first
    FROM numbered GROUP BY doc_id, run
    """
)
def op3_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(table(spark, folder, "documents"))


@query()
def op4_template_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op5_hypergeometric_shards(spark: SparkSession, folder: str) -> DataFrame:
    dealt = shuffle_into_shards(table(spark, folder, "documents"))
    none = F.lit(None).cast("int")
    return dealt.select("*", F.lit("rows").alias("law"), none.alias("grown_shard"))


@query()
def op6_link_graph(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), URL_RULES)


@query()
def op7_byte_cnn_language(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "documents"))


@query()
def op8_simhash_trie(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query()
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return count_tokens(documents, public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op10_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode(table(spark, folder, "documents"), ranks, decoded=True)
    ids = F.col("ids")
    return encoded.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op11_spill_alignment(spark: SparkSession, folder: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned, _ = align(table(spark, folder, "documents"), a, b, hashed=True)
    return aligned


@query(
    r"""
    WITH n AS (
      SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
    )
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
      doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY t)
    """
)
def op13_salted_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_duplicates(table(spark, folder, "documents"))
    return found.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


@query(
    r"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents
    ), w AS (
      SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
        min(doc_id) OVER (PARTITION BY t) AS least FROM d
    ), l AS (
      SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
    ), f AS (
      SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
          'A': len(words) < 200,
          'B': 100 * len(list_distinct(words)) < 50 * len(words),
          'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t),
          'D': regexp_matches(t, '[#$%&*|]'),
          'E': least IS NOT NULL AND (w.doc_id IS NULL OR w.doc_id > least)
        } AS s
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id
    ), m AS (
      SELECT part, concat(CASE WHEN s.A THEN 'A' ELSE '' END, CASE WHEN s.B THEN 'B' ELSE '' END,
        CASE WHEN s.C THEN 'C' ELSE '' END, CASE WHEN s.D THEN 'D' ELSE '' END, CASE WHEN s.E THEN 'E' ELSE '' END) AS fails,
        count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
      FROM f GROUP BY ALL
    ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
      SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order
      FROM letters a, letters b, letters c, letters d, letters e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
    ), steps AS (
      SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS own, left(filter_order, step - 1) AS earlier
      FROM orders, range(1, 6) r(step)
    ), firsts AS (
      SELECT fails, x, count(*) AS times FROM (
        SELECT fails, filter_order, list_filter(list_transform(range(1, 6), lambda i: filter_order[i]),
          lambda c: contains(fails, c))[1] AS x
        FROM (SELECT DISTINCT fails FROM m), orders
      ) GROUP BY ALL
    ), shapley AS (
      SELECT part, x, sum(n * times) AS shapley FROM m JOIN firsts USING (fails) WHERE x IS NOT NULL GROUP BY ALL
    ), marked AS (
      SELECT m.*, s.*, contains(fails, own) AS hit,
        len(list_filter(string_split(fails, ''), lambda c: c <> '' AND contains(earlier, c))) > 0 AS before
      FROM m, steps s
    )
    SELECT marked.part, filter_order, step,
      CAST(coalesce(sum(n) FILTER (NOT hit AND NOT before), 0) AS BIGINT) AS kept,
      CAST(coalesce(sum(n) FILTER (hit AND NOT before), 0) AS BIGINT) AS removed,
      CAST(coalesce(sum(n) FILTER (hit AND before), 0) AS BIGINT) AS redundant,
      CAST(coalesce(sum(n) FILTER (fails = own), 0) AS BIGINT) AS unique_fails,
      CAST(coalesce(sum(good) FILTER (hit AND NOT before), 0) AS BIGINT) AS good_lost,
      CAST(coalesce(sum(toxic) FILTER (hit AND NOT before), 0) AS BIGINT) AS toxic_lost,
      CAST(coalesce(max(shapley.shapley), 0) AS BIGINT) AS shapley
    FROM marked LEFT JOIN shapley ON marked.part = shapley.part AND shapley.x = own
    GROUP BY marked.part, filter_order, step
    """
)
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    return audit(part_counters(spark, f"{str(folder).rstrip('/')}/documents.parquet", labels))

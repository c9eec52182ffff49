"""Toxicity of texts by a classifier that is regularised on counterfactuals.

Features are the presence of words, word beginnings and word ends that go with the label in
the training sample. For sentences of the sample a counterfactual is made by swapping an
identity term for another one of its group; where a sentence has none, a term takes the
place of a word, so that every group is seen in the labelled sentences. The logistic
regression is fitted to the labels and pays for every difference of score between the
sentence and its swap, so that the mere mention of a group does not move a score.

Defined results: null and empty texts get the score of a text without any feature; rows
without doc_id are neither learned from nor held out; a document labelled twice counts as
toxic if any label says so; without labels of both kinds every score is the share of
toxic ones (one half without any label). Equal texts count once in the sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import crc32_of, least_keys

# Neutral terms for groups of people, by what sets the groups apart.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("black", "white", "asian", "african", "european", "latino"),
    ("old", "young", "deaf", "blind", "disabled"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("femmes", "hommes", "filles", "garçons"),
)

# The sample: distinct texts of each label; chosen features and the least size of their
# association with the label, in standard errors of a difference of shares; least number
# of counterfactuals of a text, where it has so many sentences.
TOXIC_TEXTS = 1500
OTHER_TEXTS = 3000
FEATURES = 600
LEAST_ASSOCIATION = 5.0
SWAPS_PER_TEXT = 4
# Price of weights and of score differences under a swap.
RIDGE = 0.002
SWAP_PRICE = 10.0
STEPS = 40

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
_GROUP_OF = {term: group for group in IDENTITY_GROUPS for term in group}


def features_of(words: Iterable[str]) -> set[str]:
    """Whole words as `` word ``, beginnings as `` wor`` and ends as ``ord ``."""
    found = set()
    for word in set(words):
        found.add(f" {word} ")
        for size in range(3, min(7, len(word))):
            found.add(f" {word[:size]}")
            found.add(f"{word[-size:]} ")
    return found


def swaps_of(text: str) -> list[tuple[list[str], list[str]]]:
    """Words of sentences and of their counterfactuals.

    Every sentence of the text that mentions a group has one; sentences without a mention,
    spread over the whole text, fill up to ``SWAPS_PER_TEXT``.
    """
    sentences = [(at, words) for at, part in enumerate(_SENTENCE.split(text.lower())) if (words := _WORD.findall(part))]
    naming = [x for x in sentences if not _GROUP_OF.keys().isdisjoint(x[1])]
    others = [x for x in sentences if _GROUP_OF.keys().isdisjoint(x[1])]
    some = min(len(others), max(0, SWAPS_PER_TEXT - len(naming)))
    pairs = []
    for at, words in naming + [others[i * len(others) // some] for i in range(some)]:
        here = [i for i, word in enumerate(words) if word in _GROUP_OF]
        if not here:
            # No group is mentioned: a term of some group, in turn, stands for a word.
            group = IDENTITY_GROUPS[(len(words) + at) % len(IDENTITY_GROUPS)]
            here, words = [len(words) // 2], list(words)
            words[here[0]] = group[(len(words) * 7 + at) % len(group)]
        other = list(words)
        for i in here:
            group = _GROUP_OF[words[i]]
            other[i] = group[(group.index(words[i]) + 1 + at % (len(group) - 1)) % len(group)]
        pairs.append((words, other))
    return pairs


@dataclass
class Classifier:
    features: list[str]
    weights: np.ndarray
    offset: float

    def score(self, present: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(present @ self.weights + self.offset)))


def fit(x: np.ndarray, y: np.ndarray, differences: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Newton's method on log loss, ridge and the price of swap differences.

    ``differences`` is the mean of their products, feature by feature; ``share`` is the part of toxic texts among all labelled ones; the offset is set for
    it, as the sample holds the labels in other parts.
    """
    rows = np.c_[x, np.ones(len(x))]
    weight = np.zeros(rows.shape[1])
    price = np.zeros((len(weight), len(weight)))
    price[:-1, :-1] = RIDGE * np.eye(x.shape[1])
    price[:-1, :-1] += SWAP_PRICE * differences
    price[-1, -1] = 1e-6
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(rows @ weight, -30, 30)))
        slope = rows.T @ (p - y) / len(y) + price @ weight / 10
        curve = (rows * (p * (1 - p))[:, None]).T @ rows / len(y) + price / 10
        change = np.linalg.solve(curve + 1e-9 * np.eye(len(weight)), slope)
        weight -= change * min(1.0, 4.0 / max(1e-9, np.abs(change).max()))
        if np.abs(change).max() < 1e-6:
            break
    sampled = y.mean()
    return weight[:-1], float(weight[-1] + np.log(share / (1 - share)) - np.log(sampled / (1 - sampled)))


def _sample(documents: DataFrame, labels: DataFrame, text: str, id_column: str) -> tuple[DataFrame, float]:
    """Rows (toxic, key, text) of the bounded sample, and the share of toxic texts."""
    learned = labels.filter(F.col("toxic").isNotNull() & (crc32_of(F.col(id_column)) % 5 != 0))
    labelled = learned.groupBy(F.col(id_column).alias("id_")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    keyed = documents.filter(F.col(text).isNotNull()).select(
        F.col(id_column).alias("id_"), F.xxhash64(text).alias("key"), F.col(text).cast("string").alias("text")
    )
    keys = keyed.select("id_", "key").join(labelled, "id_").groupBy("key").agg(F.max("toxic").alias("toxic"))
    counts = {row[0]: row[1] for row in keys.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    most = {}
    for toxic, size in ((1, TOXIC_TEXTS), (0, OTHER_TEXTS)):
        most |= least_keys(keys.filter(F.col("toxic") == toxic), "toxic", "key", size)
    # The bound comes before the join, so only the texts of the sample are shuffled.
    near = keyed.filter(F.col("key") <= max(most.values(), default=-(2**63)))
    chosen = near.join(labelled, "id_").filter(
        F.col("key") <= F.when(F.col("toxic") == 1, most.get(1, -(2**63))).otherwise(most.get(0, -(2**63)))
    )
    return chosen.groupBy("key").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")), share


def _associated(sample: DataFrame, counts: dict[int, int]) -> list[str]:
    """Features whose share differs most between the two labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = (Counter(), Counter())
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                both[toxic].update(features_of(_WORD.findall(text.lower())))
        names = sorted(both[0].keys() | both[1].keys())
        for first in range(0, len(names), 50_000):
            part = names[first : first + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), *(pa.array([c[x] for x in part], pa.int64()) for c in both)], names=["feature", "other", "toxic"]
            )

    found = sample.select("toxic", "text").mapInArrow(run, "feature string, other long, toxic long")
    n0, n1 = counts[0], counts[1]
    sums = found.groupBy("feature").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    p = (F.col("other") + F.col("toxic") + 0.5) / (n0 + n1 + 1)
    error = F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    size = F.abs((F.col("toxic") / n1 - F.col("other") / n0) / error)
    chosen = sums.withColumn("size", size).filter(F.col("size") >= LEAST_ASSOCIATION)
    return [row[0] for row in chosen.orderBy(F.desc("size"), "feature").limit(FEATURES).collect()]


def learn(documents: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id") -> Classifier:
    """Fit the classifier on the labelled documents that are not held out."""
    sample, share = _sample(documents, labels, text, id_column)
    counts = {row[0]: row[1] for row in sample.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        bounded = min(max(share, 1e-3), 1 - 1e-3)
        return Classifier([], np.zeros(0), float(np.log(bounded / (1 - bounded))))
    terms = sorted(f" {term} " for term in _GROUP_OF)
    features = [x for x in _associated(sample, counts) if x not in terms] + terms
    index = {feature: i for i, feature in enumerate(features)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, present, swaps = [], [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                toxic.append(label)
                present.append(sorted(index[x] for x in features_of(_WORD.findall(text.lower())) if x in index))
                pairs = [tuple({index[x] for x in features_of(words) if x in index} for words in pair) for pair in swaps_of(text)]
                # What a swap adds counts from the front, what it takes away from minus one.
                swaps.append([sorted(b - a) + sorted(-1 - i for i in a - b) for a, b in pairs])
            kinds = pa.int32(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((toxic, present, swaps), kinds)], names=["toxic", "present", "swaps"])

    schema = "toxic int, present array<int>, swaps array<array<int>>"
    # One row of indices for each text of the bounded sample.
    rows = sample.orderBy("key").select("toxic", "text").mapInArrow(run, schema).collect()
    x = np.zeros((len(rows), len(features)), np.float64)
    # Sums of products, so that texts with many mentions cost no memory.
    products, swaps = np.zeros((len(features), len(features))), 0
    for i, row in enumerate(rows):
        x[i, row["present"]] = 1
        for swap in row["swaps"]:
            at = [k if k >= 0 else -1 - k for k in swap]
            sign = np.array([1.0 if k >= 0 else -1.0 for k in swap])
            products[np.ix_(at, at)] += np.outer(sign, sign)
            swaps += 1
    y = np.array([row["toxic"] for row in rows], np.float64)
    return Classifier(features, *fit(x, y, products / max(1, swaps), share))


def with_score(documents: DataFrame, model: Classifier, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Id and ``score`` of every whole text."""
    schema = T.StructType([documents.schema[id_column]]).add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = ahocorasick.Automaton()
        for i, feature in enumerate(model.features):
            search.add_word(feature, i)
        search.make_automaton()
        for batch in batches:
            sums = np.full(batch.num_rows, model.offset)
            for i, value in enumerate(batch.column(1)):
                if model.features and value.is_valid:
                    plain = f" {'  '.join(_WORD.findall(value.as_py().lower()))} "
                    sums[i] += model.weights[list({k for _, k in search.iter(plain)})].sum()
            scores = 1 / (1 + np.exp(-np.clip(sums, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=schema.names)

    return documents.select(id_column, F.col(text).cast("string").alias("text_")).mapInArrow(run, schema)


def score_toxicity(documents: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per document: id, ``held_out``, ``score`` and ``predicted``."""
    scored = with_score(documents, learn(documents, labels, text, id_column), text, id_column)
    held = F.coalesce(crc32_of(F.col(id_column)) % 5 == 0, F.lit(False))
    return scored.select(id_column, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

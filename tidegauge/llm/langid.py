"""Language identification by a convolutional network over bytes.

A text is cut into windows of fixed length in bytes (the last one filled up with zeros).
Filters of several widths run over each window, the largest answer of each filter is
kept, and a softmax layer turns these into probabilities; a text's are the mean over all
of its windows. Training is plain numpy on the driver, on a bounded sample.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is
every text if there is nothing to learn from. Every language that is labelled is learned;
of equally likely ones the first in the alphabet counts. Rows without doc_id are not learned from
and not held out. Equal texts count once in the sample. Any other column is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import crc32_of, least_keys, lettered

UNDETERMINED = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
# The sample: so many distinct texts of each language, and so many windows of each text. All
# languages share ``TEXTS``, so that many languages have fewer texts each.
TEXTS_PER_LANGUAGE = 1500
WINDOWS_PER_TEXT = 4
TEXTS = 96_000
EPOCHS = 6
BATCH = 64
RATE = 0.01
# Windows put through the network at a time.
AT_ONCE = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def windows_of(text: bytes) -> np.ndarray:
    """All windows of a text, one a row; at least one."""
    count = max(1, -(-len(text) // WINDOW))
    out = np.zeros(count * WINDOW, np.uint8)
    out[: len(text)] = _LOWER[np.frombuffer(text, np.uint8)]
    return out.reshape(count, WINDOW)


@dataclass
class Network:
    """Filters as tables by byte (width, place in the filter, byte, filter), and the output layer."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    @classmethod
    def new(cls, languages: list[str], seed: int) -> Network:
        draw = np.random.default_rng(seed)
        filters = [draw.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        size = FILTERS * len(WIDTHS)
        weights = draw.normal(0, 0.1, (size, len(languages))).astype(np.float32)
        return cls(languages, filters, np.zeros(size, np.float32), weights, np.zeros(len(languages), np.float32))

    def answers(self, windows: np.ndarray, width: int) -> np.ndarray:
        """Every filter of one width at every place of every window."""
        table = self.filters[WIDTHS.index(width)]
        places = windows.shape[1] - width + 1
        total = table[0][windows[:, :places]]
        for j in range(1, width):
            total += table[j][windows[:, j : j + places]]
        return total

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        best, where = [], []
        for width in WIDTHS:
            total = self.answers(windows, width)
            at = total.argmax(axis=1)
            where.append(at)
            best.append(np.take_along_axis(total, at[:, None, :], 1)[:, 0, :])
        return np.concatenate(best, axis=1) + self.bias, where

    def output(self, pooled: np.ndarray) -> np.ndarray:
        score = np.maximum(pooled, 0) @ self.weights + self.offset
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)


class Adam:
    """Step sizes from running moments of the gradient."""

    def __init__(self, parameters: list[np.ndarray]) -> None:
        self.parameters, self.steps = parameters, 0
        self.first = [np.zeros_like(p) for p in parameters]
        self.second = [np.zeros_like(p) for p in parameters]

    def step(self, gradients: list[np.ndarray], rate: float) -> None:
        self.steps += 1
        scale = rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for p, g, m, v in zip(self.parameters, gradients, self.first, self.second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (scale * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Fit by cross-entropy; each language weighs the same."""
    network, draw = Network.new(languages, seed), np.random.default_rng(seed)
    adam = Adam([*network.filters, network.bias, network.weights, network.offset])
    weight = (1 / np.maximum(1, np.bincount(labels, minlength=len(languages))))[labels]
    weight = weight / weight.mean()
    for epoch in range(EPOCHS):
        order = draw.permutation(len(windows))
        for first in range(0, len(order), BATCH):
            rows = order[first : first + BATCH]
            part, truth = windows[rows], labels[rows]
            pooled, where = network.pooled(part)
            error = network.output(pooled)
            error[np.arange(len(rows)), truth] -= 1
            error *= (weight[rows] / len(rows))[:, None].astype(np.float32)
            active = np.maximum(pooled, 0)
            back = (error @ network.weights.T) * (pooled > 0)
            gradients = []
            for i, width in enumerate(WIDTHS):
                own = back[:, i * FILTERS : (i + 1) * FILTERS]
                gradient = np.zeros_like(network.filters[i])
                for j in range(width):
                    byte = np.take_along_axis(part, where[i] + j, axis=1)
                    np.add.at(gradient[j], (byte, np.arange(FILTERS)[None, :]), own)
                gradients.append(gradient)
            gradients += [back.sum(axis=0), active.T @ error, error.sum(axis=0)]
            adam.step(gradients, RATE * (1 - epoch / EPOCHS))
    return network


class Reader:
    """A network laid out for scoring: filters of two bytes at a time."""

    def __init__(self, network: Network) -> None:
        self.network = network
        two, three, four = network.filters
        pair = lambda table, j: (table[j][:, None, :] + table[j + 1][None, :, :]).reshape(65536, FILTERS)
        self.first = np.concatenate([pair(two, 0), pair(three, 0), pair(four, 0)], axis=1)
        self.third, self.second = three[2], pair(four, 2)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Of all windows, a bounded number at a time."""
        return np.concatenate([self._some(windows[i : i + AT_ONCE]) for i in range(0, len(windows), AT_ONCE)])

    def _some(self, windows: np.ndarray) -> np.ndarray:
        pairs = windows[:, :-1].astype(np.uint16) << 8 | windows[:, 1:]
        total = self.first[pairs]
        f = FILTERS
        total[:, :-1, f : 2 * f] += self.third[windows[:, 2:]]
        total[:, :-2, 2 * f :] += self.second[pairs[:, 2:]]
        # The last places have room for the narrower filters only.
        best = [total[:, : WINDOW - w + 1, i * f : (i + 1) * f].max(axis=1) for i, w in enumerate(WIDTHS)]
        return self.network.output(np.concatenate(best, axis=1) + self.network.bias)


def learn(documents: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id") -> Network | None:
    """Train on a bounded sample of the documents that are not held out.

    The sample of a language are its distinct texts with the least fingerprints.
    """
    usable = documents.filter(
        F.col(text).isNotNull() & F.col(lang).isNotNull() & lettered(F.col(text)) & (crc32_of(F.col(id_column)) % 3 != 1)
    ).select(F.col(lang).cast("string").alias("lang"), F.xxhash64(text).alias("key"), F.col(text).cast("string").alias("text"))
    languages = sorted(row["lang"] for row in usable.select("lang").distinct().collect())
    if not languages:
        return None
    most = least_keys(usable, "lang", "key", min(TEXTS_PER_LANGUAGE, max(1, TEXTS // len(languages))))
    bounds = documents.sparkSession.createDataFrame([*most.items()], "lang string, most long")
    # One row for each language, and as many classes in the network.
    chosen = usable.join(F.broadcast(bounds), "lang").filter("key <= most").select("lang", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for value in batch.column(2):
                windows = windows_of(value.as_py().encode())
                # Spread over the text; the last, filled-up window of a long text stays out.
                whole = max(1, len(windows) - 1)
                take = np.unique(np.linspace(0, whole - 1, min(whole, WINDOWS_PER_TEXT)).astype(int))
                parts.append(windows[take].tobytes())
            columns = [batch.column(0), batch.column(1), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "key", "windows"])

    cut = chosen.mapInArrow(run, "lang string, key long, windows binary")
    # At most ``TEXTS`` rows (or one a language) of windows of fixed size reach the driver.
    rows = cut.groupBy("lang", "key").agg(F.min("windows").alias("windows")).collect()
    rows.sort(key=lambda row: (row["lang"], row["key"]))
    blocks = [np.frombuffer(bytes(row["windows"]), np.uint8).reshape(-1, WINDOW) for row in rows]
    labels = np.concatenate([np.full(len(b), languages.index(row["lang"])) for b, row in zip(blocks, rows)])
    return train(np.concatenate(blocks), labels, languages)


def with_language(
    documents: DataFrame, network: Network | None, text: str = "text", into: tuple[str, str] = ("lang_pred", "lang_score")
) -> DataFrame:
    """All columns of the documents, with the language and its score for each whole text.

    Columns of the names in ``into`` are replaced.
    """
    pred, value = into
    rest = documents.drop(*into)
    if network is None:
        return rest.withColumn(pred, F.lit(UNDETERMINED)).withColumn(value, F.lit(0.0))
    where = rest.columns.index(text)
    schema = T.StructType([*rest.schema.fields]).add(pred, "string").add(value, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(network)
        for batch in batches:
            names, scores, at = [], [], 0
            for part in _some_texts(batch.column(where)):
                blocks = [windows_of(x) for x in part]
                first = np.cumsum([0, *(len(b) for b in blocks[:-1])])
                found = reader.probabilities(np.concatenate(blocks))
                mean = np.add.reduceat(found, first, axis=0) / np.array([[len(b)] for b in blocks])
                best = mean.argmax(axis=1)
                names += [network.languages[i] for i in best]
                scores += np.clip(mean[np.arange(len(best)), best], 0, 1).astype(float).tolist()
                at += len(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    scored = rest.mapInArrow(run, schema)
    known = lettered(F.col(text))
    return scored.withColumn(pred, F.when(known, F.col(pred)).otherwise(UNDETERMINED)).withColumn(
        value, F.when(known, F.col(value)).otherwise(0.0)
    )


def _some_texts(column: pa.Array) -> Iterator[list[bytes]]:
    part, size = [], 0
    for value in column:
        text = (value.as_py() or "").encode()
        part.append(text)
        size += len(text) + WINDOW
        if size >= AT_ONCE * WINDOW * 8:
            yield part
            part, size = [], 0
    if part:
        yield part


def identify(documents: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id") -> DataFrame:
    """Per document: id, ``held_out``, ``lang_pred`` and ``score``, learned from the table itself."""
    network = learn(documents, text, lang, id_column)
    scored = with_language(documents.select(id_column, text), network, text)
    held = F.coalesce(crc32_of(F.col(id_column)) % 3 == 1, F.lit(False))
    return scored.select(id_column, held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def keep_identified(documents: DataFrame, least: float = 0.35, text: str = "text", lang: str = "lang", id_column: str = "doc_id") -> DataFrame:
    """The documents that have a language, by a probability of at least ``least``."""
    scored = with_language(documents, learn(documents, text, lang, id_column), text, ("pred__", "score__"))
    return scored.filter((F.col("pred__") != UNDETERMINED) & (F.col("score__") >= least)).select(*documents.columns)

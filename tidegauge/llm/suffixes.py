"""Repeated passages by a sparse suffix array over content-selected positions.

A passage of ``min_words`` words is a repeat if it occurs at two places, in one document
or in two. Words are runs without ASCII white space, compared byte by byte.

1. Of all suffixes of all texts only those at minimiser positions are retained: of each
   run of ``gap`` positions the one whose next few words have the least fingerprint. What
   is selected depends on the words alone, so equal passages retain equal suffixes, and
   every window of ``min_words`` words retains one with at least ``min_words - gap + 1``
   of its words to the right.
2. The retained suffixes are sorted by a fingerprint of these words, over the whole
   cluster, and each is compared with its neighbours. Ties are sorted by document and
   position, so a passage in a third of all documents is spread over many tasks; the few
   rows at the edges of sorted partitions are compared afterwards.
3. Suffixes that agree with a neighbour are extended to both sides: every window of
   ``min_words`` words that retains one of them is compared, by its fingerprint, with all
   others; each task first keeps the least and the greatest place of a fingerprint. A word
   belongs to a repeat if some window over it occurs twice. This is exact up to collisions
   of 64-bit fingerprints.

Defined results: null and empty texts and texts under ``min_words`` words have no repeats;
rows equal in id and text are one document; the first place of a passage is the one with
the least id, then fingerprint of the text, then position; null ids come last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import numbered, stored
from tidegauge.llm.words import minimiser_of, window_hashes, word_bounds, word_hashes

MIN_WORDS = 50
# One of every ``GAP`` suffixes in a row is retained, by the fingerprint of ``SEED_WORDS`` words.
GAP = 32
SEED_WORDS = 6
PLACE = ("id_rank", "doc_id", "doc_hash")
# Bits of a place that number the word; the others number the document.
WORD_BITS = 28


def _words(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    return word_hashes(data, *word_bounds(data))


def _place(id_column: str, text: str) -> list[Column]:
    """What tells documents apart, in the order of first places."""
    return [
        F.col(id_column).isNull().alias("id_rank"),
        F.col(id_column).cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("doc_hash"),
    ]


def _seeds(words: np.ndarray, min_words: int, gap: int) -> np.ndarray:
    """For each window of a text the position of the suffix that it retains."""
    reach = min_words - gap + 1
    if len(words) < min_words:
        return np.empty(0, np.int64)
    return minimiser_of(window_hashes(words, min(SEED_WORDS, reach))[: len(words) - reach + 1], gap)


def retained(words: np.ndarray, min_words: int = MIN_WORDS, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the retained suffixes of one text, and fingerprints of their next words."""
    at = np.unique(_seeds(words, min_words, gap))
    return at, window_hashes(words, min_words - gap + 1)[at] if len(at) else np.empty(0, np.uint64)


def _suffixes(texts: DataFrame, min_words: int, gap: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [retained(_words(value.as_py().encode()), min_words, gap) for value in batch.column(1)]
            if not found:
                continue
            of = np.repeat(np.arange(len(found)), [len(at) for at, _ in found])
            at = np.concatenate([at for at, _ in found]).astype(np.int32)
            keys = np.concatenate([keys for _, keys in found]).view(np.int64)
            columns = [batch.column(0).take(pa.array(of)), pa.array(at), pa.array(keys)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_key", "position", "suffix"])

    return texts.select("doc_key", "text").mapInArrow(run, "doc_key long, position int, suffix long")


def _agreeing(suffixes: DataFrame) -> DataFrame:
    """Suffixes equal to a neighbour in the sorted order of the whole cluster.

    Each sorted partition also returns its first and its last suffix, marked, since their
    neighbours lie in other partitions.
    """
    ordered = suffixes.repartitionByRange("suffix", "doc_key", "position").sortWithinPartitions("suffix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far and whether it agrees with the one before
        begun = False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held[0], batch]).combine_chunks().to_batches()[0]
            keys = rows.column(2).to_numpy()
            equal = keys[1:] == keys[:-1]
            agrees = np.r_[held is not None and held[1], equal] | np.r_[equal, False]
            edge = np.zeros(len(keys), bool)
            edge[0], begun = not begun, True
            last = len(keys) - 1
            yield marked(rows.slice(0, last), agrees[:last], edge[:last])
            held = (rows.slice(last), bool(agrees[last]))
            if edge[last]:
                yield marked(held[0], np.array([False]), np.array([True]))
        if held is not None:
            yield marked(held[0], np.array([held[1]]), np.array([True]))

    def marked(rows: pa.RecordBatch, agrees: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        columns = [*rows.columns, pa.array(agrees), pa.array(edge)]
        names = ["doc_key", "position", "suffix", "agrees", "edge"]
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(agrees | edge))

    schema = "doc_key long, position int, suffix long, agrees boolean, edge boolean"
    found = stored(ordered.mapInArrow(run, schema), "suffix-neighbours")
    # Of the edges, at most two rows for each partition, those with the suffix of another one.
    edges = found.filter("edge").select("suffix", "doc_key", "position").distinct()
    shared = edges.groupBy("suffix").count().filter("count > 1").select("suffix")
    late = found.filter("edge and not agrees").join(shared, "suffix", "left_semi")
    columns = ["doc_key", "position"]
    return found.filter("agrees").select(columns).union(late.select(columns))


def extended_windows(words: np.ndarray, positions: np.ndarray, min_words: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that retain a suffix at one of the positions, and their fingerprints."""
    starts = np.flatnonzero(np.isin(_seeds(words, min_words, gap), positions))
    return starts, window_hashes(words, min_words)[starts]


def _windows(texts: DataFrame, min_words: int, gap: int) -> DataFrame:
    """Rows (place, window), and for each document one row with its number and all starts."""
    schema = "place long, window long, doc_no long, starts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text, positions in zip(*batch.columns):
                starts, keys = extended_windows(_words(text.as_py().encode()), positions.values.to_numpy(), min_words, gap)
                place = (number.as_py() << WORD_BITS) + starts
                size = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(place), pa.nulls(1, pa.int64())]),
                        pa.concat_arrays([pa.array(keys.view(np.int64)), pa.nulls(1, pa.int64())]),
                        pa.concat_arrays([pa.nulls(size, pa.int64()), pa.array([number.as_py()], pa.int64())]),
                        pa.concat_arrays([pa.nulls(size, pa.list_(pa.int32())), pa.array([starts.astype(np.int32)], pa.list_(pa.int32()))]),
                    ],
                    names=["place", "window", "doc_no", "starts"],
                )

    return texts.select("doc_no", "text", "positions").mapInArrow(run, schema)


def repeated_windows(documents: DataFrame, text: str = "text", id_column: str = "doc_id", min_words: int = MIN_WORDS, gap: int = GAP) -> DataFrame:
    """Documents (by ``PLACE``) with the starts of their repeated windows, ``repeated``, and of
    those among them that are first places, ``firsts``."""
    if not 1 <= gap <= min_words:
        raise ValueError("gap must lie between 1 and min_words")
    value = F.col(text).cast("string")
    texts = documents.filter(F.col(text).isNotNull()).select(
        *_place(id_column, text), F.xxhash64(id_column, value).alias("doc_key"), value.alias("text")
    )
    suffixes = stored(_suffixes(texts, min_words, gap), "suffixes")
    # A document's own words bound the list.
    listed = _agreeing(suffixes).groupBy("doc_key").agg(F.sort_array(F.collect_set("position")).alias("positions"))
    listed = stored(listed, "suffix-documents")
    found = texts.select(*PLACE, "doc_key").join(listed.select("doc_key"), "doc_key", "left_semi").distinct()
    named = numbered(found, [*PLACE], "doc_no", "suffix-numbers")
    lists = named.join(listed, "doc_key").select(*(F.col(c).alias(f"{c}__") for c in ("doc_key", *PLACE)), "doc_no", "positions")
    same = (F.col("doc_key") == F.col("doc_key__")) & (F.col("doc_hash") == F.col("doc_hash__")) & F.col("doc_id").eqNullSafe(F.col("doc_id__"))
    windows = stored(_windows(texts.join(lists, same), min_words, gap), "suffix-windows")
    groups = windows.filter("window is not null").groupBy("window").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    position = F.col("first").bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int")
    firsts = groups.groupBy(F.shiftright("first", WORD_BITS).alias("doc_no")).agg(
        F.collect_list(F.when(F.col("first") < F.col("last"), position)).alias("firsts"),
        F.collect_list(F.when(F.col("first") == F.col("last"), position)).alias("lone"),
    )
    own = windows.filter("doc_no is not null").select("doc_no", "starts").dropDuplicates(["doc_no"])
    empty = F.array().cast("array<int>")
    judged = own.join(firsts, "doc_no", "left").select(
        "doc_no",
        F.array_sort(F.array_except("starts", F.coalesce("lone", empty))).alias("repeated"),
        F.array_sort(F.coalesce("firsts", empty)).alias("firsts"),
    )
    return named.join(judged.filter(F.size("repeated") > 0), "doc_no").select(*PLACE, "repeated", "firsts")


def spans(starts: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Word ranges that sorted window starts cover; ranges that touch are one."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > min_words)
    first = starts[np.r_[0, breaks + 1]]
    last = starts[np.r_[breaks, len(starts) - 1]] + min_words
    return list(zip(first.tolist(), last.tolist()))


def repeated_passages(documents: DataFrame, text: str = "text", id_column: str = "doc_id", min_words: int = MIN_WORDS, gap: int = GAP) -> DataFrame:
    """One row for each passage of a document that also occurs elsewhere.

    ``first_word`` and ``last_word`` number the words from zero, ends included; ``n_words`` is
    the passage's length; ``has_first`` tells whether all of its words are in first places.
    """
    rows = repeated_windows(documents, text, id_column, min_words, gap)
    schema = "doc_id long, first_word int, last_word int, n_words int, has_first boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, *lists in zip(*batch.columns):
                doc = doc.as_py()
                starts, own = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
                for low, high in spans(starts, min_words):
                    inside = int(((starts >= low) & (starts < high)).sum())
                    ours = int(((own >= low) & (own < high)).sum())
                    out.append((doc, low, high - 1, high - low, inside == ours))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "first_word", "last_word", "n_words", "has_first"])

    return rows.select("doc_id", "repeated", "firsts").mapInArrow(run, schema)


def cut_text(text: str, starts: np.ndarray, firsts: np.ndarray, min_words: int) -> str:
    """The text without the words of repeated windows that are no first place.

    A word goes if any such window covers it, even where a first window covers it too: its
    own first place lies earlier. Where a window overlaps the one before with the same words
    (a loop), only what it adds at its end goes, so that the first place of a loop stays whole.
    White space behind a removed word goes with it.
    """
    data = text.encode()
    begin, end = word_bounds(np.frombuffer(data, np.uint8))
    late = np.setdiff1d(starts, firsts)
    keys = window_hashes(word_hashes(np.frombuffer(data, np.uint8), begin, end), min_words)
    places = np.union1d(starts, firsts)
    order = places[np.lexsort((places, keys[places]))]
    loops = order[1:][(keys[order[1:]] == keys[order[:-1]]) & (np.diff(order) < min_words)]
    drop = np.zeros(len(begin) + 1, np.int64)
    np.add.at(drop, np.where(np.isin(late, loops), late + min_words - 1, late), 1)
    np.add.at(drop, late + min_words, -1)
    gone = np.cumsum(drop)[:-1] > 0
    if not gone.any():
        return text
    following = np.r_[begin[1:], len(data)]
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    for first, last in zip(edges[::2], edges[1::2]):
        out.append(data[at : begin[first]])
        at = int(following[last - 1])
    out.append(data[at:])
    return b"".join(out).decode().rstrip(" \t\n\v\f\r")


def without_repeats(documents: DataFrame, text: str = "text", id_column: str = "doc_id", min_words: int = MIN_WORDS, gap: int = GAP) -> DataFrame:
    """The documents, each repeated passage left only at its first place.

    Passages are those of the texts as they come in: what stands before and behind a cut meets
    there, and words across such a seam are not looked at again. All columns stay; ``text`` is cut. A document of which nothing is left goes; one that
    had no words before stays.
    """
    found = stored(repeated_windows(documents, text, id_column, min_words, gap), "repeats")
    by_place = found.select(*(F.col(c).alias(f"repeat__{c}") for c in found.columns))
    rank, key, digest = _place(id_column, text)
    condition = (
        (rank == F.col("repeat__id_rank")) & (digest == F.col("repeat__doc_hash")) & key.eqNullSafe(F.col("repeat__doc_id"))
    )
    joined = documents.join(by_place, condition, "left").drop(*(f"repeat__{c}" for c in PLACE))
    names = documents.columns
    where = names.index(text)
    schema = T.StructType([*documents.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_, own = batch.column(len(names)), batch.column(len(names) + 1)
            texts, stays = [], []
            for i, value in enumerate(batch.column(where)):
                before = value.as_py()
                after = before
                if all_[i].is_valid and before is not None:
                    after = cut_text(before, *(x[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for x in (all_, own)), min_words)
                texts.append(after)
                stays.append(after is before or bool(after))
            columns = [pa.array(texts, batch.schema.field(where).type) if k == where else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stays))

    return joined.select(*names, "repeat__repeated", "repeat__firsts").mapInArrow(run, schema)

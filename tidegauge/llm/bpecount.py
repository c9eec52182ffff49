"""Token counts by rank-synchronous merging of ragged arrays.

All distinct pre-tokens of a batch lie in one array of symbols. In each round every
pre-token finds the lowest rank among its neighbouring pairs and merges all places
of that pair at once; a pre-token without a pair in the merge table is done, and the
symbols it has left are its tokens. The tokenizer's file is only read for its table.

Defined results: a null text counts as empty and has no tokens; a special string
inside a text is one token, as the file declares it; repeated rows are counted each;
other columns are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.bpecodec import byte_characters
from tidegauge.llm.pieces import cut, memo_of, slices, valued

NO_RANK = np.int32(2**31 - 1)
# Marks that are neither white space, letters nor numbers and form one match behind a word.
MARKS = ".,!?;:#$%&*"
# Bytes of pre-tokens merged together.
MERGED_BYTES = 1_000_000


class Merges:
    """The merge table of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, pre = content["model"], content["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or content["normalizer"]:
            raise ValueError("only plain byte-level BPE files are counted here")
        vocabulary = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(vocabulary.values()) + 1
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.byte_ids = np.array([vocabulary[c] for c in byte_characters()], np.int32)
        special = [x["content"] for x in content["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)


@lru_cache(2)
def merges_of(path: str) -> Merges:
    return Merges(path)


def merged_counts(tokens: list[bytes], table: Merges) -> np.ndarray:
    """How many symbols each byte string has left after all merges."""
    counts = np.zeros(len(tokens), np.int64)
    lengths = np.array([len(x) for x in tokens], np.int64)
    symbols = table.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
    owner = np.repeat(np.arange(len(tokens)), lengths)
    while len(symbols):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        inside = np.r_[owner[1:] == owner[:-1], False]
        rank = np.full(len(symbols), NO_RANK, np.int32)
        at = np.flatnonzero(inside)
        rank[at] = table.rank(symbols[at], symbols[at + 1])
        lowest = np.minimum.reduceat(rank, first)
        sizes = np.diff(np.r_[first, len(symbols)])
        done = lowest == NO_RANK
        counts[owner[first[done]]] = sizes[done]
        lowest = np.repeat(lowest, sizes)
        chosen = (rank == lowest) & (rank != NO_RANK)
        # Of overlapping places of one pair, every second counts, from the left.
        places = np.flatnonzero(chosen)
        run = np.r_[True, np.diff(places) > 1]
        since = np.arange(len(places)) - np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
        places = places[since % 2 == 0]
        symbols[places] = table.made[rank[places]]
        stays = np.repeat(~done, sizes)
        stays[places + 1] = False
        symbols, owner = symbols[stays], owner[stays]
    return counts


def pre_tokens(piece: str, pattern: regex.Pattern) -> list[str]:
    """The pattern's matches; words of letters with plain marks behind need no pattern."""
    stem = piece.rstrip(MARKS)
    if stem[1:].isalpha() and stem[0] == " ":
        return [stem] if len(stem) == len(piece) else [stem, piece[len(stem) :]]
    return pattern.findall(piece)


def piece_counts(pieces: list[str], table: Merges, pattern: regex.Pattern) -> list[int]:
    """Tokens of each piece: the sum over its matches of the pattern."""
    found = [pre_tokens(piece, pattern) for piece in pieces]
    distinct = list(set().union(*found))
    words = [word.encode() for word in distinct]
    counts = np.zeros(len(words), np.int64)
    ends = np.cumsum([0, *map(len, words)])
    first = 0
    while first < len(words):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + MERGED_BYTES)))
        counts[first:last] = merged_counts(words[first:last], table)
        first = last
    of = dict(zip(distinct, counts.tolist()))
    return [sum(map(of.__getitem__, words)) for words in found]


def count_tokens(
    documents: DataFrame,
    tokenizer: str,
    limit: int = 1024,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """``n_bytes``, ``n_tokens`` and ``over_limit`` of every whole text, with the kept columns."""
    names = [*keep]
    schema = T.StructType([documents.schema[name] for name in names])
    schema = schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, memo, matches = merges_of(tokenizer), memo_of(tokenizer, pattern), regex.compile(pattern)

        def work(pieces: list[str]) -> list[int]:
            return piece_counts(pieces, table, matches)

        for batch in batches:
            at = 0
            for part in slices(batch.column(len(names))):
                columns = [batch.column(i).slice(at, len(part)) for i in range(len(names))]
                at += len(part)
                # A special string is a token; what stands between them is text by itself.
                spans = [table.special.split(x) if table.special else [x] for x in part]
                owner = np.repeat(np.arange(len(part)), [len(x) for x in spans])
                found = valued([cut(span) for own in spans for span in own], memo, work)
                tokens = np.array([head + sum(rest) for head, rest in found], np.int64)
                totals = np.bincount(owner, tokens, len(part)).astype(np.int64)
                totals += np.array([len(x) - 1 for x in spans])
                columns.append(pa.array([len(x.encode()) for x in part], pa.int64()))
                columns.append(pa.array(totals))
                columns.append(pa.array(totals > limit))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return documents.select(*names, F.col(text).cast("string").alias("text_")).mapInArrow(run, schema)

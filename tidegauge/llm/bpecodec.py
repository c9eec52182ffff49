"""Byte-level BPE: texts to token ids by a rank file, and ids back to bytes.

The merges run in the ``tokenizers`` library, batch by batch of Arrow columns. Its
model is set up from the rank file: bytes are written as the printable characters
that byte-level vocabularies use, a token's merges are all pairs of tokens that make
it up, in the order of the ranks, and a match that is a token itself is taken whole.

Defined results: a null text counts as empty; an empty text has no ids; ids that the
rank file lacks, and null ids, make ``decode`` fail with a clear error; repeated rows
are encoded each; columns other than the kept ones are not looked at.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.pieces import cut, memo_of, slices, valued


@lru_cache(1)
def byte_characters() -> str:
    """The character that stands for each byte: itself where printable, else from 256 up."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return "".join(chr(b) if b in printable else chr(next(others)) for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def written(token: bytes) -> str:
    return token.decode("latin-1").translate(dict(enumerate(byte_characters())))


@lru_cache(2)
def tokenizer_of(path: str, pattern: str):
    """The library's tokenizer for a rank file."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda item: item[1]):
        for at in range(1, len(token)):
            if token[:at] in ranks and token[at:] in ranks:
                merges.append((written(token[:at]), written(token[at:])))
    model = models.BPE(
        vocab={written(token): rank for token, rank in ranks.items()},
        merges=merges,
        ignore_merges=True,
    )
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return tokenizer


def _single_threaded() -> None:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def encode(
    documents: DataFrame,
    ranks: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    pattern: str = public_tokenizers.PATTERN,
    offsets: bool = False,
    decoded: bool = False,
) -> DataFrame:
    """Token ids of every whole text, with the kept columns.

    Each match of ``pattern`` is encoded separately; special strings are ordinary text.
    ``offsets`` adds ``starts`` and ``ends``, the characters of the text that a token
    covers (a token that holds only part of a character covers the whole of it).
    ``decoded`` adds what ``decode`` makes of the ids, without another way to Python.
    """
    names = [*keep]
    schema = T.StructType([documents.schema[name] for name in names])
    schema = schema.add("ids", T.ArrayType(T.IntegerType(), False))
    if offsets:
        for name in ("starts", "ends"):
            schema = schema.add(name, T.ArrayType(T.IntegerType(), False))
    if decoded:
        schema = schema.add("decoded", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _single_threaded()
        tokenizer, memo = tokenizer_of(ranks, pattern), memo_of(ranks, pattern, offsets)

        def plain(pieces: list[str]) -> list[bytes]:
            found = tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
            return [array("i", e.ids).tobytes() for e in found]

        def spanned(pieces: list[str]) -> list[tuple[bytes, bytes, int]]:
            found = tokenizer.encode_batch(pieces, add_special_tokens=False)
            return [
                (array("i", e.ids).tobytes(), np.array(e.offsets, np.int32).tobytes(), len(piece))
                for e, piece in zip(found, pieces)
            ]

        for batch in batches:
            at = 0
            for part in slices(batch.column(len(names))):
                columns = [batch.column(i).slice(at, len(part)) for i in range(len(names))]
                at += len(part)
                found = valued([cut(x) for x in part], memo, spanned if offsets else plain)
                if offsets:
                    joined = [_with_offsets([head, *rest]) for head, rest in found]
                else:
                    joined = [(b"".join([head, *rest]),) for head, rest in found]
                columns += [_lists([x[i] for x in joined], 4) for i in range(len(joined[0]))]
                if decoded:
                    out = [bytes_of(np.frombuffer(x[0], np.int32), ranks) for x in joined]
                    columns.append(pa.array(out, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return documents.select(*names, F.col(text).cast("string").alias("text_")).mapInArrow(run, schema)


def _with_offsets(pieces: list[tuple[bytes, bytes, int]]) -> tuple[bytes, bytes, bytes]:
    start, starts, ends = 0, [], []
    for _, spans, length in pieces:
        both = np.frombuffer(spans, np.int32).reshape(-1, 2) + start
        starts.append(both[:, 0].tobytes())
        ends.append(both[:, 1].tobytes())
        start += length
    return b"".join(x[0] for x in pieces), b"".join(starts), b"".join(ends)


def _lists(values: list[bytes], width: int) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // width for x in values)], dtype=np.int64).astype(np.int32)
    flat = np.frombuffer(b"".join(values), np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


@lru_cache(2)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens in a row, and where each token starts and how long it is.

    Taken from the vocabulary as the library holds it, by reversing the byte characters.
    """
    byte_of = {character: byte for byte, character in enumerate(byte_characters())}
    vocabulary = {written(token): rank for token, rank in read_ranks(path).items()}
    lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
    tokens = [b""] * len(lengths)
    for characters, token in vocabulary.items():
        tokens[token] = bytes(map(byte_of.__getitem__, characters))
        lengths[token] = len(characters)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


def bytes_of(ids: np.ndarray, path: str) -> bytes:
    """The bytes that ids stand for."""
    flat, start, length = byte_table(path)
    if len(ids) and (ids.min() < 0 or ids.max() >= len(length) or not length[ids].all()):
        raise ValueError("an id is not in the vocabulary")
    sizes = length[ids]
    shift = start[ids] - (np.cumsum(sizes) - sizes)
    return flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))].tobytes()


def decode(
    encoded: DataFrame, ranks: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Bytes of every list of ids as ``decoded``, with the kept columns.

    The bytes of a whole list are put together before anything reads them as text, so
    a character that two or more tokens share comes out whole; ``as_text`` turns
    bytes that are no UTF-8 into replacement characters.
    """
    names = [*keep]
    schema = T.StructType([encoded.schema[name] for name in names]).add("decoded", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _single_threaded()
        for batch in batches:
            lists = batch.column(len(names))
            if lists.values.null_count:
                raise ValueError("an id is null")
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for first in range(0, len(lists), 500):
                last = min(first + 500, len(lists))
                out = [bytes_of(values[ends[i] : ends[i + 1]], ranks) for i in range(first, last)]
                columns = [batch.column(i).slice(first, last - first) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(out, pa.binary())], names=schema.names
                )

    full = F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>"))
    return encoded.select(*names, full.alias("ids_")).mapInArrow(run, schema)


def as_text(decoded: bytes) -> str:
    return decoded.decode("utf-8", errors="replace")

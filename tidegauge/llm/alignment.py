"""Cross-tokenizer alignment with pair counts kept in sorted, compressed runs.

Every text is encoded by a byte-level tokenizer file (A) and a sentencepiece model (B).
Places where tokens of both end cut the text into groups; the two tokens that end there
are linked. A task gathers the links of its texts up to a bound and then spills them:
pair-document records are dealt over radix parts of B's id, sorted by B's id, A's id and
document, and every part becomes one run of zstd. Runs lie in the shared folder, as rows
of a table. A part's runs are merged by a k-way heap that reads block by block and counts
each pair; as pairs come ordered by their B side, the highest count of a B id is known
where its pairs end. The runs are then streamed once more against these counts, and each
gives its documents what they get: the sum of their links' counts and the links whose
count is the highest. A part with many runs is dealt over salts, so a B id that holds most
of all links bounds no task; only sums of pairs, not of documents, meet at one place.

Texts are cut where neither tokenizer can merge: before a space between non-spaces, as
A starts no token behind such a space and no piece of B holds a space behind another
character (checked when the model is read). Pieces are worked out once per worker, with
bounded memory; results are those of whole texts.

Defined results: a text that is null or empty, or whose tokens of A or B do not give
back a space and the text, has no tokens: all numbers are 0 and ``groups`` is empty.
Special strings inside texts are plain text. Repeated rows and rows without id are
documents of their own. Ties of the highest count are all best. An empty table gives
no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.bpecodec import byte_characters
from tidegauge.llm.common import stored
from tidegauge.llm.pieces import slices

# Radix parts of the B side, links a task holds before it spills, entries read at a time,
# and compressed bytes merged by one task.
PARTS = 16
RUN_LINKS = 2_000_000
BLOCK = 4096
GROUP_BYTES = 32_000_000
# Pieces, and their characters, that a worker keeps in mind.
KEPT_PIECES = 200_000
KEPT_CHARS = 8_000_000

_LOOSE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r"(?<! )(?= \S)")


def cut(text: str) -> list[str]:
    """The pieces of a space and the text, each without its leading space."""
    if not text:
        return []
    if _LOOSE.search(text) or text[0].isspace():
        return [piece[1:] for piece in _CUT.split(" " + text) if piece]
    return text.split(" ")


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        with open(a_path, encoding="utf-8") as file:
            content = json.load(file)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        if content["normalizer"] or content["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("only plain byte-level files can be cut into pieces")
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, number in content["model"]["vocab"].items():
            self.a_bytes[number] = bytes(map(byte_of.__getitem__, token)) if set(token) <= byte_of.keys() else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", piece) for piece in pieces):
            raise ValueError("a piece goes on over a space: texts cannot be cut before one")
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(pieces)
        ]

    def encoded(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = self.a.encode_batch_fast([" " + piece for piece in pieces], add_special_tokens=False)
        return [e.ids for e in a], self.b.encode(pieces, num_threads=1)


@lru_cache(1)
def tokenizers_of(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def _whole(number: Column, by: int) -> Column:
    """Integer division of longs; pair keys are far below what a double holds exactly."""
    return ((number - number % by) / by).cast("long")


class Sides:
    """Pair keys: B's ids dealt over parts, then B's id, then A's."""

    def __init__(self, n_a: int, n_b: int, parts: int) -> None:
        self.n_a, self.parts, self.width = n_a, parts, -(-n_b // parts)
        self.row_bits = 63 - (n_a * self.width * parts).bit_length()

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((b % self.parts) * self.width + b // self.parts) * self.n_a + a

    def part(self, pair):
        return pair // (self.n_a * self.width)

    def ids(self, pair: Column) -> tuple[Column, Column]:
        """A's and B's id of a pair column."""
        side = _whole(pair, self.n_a)
        b = (side % self.width) * self.parts + _whole(side, self.width)
        return (pair % self.n_a).cast("int"), b.cast("int")


class Pieces:
    """What is known of pieces: token numbers, groups as text, and links, in growing arrays."""

    def __init__(self, both: Tokenizers, sides: Sides) -> None:
        self.both, self.sides = both, sides
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.chars = 0
        # Columns: tokens of A, tokens of B, groups, whether bytes differ.
        self.numbers = np.zeros((0, 4), np.int64)
        self.first = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)

    def learn(self, pieces: list[str]) -> None:
        a, b = self.both.encoded(pieces)
        a_bytes, b_bytes = self.both.a_bytes, self.both.b_bytes
        whole = [
            b"".join(map(a_bytes.__getitem__, x)) == b"".join(map(b_bytes.__getitem__, y)) == b" " + piece.encode()
            for piece, x, y in zip(pieces, a, b)
        ]
        a = [x if fits else [] for x, fits in zip(a, whole)]
        b = [y if fits else [] for y, fits in zip(b, whole)]
        flat_a, flat_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        # The pieces stand in a row; tokens end together where both rows of ends agree.
        ends_a = np.cumsum([len(a_bytes[i]) for i in flat_a], dtype=np.int64)
        ends_b = np.cumsum([len(b_bytes[i]) for i in flat_b], dtype=np.int64)
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        at_a, at_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
        ids_a, ids_b = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        numbers = np.zeros((len(pieces), 4), np.int64)
        numbers[:, 0], numbers[:, 1] = list(map(len, a)), list(map(len, b))
        numbers[:, 3] = ~np.array(whole, bool)
        last = np.searchsorted(at_a, np.cumsum(numbers[:, 0]))
        numbers[:, 2] = np.diff(last, prepend=0)
        text_a, text_b = list(map(str, flat_a)), list(map(str, flat_b))
        written, from_a, from_b = [], 0, 0
        for to_a, to_b in zip((at_a + 1).tolist(), (at_b + 1).tolist()):
            written.append(",".join(text_a[from_a:to_a]) + "|" + ",".join(text_b[from_b:to_b]))
            from_a, from_b = to_a, to_b
        begin = (last - numbers[:, 2]).tolist()
        self.groups += [";".join(written[i:j]).encode() for i, j in zip(begin, last.tolist())]
        known = len(self.index)
        self.index.update(zip(pieces, range(known, known + len(pieces))))
        self.chars += sum(map(len, pieces))
        self.numbers = np.concatenate([self.numbers, numbers])
        self.first = np.concatenate([self.first, np.array(begin, np.int64) + len(self.links)])
        self.links = np.concatenate([self.links, self.sides.pairs(ids_a[at_a], ids_b[at_b])])

    def numbered(self, lists: list[list[str]]) -> list[np.ndarray]:
        """Numbers of the pieces of each text; all pieces are learned first."""
        used = set().union(*lists)
        unknown = used.difference(self.index)
        if len(self.index) + len(unknown) > KEPT_PIECES or self.chars > KEPT_CHARS:
            self.clear()
            unknown = used
        if unknown:
            self.learn(list(unknown))
        number = self.index.__getitem__
        return [np.fromiter(map(number, pieces), np.int64, len(pieces)) for pieces in lists]


@lru_cache(1)
def pieces_of(a_path: str, b_path: str, parts: int) -> Pieces:
    """The worker's memory of pieces, kept from task to task."""
    both = tokenizers_of(a_path, b_path)
    return Pieces(both, Sides(len(both.a_bytes), len(both.b_bytes), parts))


class Aligned:
    """Results of some texts: numbers per text, groups as bytes, links and whose they are."""

    def __init__(self, pieces: Pieces, texts: list[str]) -> None:
        lists = [cut(text) for text in texts]
        found = pieces.numbered(lists)
        differs = [bool(pieces.numbers[x, 3].any()) for x in found]
        kept = [x[:0] if bad else x for x, bad in zip(found, differs)]
        sizes = np.array([len(x) for x in kept], np.int64)
        flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        sums = np.zeros((len(flat) + 1, 3), np.int64)
        np.cumsum(pieces.numbers[flat, :3], axis=0, out=sums[1:])
        self.numbers = sums[ends] - sums[ends - sizes]
        self.groups = [b";".join(map(pieces.groups.__getitem__, x.tolist())) for x in kept]
        count = pieces.numbers[flat, 2]
        shift = pieces.first[flat] - (np.cumsum(count) - count)
        self.links = pieces.links[np.repeat(shift, count) + np.arange(int(count.sum()))]
        self.owner = np.repeat(np.repeat(np.arange(len(kept)), sizes), count)
        # Pieces that differ may still add up to the text: such texts are taken as one piece.
        for i in [i for i, bad in enumerate(differs) if bad]:
            single = Pieces(pieces.both, pieces.sides)
            single.learn([texts[i]])
            self.numbers[i], self.groups[i] = single.numbers[0, :3], single.groups[0]
            self.links = np.concatenate([self.links, single.links])
            self.owner = np.concatenate([self.owner, np.full(len(single.links), i)])


def _compressed(*columns: np.ndarray) -> bytes:
    """Columns side by side, so that a reader may stop anywhere between entries."""
    return zstandard.ZstdCompressor(level=1).compress(np.stack(columns, axis=1).astype("<i8").tobytes())


def _blocks(run: bytes) -> Iterator[np.ndarray]:
    """Entries of a run's column pair, block by block."""
    with zstandard.ZstdDecompressor().stream_reader(run, read_across_frames=True) as reader:
        while block := reader.read(BLOCK * 16):
            while len(block) % 16:
                block += reader.read(16 - len(block) % 16)
            yield np.frombuffer(block, "<i8").reshape(-1, 2)


def runs_of(links: np.ndarray, rows: np.ndarray, sides: Sides) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Sorted runs of links and the rows that hold them: part, links, heads and records.

    Heads are the pairs and how many links each has, records the rows of each pair in
    order and how often they have it; a pair's first record is marked by its sign.
    """
    both = np.sort((links << sides.row_bits) | rows)
    start = np.flatnonzero(np.diff(both, prepend=-1))
    times = np.diff(start, append=len(both))
    record = both[start]
    pair, row = record >> sides.row_bits, record & ((1 << sides.row_bits) - 1)
    head = np.flatnonzero(np.diff(pair, prepend=-1))
    totals = np.add.reduceat(times, head) if len(head) else times
    first = np.zeros(len(pair), bool)
    first[head] = True
    bounds = np.searchsorted(sides.part(pair[head]), np.arange(sides.parts + 1))
    ends = np.append(head, len(pair))
    for part in range(sides.parts):
        low, high = int(bounds[part]), int(bounds[part + 1])
        if low < high:
            own, inside = slice(low, high), slice(int(ends[low]), int(ends[high]))
            records = _compressed(row[inside], np.where(first[inside], -times[inside], times[inside]))
            yield part, int(totals[own].sum()), _compressed(pair[head][own], totals[own]), records


def _entries(run: bytes) -> Iterator[list[int]]:
    for block in _blocks(run):
        yield from map(tuple, block.tolist())


def merge_runs(table: pa.Table) -> pa.Table:
    """Counts of the pairs of some runs, by a heap over the next entry of each."""
    merged = heapq.merge(*(_entries(run.as_py()) for run in table.column("heads")))
    pairs, counts = [], []
    for pair, entries in groupby(merged, key=lambda entry: entry[0]):
        pairs.append(pair)
        counts.append(sum(n for _, n in entries))
    return pa.table({"pair": pa.array(pairs, pa.int64()), "count": pa.array(counts, pa.int64())})


def give_back(runs: pa.Table, counts: pa.Table, n_a: int) -> pa.Table:
    """What each row of the runs gets from their pairs' counts."""
    pair, count = counts.column("pair").to_numpy(), counts.column("count").to_numpy()
    order = np.argsort(pair)
    pair, count = pair[order], count[order]
    side = np.flatnonzero(np.diff(pair // n_a, prepend=-1))
    highest = np.repeat(np.maximum.reduceat(count, side), np.diff(side, append=len(pair))) if len(pair) else count
    is_best = count == highest
    out = {"row": [], "n_best": [], "count_sum": []}
    for base, heads, records in zip(*(runs.column(name) for name in ("base", "heads", "records"))):
        keys = np.concatenate([block[:, 0] for block in _blocks(heads.as_py())])
        place, seen = np.searchsorted(pair, keys), -1
        best = total = np.zeros(0, np.int64)
        for block in _blocks(records.as_py()):
            row, times = block[:, 0], np.abs(block[:, 1])
            which = place[seen + np.cumsum(block[:, 1] < 0)]
            seen += int((block[:, 1] < 0).sum())
            if row.max() >= len(best):
                grown = np.zeros(max(int(row.max()) + 1, 2 * len(best)), np.int64)
                best, total = (np.concatenate([x, grown[len(x) :]]) for x in (best, total))
            np.add.at(best, row, times * is_best[which])
            np.add.at(total, row, times * count[which])
        rows = np.flatnonzero(total)
        out["row"].append(rows + base.as_py())
        out["n_best"].append(best[rows])
        out["count_sum"].append(total[rows])
    flat = {name: np.concatenate(x) if x else np.zeros(0, np.int64) for name, x in out.items()}
    return pa.table({name: pa.array(x, pa.int64()) for name, x in flat.items()})


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def _encoded(documents: DataFrame, a: str, b: str, text: str, keep: list[str], hashed: bool, parts: int) -> DataFrame:
    """Rows of two kinds: documents with their numbers, and runs (``part`` is set)."""
    name = "groups_sha256" if hashed else "groups"
    schema = T.StructType([documents.schema[column] for column in keep]).add("row_", "long")
    for number in NUMBERS:
        schema = schema.add(number, "long")
    schema = schema.add(name, "string").add("part", "integer").add("base", "long").add("links", "long")
    schema = schema.add("heads", "binary").add("records", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces = pieces_of(a, b, parts)
        next_row = base = TaskContext.get().partitionId() << 36
        links: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        held, kinds = 0, None

        def spill() -> Iterator[pa.RecordBatch]:
            for part, n, heads, records in runs_of(np.concatenate(links), np.concatenate(rows) - base, pieces.sides):
                values = {"part": part, "base": base, "links": n, "heads": heads, "records": records}
                columns = [pa.array([values.get(field.name)], field.type) for field in kinds]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            at = 0
            for texts in slices(batch.column(len(keep))):
                own = [batch.column(i).slice(at, len(texts)) for i in range(len(keep))]
                at += len(texts)
                found = Aligned(pieces, texts)
                groups = [hashlib.sha256(x).hexdigest() if x and hashed else x.decode() for x in found.groups]
                mine = np.arange(next_row, next_row + len(texts))
                numbers = [found.numbers[:, 0], found.numbers[:, 1], found.numbers[:, 2]]
                numbers.append(np.bincount(found.owner, minlength=len(texts)))
                columns = [*own, pa.array(mine), *(pa.array(x, pa.int64()) for x in numbers), pa.array(groups, pa.string())]
                if kinds is None:
                    kinds = pa.schema([*((n, c.type) for n, c in zip(schema.names, columns)), ("part", pa.int32())]
                        + [("base", pa.int64()), ("links", pa.int64()), ("heads", pa.binary()), ("records", pa.binary())])
                columns += [pa.nulls(len(texts), kinds.field(i).type) for i in range(len(columns), len(kinds))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                links.append(found.links)
                rows.append(mine[found.owner])
                held, next_row = held + len(found.links), next_row + len(texts)
                if held >= RUN_LINKS:
                    yield from spill()
                    links, rows, held, base = [], [], 0, next_row
        if held:
            yield from spill()

    return documents.select(*keep, F.col(text).cast("string").alias("text_")).mapInArrow(run, schema)


def align(
    documents: DataFrame,
    a: str,
    b: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    hashed: bool = False,
    parts: int = PARTS,
) -> tuple[DataFrame, DataFrame]:
    """Numbers and groups of every text, and the count of every linked pair.

    The first table has the kept columns, ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``n_best``, ``count_sum`` and ``groups`` (``a1,a2|b1;a3|b2``; with ``hashed`` its
    SHA-256 as ``groups_sha256``). The second one has ``a_id``, ``b_id`` and ``count``.
    """
    sizes = tokenizers_of(a, b)
    sides = Sides(len(sizes.a_bytes), len(sizes.b_bytes), parts)
    encoded = stored(_encoded(documents, a, b, text, [*keep], hashed, parts), "alignment-runs")
    runs = encoded.filter("part IS NOT NULL").select("part", "base", "heads", "records")
    # A part's runs are dealt over so many salts that a task holds a bounded number of bytes.
    size = F.sum(F.octet_length("heads") + F.octet_length("records"))
    salts = [1] * parts
    for part, total in runs.groupBy("part").agg(size).collect():
        salts[part] = 1 + total // GROUP_BYTES
    wide = F.element_at(F.lit(salts), F.col("part") + 1)
    salted = runs.withColumn("salt", F.pmod(F.xxhash64("base"), wide).cast("int"))
    merged = salted.select("part", "salt", "heads").groupBy("part", "salt").applyInArrow(merge_runs, "pair long, count long")
    counts = stored(merged.groupBy("pair").agg(F.sum("count").alias("count")), "alignment-counts")
    parted = counts.withColumn("part", _whole(F.col("pair"), sides.n_a * sides.width).cast("int"))
    copies = parted.withColumn("salt", F.explode(F.sequence(F.lit(0), wide - 1)))
    given = salted.groupBy("part", "salt").cogroup(copies.groupBy("part", "salt"))
    given = given.applyInArrow(partial(_given, sides.n_a), "row long, n_best long, count_sum long")
    sums = given.groupBy(F.col("row").alias("row_")).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    groups = "groups_sha256" if hashed else "groups"
    rows = encoded.filter("part IS NULL").select(*keep, "row_", *NUMBERS, groups)
    zero = [F.coalesce(F.col(name), F.lit(0)).alias(name) for name in ("n_best", "count_sum")]
    found = rows.join(sums, "row_", "left").select(*keep, *NUMBERS, *zero, groups)
    a_id, b_id = sides.ids(F.col("pair"))
    return found, counts.select(a_id.alias("a_id"), b_id.alias("b_id"), "count")


def _given(n_a: int, runs: pa.Table, counts: pa.Table) -> pa.Table:
    return give_back(runs, counts, n_a)

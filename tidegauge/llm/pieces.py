"""Cutting text into pieces that byte-level BPE treats one by one.

The pattern of the tokenizers lets a token start with one space and never lets it go
on over a space that a non-space follows. So a text may be cut before each such space
and every piece tokenised by itself; equal pieces are worked out once per task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa

# A space before other white space or at the end belongs to a longer run: no plain split.
_LOOSE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r"(?= \S)")
# Texts worked on at a time, in characters, and pieces a worker keeps in mind.
SLICE_CHARS = 500_000
KEPT_PIECES = 200_000
KEPT_LENGTH = 60


def cut(text: str) -> tuple[str, list[str]]:
    """The first piece, and the others without their leading space."""
    if _LOOSE.search(text):
        head, *rest = _CUT.split(text)
        if not head and rest:  # the cut before a space at the very start
            head, rest = "", rest
        return head, [piece[1:] for piece in rest]
    head, *rest = text.split(" ")
    return head, rest


class Memo(dict):
    """Values of pieces, kept from batch to batch and, by ``memo_of``, from task to task.

    When full it goes back to the pieces of the present slice, which hold the common
    ones, so a worker's memory stays bounded.
    """

    def learn(self, pieces: list[str], values: Iterable, used: set[str]) -> dict:
        """Add the values, and return a mapping that has all used pieces."""
        fresh = dict(zip(pieces, values, strict=True))
        if len(self) + len(fresh) > KEPT_PIECES:
            kept = {k: self[k] for k in used if k in self}
            self.clear()
            self.update(kept)
        if len(self) + len(fresh) > KEPT_PIECES or max(map(len, pieces)) > KEPT_LENGTH:
            whole = dict(self) | fresh
            self.update((k, v) for k, v in fresh.items() if len(k) <= KEPT_LENGTH)
            return whole
        self.update(fresh)
        return self


@lru_cache(4)
def memo_of(*what: object) -> Memo:
    """The worker's memo for one kind of value."""
    return Memo()


def slices(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in order, some at a time; null counts as the empty text."""
    part: list[str] = []
    size = 0
    for value in texts:
        text = value.as_py() or ""
        part.append(text)
        size += len(text)
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def valued(
    cuts: list[tuple[str, list[str]]], memo: Memo, work: Callable[[list[str]], list]
) -> list[tuple[object, list]]:
    """For each text the value of its first piece and those of the others.

    ``work`` gives the values of pieces as they stand in the text. The pieces of all
    texts that are not yet known go to it at once.
    """
    known: dict = memo
    used = set().union(*(rest for _, rest in cuts))
    unknown = list(used.difference(memo))
    ahead = work([head for head, _ in cuts])
    if unknown:
        known = memo.learn(unknown, work([" " + piece for piece in unknown]), used)
    return [(first, list(map(known.__getitem__, rest))) for first, (_, rest) in zip(ahead, cuts)]

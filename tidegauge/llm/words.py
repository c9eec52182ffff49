"""Words of UTF-8 texts and fingerprints of word windows, on whole arrays.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return. Fingerprints are 64-bit polynomial sums, taken for all
windows of a text at once from running sums, and mixed afterwards.
"""

from __future__ import annotations

import numpy as np

# Odd multipliers of the running sums and of the mixing step.
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WEIGHT = np.random.default_rng(20240517).integers(1, 2**63, 256, dtype=np.uint64)


def mix(value: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    value = (value ^ (value >> np.uint64(30))) * MIX_A
    value = (value ^ (value >> np.uint64(27))) * MIX_B
    return value ^ (value >> np.uint64(31))


class Powers:
    """Powers of a base and of its inverse, modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = int(base), pow(int(base), -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """At least ``n`` powers upwards and downwards from one."""
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, size, 2**64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, size, 2**64))])
        return self.up, self.down


_BYTES, _WORDS = Powers(BYTE_BASE), Powers(WORD_BASE)
# Powers beyond this are not kept between texts.
_SECTION = 1 << 20


def word_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends, in bytes."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~_SPACE[text]
    edge = np.flatnonzero(np.diff(inside))
    return edge[::2], edge[1::2]


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word's bytes."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        # Sections of whole words, so that one long text needs no long tables.
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _SECTION, "right")))
        low, high = int(starts[first]), int(ends[last - 1])
        up, down = _BYTES.of(high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_WEIGHT[text[low:high]] * up[: high - low], out=sums[1:])
        begin, end = starts[first:last] - low, ends[first:last] - low
        out[first:last] = mix((sums[end] - sums[begin]) * down[begin])
        first = last
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A fingerprint of every run of ``size`` words; empty if there are fewer."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    up, down = _WORDS.of(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[:count] + np.uint64(size))


def minimiser_of(keys: np.ndarray, window: int) -> np.ndarray:
    """For each ``window`` keys in a row the position of the least (the first such)."""
    if len(keys) < window:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(keys, window)
    step = 1 << 15  # bounds the working copies of a long text
    found = [views[i : i + step].argmin(axis=1) for i in range(0, len(views), step)]
    return np.concatenate(found) + np.arange(len(views))

"""Vectorised words and word n-grams: all texts of a slice at once, on their UTF-8 bytes, as 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lexivec.llm import common

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
GOLD = np.uint64(0xBF58476D1CE4E5B9)
SILVER = np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * GOLD
    h = (h ^ (h >> np.uint64(27))) * SILVER
    return h ^ (h >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)

_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; kept up to a few MB, beyond that made anew."""
    if len(_POWERS["up"]) >= n:
        return _POWERS["up"][:n], _POWERS["down"][:n]
    up, down = np.full(n, BASE), np.full(n, INVERSE)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    if n <= 4 * common.SLICE_BYTES:
        _POWERS.update(up=up, down=down)
    return up, down


class Rolling:
    """Hashes of any byte ranges of one array in O(1) each, by differences of prefix sums."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUES):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """Of every range of `width` bytes, by its start."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)


def folded_values() -> np.ndarray:
    """A byte's value with A-Z taken as a-z."""
    values = BYTE_VALUES.copy()
    values[65:91] = BYTE_VALUES[97:123]
    return values


FOLDED = folded_values()


@dataclass
class Words:
    """hashes: of each word, in order; first: the index of each text's first word, and the number of words at the end."""

    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the k words from each word on, and whether they lie in one text."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(n, np.uint64), np.zeros(n, bool)
        h = np.zeros(n - k + 1, np.uint64)
        for t in range(k):
            h = h * SILVER + self.hashes[t : n - k + 1 + t]
        out, inside = np.zeros(n, np.uint64), np.zeros(n, bool)
        out[: n - k + 1] = mix(h)
        inside[: n - k + 1] = True
        for t in range(1, k):  # the last k - 1 words of a text begin no gram
            at = self.first[1:] - t
            inside[at[at >= self.first[:-1]]] = False
        return out, inside


def split(column: pa.Array, is_word: np.ndarray) -> Words:
    """Words are the maximal runs of bytes for which is_word holds; A-Z count as a-z. No word reaches over two texts."""
    data, offsets = common.raw_bytes(column)
    if not len(data):
        return Words(np.empty(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = is_word[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = offsets[:-1]
    before[edges[edges < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends_at = offsets[1:] - 1
    after[ends_at[ends_at >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(Rolling(data, FOLDED).ranges(starts, ends), np.searchsorted(starts, offsets))


def table(ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Everything but ASCII white space.
NOT_SPACE = ~table([(0x20, 0x20), (0x09, 0x0D)])
#: Digits, letters and all that is not ASCII.
ALPHANUMERIC = table([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])

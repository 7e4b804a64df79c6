"""Words of a whole Arrow batch of texts as arrays: bounds, hashes, and the words of each text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are hashed at once; longer words are hashed by themselves.
BLOCK = 1 << 18
LONG_WORD = 1 << 12
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A-Z to X, a-z and bytes of other letters to x, digits to 9; signs stay.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = ord("X"), ord("x"), ord("9"), ord("x")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit hashes that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        n = BLOCK + LONG_WORD + 1
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.cumprod(table)
    return _POWERS["up"], _POWERS["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each text begins and the last ends; null is empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes together, or of one text."""
    _, at = utf8(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """first: of each text, the index of its first word, and at the end the number of words."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def texts(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word's bytes, of A-Z lower-cased."""
        return self._hashed(_LOWER if lower else np.arange(256, dtype=np.uint8), False)

    def shapes(self) -> np.ndarray:
        """A 64-bit hash of each word's shape: kinds of characters, of which runs count once, and signs."""
        return self._hashed(_SHAPE, True)

    def _hashed(self, table: np.ndarray, runs: bool) -> np.ndarray:
        up, down = _powers()
        out, lo, n = np.empty(len(self.starts), np.uint64), 0, len(self.starts)
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.starts[lo] + BLOCK, "right")))
            s, e = self.starts[lo:hi], self.ends[lo:hi]
            if hi == lo + 1 and e[0] - s[0] > LONG_WORD:
                out[lo] = xxhash.xxh64_intdigest(table[self.raw[s[0] : e[0]]].tobytes(), 7)
                lo = hi
                continue
            block = table[self.raw[s[0] : e[-1]]]
            value = (block.astype(np.uint64) + np.uint64(1)) * up[: len(block)]
            if runs:
                kept = np.ones(len(block), bool)
                kept[1:] = block[1:] != block[:-1]
                kept[s - s[0]] = True
                place = np.cumsum(kept) - 1
                value = np.where(kept, (block.astype(np.uint64) + np.uint64(1)) * up[place], np.uint64(0))
                shift = down[place[s - s[0]]]
            else:
                shift = down[s - s[0]]
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
            out[lo:hi] = (total[e - s[0]] - total[s - s[0]]) * shift
            for k in np.flatnonzero(e - s > LONG_WORD):
                out[lo + k] = xxhash.xxh64_intdigest(table[self.raw[s[k] : e[k]]].tobytes(), 7)
            lo = hi
        return mix(out)


def words(column: pa.Array) -> Words:
    """Runs of anything but ASCII white space, as in ``[^\\x20\\x09-\\x0D]+``."""
    raw, at = utf8(column)
    n = len(raw)
    if not n:
        return Words(raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64))
    space = _SPACE[raw]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    before[at[:-1][at[:-1] < n]] = True
    after[at[1:][at[1:] > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return Words(raw, starts, ends, np.searchsorted(starts, at))


def shingles(found: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's runs of so many words, and where each text's begin and the last's end."""
    count = np.maximum(np.diff(found.first) - (size - 1), 0)
    first = np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))
    at = np.arange(first[-1]) + np.repeat(found.first[:-1] - first[:-1], count)
    out = hashes[at]
    for k in range(1, size):
        out = out * np.uint64(_BASE) + hashes[at + k]
    return mix(out), first

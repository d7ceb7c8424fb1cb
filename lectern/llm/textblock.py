"""Words of many texts at once: places and 64-bit hashes, as arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 these bytes occur in no other character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BLOCK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer, in place; a bijection."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES * 2)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, one after the other, and where each begins (and the last ends)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


class Words:
    """Words of some texts. starts, ends: bytes; first: for each text its first word, and the number of words at last."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = (_LOWER[data] if lower else data), offsets
        n = len(data)
        if n:
            inside = ~_SPACE[self.data]
            new = np.zeros(n + 1, bool)
            new[offsets] = True
            new[1:n] |= ~inside[:-1]
            self.starts = np.flatnonzero(inside & new[:n])
            new[offsets] = True
            last = np.zeros(n + 1, bool)
            last[offsets] = True
            last[:n] |= ~inside
            self.ends = np.flatnonzero(inside & last[1:]) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """Of each word: a polynomial of its bytes modulo 2^64, mixed with its length."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        up, down = _power(len(self.data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
            return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64) * _STEP)

    def windows(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of k words of one text, in order."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            out = hashes[:n].copy()
            for j in range(1, k):
                out *= _STEP
                out += hashes[j : j + n]
            at = np.flatnonzero(self.text[:n] == self.text[k - 1 :])
            return at, mix(out[at])


def blocks(texts: pa.Array, size: int = BLOCK_BYTES, lower: bool = False) -> Iterator[tuple[int, Words]]:
    """Texts in runs of about `size` bytes, each with the number of its first text; a longer text stands alone."""
    data, offsets = raw(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower)
        at = to

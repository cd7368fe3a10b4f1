"""Vectorised scanning of Arrow text columns: words, shingles and lines as numpy arrays.

A batch is cut into chunks of about ``CHUNK`` bytes (a longer text is a chunk of its own), so memory
follows the longest text and not the batch. Identity of words, lines and shingles is a 64-bit hash:
a polynomial over a table of random byte values modulo 2**64, passed through a finaliser, so any
substring's hash comes from two prefix sums. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_libc = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None
CHUNK = 1 << 19
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = [np.uint64(int(x) | 1) for x in _rng.integers(0, 1 << 64, 64, dtype=np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of anything but ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words are runs of a-z, 0-9 and non-ASCII characters, in lower-cased text.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not (48 <= c <= 57 or 97 <= c <= 122 or 65 <= c <= 90) for c in range(128)]
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        up, down = np.full(size, _P), np.full(size, _PINV)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


class Chunk:
    """Consecutive texts of a batch: ``data`` their UTF-8 bytes, ``offsets`` len(texts) + 1 bounds, ``first`` the row of the first text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self._prefix = data, offsets, first, None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def fold(self) -> Chunk:
        return Chunk(LOWER[self.data], self.offsets, self.first)

    def runs(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of true bytes; a run ends where its text ends."""
        if not len(word):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        before = np.empty(len(word), bool)
        before[0], before[1:] = False, word[:-1]
        inner = self.offsets[:-1][self.offsets[:-1] < len(word)]
        before[inner] = False
        after = np.empty(len(word), bool)
        after[-1], after[:-1] = False, word[1:]
        last = self.offsets[1:][self.offsets[1:] > 0] - 1
        after[last] = False
        return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of every byte range; equal ranges have equal hashes, in every chunk and process."""
        if self._prefix is None:
            up, _ = powers(len(self.data) + 1)
            self._prefix = np.empty(len(self.data) + 1, np.uint64)
            self._prefix[0] = 0
            np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=self._prefix[1:])
        h = (self._prefix[ends] - self._prefix[starts]) * powers(len(self.data) + 1)[1][starts]
        return mix(h + (ends - starts).astype(np.uint64) * _P)

    def bounds(self, starts: np.ndarray) -> np.ndarray:
        """For ascending starts of items: index of the first item of each text, and their number at the end."""
        return np.searchsorted(starts, self.offsets)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[Chunk]:
    """The texts of a string column, in order."""
    first = 0
    for array in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        array = array.cast(pa.large_string())
        if array.null_count:
            array = array.fill_null("")
        n = len(array)
        _, offsets, data = array.buffers()
        offsets = np.frombuffer(offsets, np.int64, n + 1, array.offset * 8) if n else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            to = min(to, n)
            lo, hi = int(offsets[at]), int(offsets[to])
            yield Chunk(data[lo:hi], offsets[at : to + 1] - lo, first + at)
            at = to
        first += n
    release()


def release() -> None:
    """Gives memory that is free back to the system; a worker lives on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text of every item."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k items in a row within a text, and the index of each one's first item."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = h[:n] * _Q[0]
    for j in range(1, k):
        acc += h[j : j + n] * _Q[j]
    end = np.repeat(bounds[1:], np.diff(bounds))[:n]
    at = np.flatnonzero(np.arange(n) + k <= end)
    return mix(acc[at] + np.uint64(k)), at


def sequence(h: np.ndarray) -> int:
    """Hash of one whole sequence of items, of any length."""
    up, _ = powers(len(h) + 1)
    return int(mix((h * up[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))[0]) if len(h) else 0


def seen_before(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per item: an equal item of the same text comes earlier; any other equal item of the same text exists."""
    earlier, shared = np.zeros(len(h), bool), np.zeros(len(h), bool)
    if len(h) > 1:
        order = np.lexsort((h, owner))
        same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        earlier[order[1:]] = same
        shared[order[1:]] |= same
        shared[order[:-1]] |= same
    return earlier, shared


def shingle_sets(chunk: Chunk, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct k-word shingles) of each text of a folded chunk; fewer words are one shingle, no words none."""
    starts, ends = chunk.runs(~SPACE[chunk.data])
    h, bounds = chunk.hashes(starts, ends), chunk.bounds(starts)
    w, at = windows(h, bounds, k)
    cut = np.searchsorted(at, bounds)
    for i in range(len(chunk)):
        n = bounds[i + 1] - bounds[i]
        if n >= k:
            yield chunk.first + i, np.unique(w[cut[i] : cut[i + 1]])
        else:
            yield chunk.first + i, np.array([sequence(h[bounds[i] : bounds[i + 1]])] if n else [], np.uint64)

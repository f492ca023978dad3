"""Vectorised work on UTF-8 text in numpy: slices of a batch, words, and 64-bit hashes.

Every word pattern used here is a set of bytes: bytes from 0x80 on belong to words, so a test by
byte equals the test by character. Texts are handled whole; a slice ends only between texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once: arrays of 8 bytes for each, several at a time, stay in a worker, of which an executor keeps some idle.
SLICE_BYTES = 1 << 18
U64 = np.uint64
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
STEP = 0xD1342543DE82EF95


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased.
ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: [^\x20\x09-\x0D]+
NONSPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def random_words(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values, the same on every machine."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + U64(seed * 0x632BE59BD9B4E019 % (1 << 64))) * U64(BASE))


#: Powers that a worker keeps. Those of a longer slice are products of one of these and one of a multiple of POWERS.
POWERS = 1 << 14


def _series(factor: int, size: int) -> np.ndarray:
    made = np.full(size, factor, dtype=np.uint64)
    made[0] = 1
    return np.multiply.accumulate(made)


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """The first POWERS powers of BASE and of its inverse."""
    return _series(BASE, POWERS), _series(pow(BASE, -1, 1 << 64), POWERS)


def far_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of BASE and of its inverse at the multiples of POWERS, up to n."""
    size = n // POWERS + 1
    return _series(pow(BASE, POWERS, 1 << 64), size), _series(pow(BASE, -POWERS, 1 << 64), size)


BYTE_HASH = random_words(1, 256)
BYTE_HASH_FOLDED = BYTE_HASH[LOWER]


class Slice:
    """Some whole texts of a batch, as bytes; offs has the start of each and the end of the last."""

    def __init__(self, first: int, buf: np.ndarray, offs: np.ndarray):
        self.first, self.buf, self.offs, self.n = first, buf, offs, len(offs) - 1

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of member bytes in each text; of each text the index of its first run, and their number at the end."""
        inside = member[self.buf]
        return self.flag_runs(inside)

    def flag_runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = len(inside)
        before = np.empty(size + 1, dtype=bool)
        before[0] = False
        before[1:] = inside
        after = np.empty(size + 1, dtype=bool)
        after[:-1] = inside
        after[-1] = False
        before[self.offs[:-1]] = False
        after[self.offs[1:]] = False
        starts = np.flatnonzero(inside & ~before[:-1])
        ends = np.flatnonzero(inside & ~after[1:]) + 1
        return starts, ends, np.searchsorted(starts, self.offs)

    def prefix_hash(self, byte_hash: np.ndarray) -> np.ndarray:
        """Sums from which hash_spans gets the hash of any span."""
        sums = np.empty(len(self.buf) + 1, dtype=np.uint64)
        sums[0] = 0
        near, far = powers()[0], far_powers(len(self.buf))[0]
        for k, first in enumerate(range(0, len(self.buf), POWERS)):
            part = byte_hash[self.buf[first : first + POWERS]]
            part *= near[: len(part)]
            part *= far[k]
            sums[first + 1 : first + 1 + len(part)] = part
        np.cumsum(sums, out=sums)
        return sums

    def hash_spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        near, far = powers()[1], far_powers(len(self.buf))[1]
        h = (sums[ends] - sums[starts]) * near[starts & (POWERS - 1)]
        h *= far[starts // POWERS]
        return mix(h ^ ((ends - starts).astype(np.uint64) * U64(STEP)))


#: Of the C library, where it has it: gives what is free in its heaps back.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def let_go() -> None:
    """Gives memory that is free back to the system: an executor keeps several idle workers, each with what its allocators held at most."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Slices of about ``limit`` bytes; a longer text makes a slice of its own. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, raw, data = texts.buffers()
    offs = np.frombuffer(raw, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield Slice(i, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j
    let_go()


def owner(bounds: np.ndarray) -> np.ndarray:
    """For CSR bounds, the row of each item."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values within CSR bounds; empty rows get 0."""
    sums = np.zeros(len(values) + 1, dtype=values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def window_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words within rows, and their CSR bounds.

    A row with fewer words, but not none, has one window that holds them all.
    """
    counts = np.diff(bounds)
    n = len(words)
    h = np.zeros(n, dtype=np.uint64)
    factor = U64(STEP | 1)
    for k in range(width):
        part = words[k:] if k else words
        h[: n - k] = h[: n - k] * factor + part
    left = np.repeat(bounds[1:], counts) - np.arange(n)
    short = counts < width
    whole = left >= width
    if short.any():
        first = bounds[:-1][short & (counts > 0)]
        size = counts[short & (counts > 0)]
        acc = np.zeros(len(first), dtype=np.uint64)
        for k in range(width - 1):
            has = size > k
            acc[has] = acc[has] * factor + words[first[has] + k]
        h[first] = mix(acc ^ (size.astype(np.uint64) * U64(BASE)))
        whole[first] = True
    made = np.where(counts == 0, 0, np.maximum(1, counts - width + 1))
    return mix(h[whole]), np.concatenate([[0], np.cumsum(made)])


class HashIndex:
    """An open-addressing table from 64-bit hashes to numbers, looked up and filled by whole arrays."""

    def __init__(self, room: int = 1 << 15):
        self._make(room)

    def _make(self, room: int) -> None:
        self.mask = (1 << max(4, (2 * room - 1).bit_length())) - 1
        self.keys, self.values, self.n = np.zeros(self.mask + 1, dtype=np.uint64), np.zeros(self.mask + 1, dtype=np.int64), 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h & U64(self.mask)).astype(np.int64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for those not in the table."""
        h = np.where(h == 0, U64(1), h)
        out = np.full(len(h), -1, dtype=np.int64)
        slot = self._slots(h)
        left = np.arange(len(h))
        while len(left):
            key = self.keys[slot]
            hit = key == h
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (key != 0)
            left, h, slot = left[on], h[on], (slot[on] + 1) & self.mask
        return out

    def insert(self, h: np.ndarray, values: np.ndarray) -> None:
        """Adds hashes that are distinct and not in the table."""
        h = np.where(h == 0, U64(1), h)
        if 2 * (self.n + len(h)) > self.mask:
            used = self.keys != 0
            h, values = np.concatenate([self.keys[used], h]), np.concatenate([self.values[used], values])
            self._make(2 * len(h))
        self.n += len(h)
        slot = self._slots(h)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            mine = free & (self.keys[slot] == h)
            self.values[slot[mine]] = values[mine]
            h, values, slot = h[~mine], values[~mine], (slot[~mine] + 1) & self.mask

"""Texts of an Arrow batch as NumPy arrays: words, hashes and window minima without Python loops.

Hashes are 64 bits wide, made of fixed odd multipliers and table values, so every task and every
run gives the same ones.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
CHUNK_BYTES = 1 << 20


def give_back() -> None:
    """Returns freed memory to the system at the end of a task; workers go on to other work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


@lru_cache(1)
def byte_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table grows by doubling."""
    known = _powers.get(base, np.ones(1, U64))
    while len(known) < n:
        known = np.concatenate([known, known * U64(pow(base, len(known), 1 << 64))])
    _powers[base] = known
    return known[:n]


class Texts:
    """A run of documents: ids, the joined UTF-8 bytes, and where each document starts."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.ids, self.data, self.offsets = ids, data, offsets

    def words(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word in the bytes, and the first word of each document (one more
        entry than documents)."""
        data = self.data
        if not len(data):
            empty = np.zeros(0, np.int64)
            return empty, empty, np.zeros(len(self.offsets), np.int64)
        inside = (data != 32) & ((data < 9) | (data > 13))
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        edges = self.offsets[:-1][self.offsets[:-1] < len(data)]
        before[edges] = False
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        last = self.offsets[1:][self.offsets[1:] > 0] - 1
        after[last] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def range_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """Hashes of byte ranges, which may not be longer than a chunk; equal bytes, equal hash."""
        data = self.data
        if lower:
            data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(byte_table()[data] * powers(BASE, len(data)), out=sums[1:])
        inverse = powers(pow(BASE, -1, 1 << 64), len(data) + 1)
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


def texts_of(batch: pa.RecordBatch, extra: tuple[str, ...] = ()) -> Iterator[tuple[Texts, pa.RecordBatch]]:
    """The batch's doc_id and text in runs of a few megabytes; one long document is a run of its
    own. Null texts are empty."""
    texts = batch.column("text").cast(pa.large_string()).fill_null("")
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield Texts(ids[at:stop], data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]), batch.slice(at, stop - at)
        at = stop


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values. Sorting beats a hash table on the nearly sorted arrays met here."""
    ordered = np.sort(values, kind="stable")
    keep = np.ones(len(ordered), bool)
    keep[1:] = ordered[1:] != ordered[:-1]
    return ordered[keep]


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hash of each run of ``width`` neighbouring values."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i in range(width):
        out = out * U64(0x5851F42D4C957F2D) + words[i : i + n]
    return mix(out)


def inside_documents(firsts: np.ndarray, n_windows: int, width: int) -> np.ndarray:
    """Which windows of ``width`` items do not cross into the next document."""
    if n_windows <= 0:
        return np.zeros(0, bool)
    left = np.repeat(firsts[1:], np.diff(firsts))[:n_windows]
    return np.arange(n_windows) + width <= left


def window_minima(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of each run of ``width`` values and the place of its leftmost occurrence, compared
    by all but the lowest twelve bits. Widths stay below 4096."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    low = U64(0xFFF)
    place = np.arange(len(values), dtype=U64)
    best, span = (values & ~low) | (place & low), 1
    while span * 2 <= width:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[:n], best[width - span : width - span + n])
    start = place[:n]
    found = (start + ((best - start) & low)).astype(np.int64)
    return values[found], found

"""Vectorised words and hashes over Arrow string columns: whole texts, a bounded slice of rows at a time."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TABLES: dict[int, tuple] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def randoms(seed: int, n: int) -> np.ndarray:
    """``n`` fixed 64-bit values of a seed, the same in every process."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _ODD)


def _tables(seed: int):
    if seed not in _TABLES:
        base = int(randoms(seed + 1000, 1)[0]) | 1
        inverse = pow(base, -1, 1 << 64)
        powers, inverses = np.ones(_BLOCK + 1, np.uint64), np.ones(_BLOCK + 1, np.uint64)
        powers[1:], inverses[1:] = base, inverse
        _TABLES[seed] = (randoms(seed, 256), np.multiply.accumulate(powers), np.multiply.accumulate(inverses))
    return _TABLES[seed]


@dataclass
class Words:
    """Rows ``lo`` to ``hi`` of a column: their bytes and the byte range of every word; ``first[i]`` is row i's first word."""
    lo: int
    hi: int
    raw: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def of(self, i: int) -> slice:
        return slice(int(self.first[i]), int(self.first[i + 1]))

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts)

    def text(self, i: int) -> bytes:
        return self.raw[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def hashes(self, seed: int = 1) -> np.ndarray:
        """One 64-bit value per word."""
        return self.range_hashes(self.starts, self.ends, seed)

    def range_hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
        """One 64-bit value per byte range (in order, not overlapping); equal bytes have equal values in every process."""
        table, powers, inverses = _tables(seed)
        out, n, at = np.empty(len(starts), np.uint64), len(starts), 0
        while at < n:
            begin = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, begin + _BLOCK, "right")))
            if ends[to - 1] - begin > _BLOCK:  # one range longer than a block
                out[at] = int.from_bytes(hashlib.blake2b(self.raw[begin:ends[at]].tobytes(), digest_size=8).digest(), "little")
            else:
                part = table[self.raw[begin:ends[to - 1]]]
                part *= powers[:len(part)]
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(part, out=sums[1:])
                s, e = starts[at:to] - begin, ends[at:to] - begin
                out[at:to] = (sums[e] - sums[s]) * inverses[s]
            at = to
        return mix(out)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and end of every line (split at line feeds) that holds a word."""
        if not len(self.raw):
            return (np.zeros(0, np.int64),) * 3
        cut = self.raw == 10
        breaks = np.flatnonzero(cut)
        starts = np.unique(np.concatenate([self.offsets[:-1][np.diff(self.offsets) > 0], breaks + 1])).astype(np.int64)
        starts = starts[starts < len(self.raw)]
        ends = np.append(starts[1:], len(self.raw))
        ends = np.where(cut[ends - 1] & (ends > starts), ends - 1, ends)
        words_before = np.searchsorted(self.starts, starts), np.searchsorted(self.starts, ends)
        keep = words_before[0] < words_before[1]
        starts, ends = starts[keep], ends[keep]
        return np.searchsorted(self.offsets, starts, "right") - 1, starts, ends

    def code_points(self) -> np.ndarray:
        """Characters inside words, per row."""
        counts = (~_SPACE[self.raw] & ((self.raw & 0xC0) != 0x80)).astype(np.int64)
        return row_sums(counts, self.offsets)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _buffers(column: pa.Array):
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def words(column: pa.Array, lower: bool = False, limit: int = _BLOCK) -> Iterator[Words]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of consecutive rows, up to about ``limit`` bytes at a time (one row at least).

    A null row has no bytes and no word.  ``lower`` lower-cases A-Z first.
    """
    if not len(column):
        return
    offsets, data = _buffers(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        raw, off = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        if lower:
            raw = _LOWER[raw]
        inside = ~_SPACE[raw]
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[off[off < len(raw)]] = False
        after[off[off > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        yield Words(lo, hi, raw, off, starts, ends, np.searchsorted(starts, off))
        lo = hi


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that no piece has more than ``rows`` rows; bounds what a step holds beside its input."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def windows(hashes: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """A value of every ``size`` consecutive words, from each word on that has so many after it (rows not regarded)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(n, np.uint64), randoms(seed, size) | np.uint64(1)
    for j in range(size):
        out += hashes[j:j + n] * factor[j]
    return mix(out)


def inside_rows(rows: np.ndarray, size: int) -> np.ndarray:
    """For every window of ``size`` words: whether its first and last word lie in one row (``rows``: the row of each word)."""
    n = len(rows) - size + 1
    return rows[:n] == rows[size - 1:] if n > 0 else np.zeros(0, bool)


def covered(marks: np.ndarray, size: int, n: int) -> np.ndarray:
    """Words covered by the marked windows; ``marks`` holds window starts."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, marks, 1)
    np.add.at(step, np.minimum(marks + size, n), -1)
    return np.cumsum(step[:n]) > 0

"""Language-model scores of whole texts: logistic mixing of hashed-context bit predictors, next to a smoothed word model.

*Mixing.*  A byte is a path through a binary code tree (Huffman, from the bytes of all training documents); every branch is one bit.  Three predictors keep how often a
branch went either way after the last two bytes, the last three, and the word so far; contexts share ``1 << SLOT_BITS`` hashed slots
each.  These counts come from every training document: tasks count into dense arrays and send the touched slots, which a grouped sum merges.  A bit's
prediction is the logistic of a weighted sum of the predictors' log odds.  Weights are gated: one set by the branch, one by how much the predictors
have seen, and a third that adapts online to the document read so far.  A last table, addressed by branch and mixed odds, refines the
result.  Gates and refinement are fitted to the evidence of all training documents: each bit is taken out of the counts, and tasks count how often a branch went
either way after each combination of what the predictors then knew, in ``LEVELS`` levels each.  A grouped sum merges the tasks; the table's size is fixed.  A
document's log10 probability is that of its UTF-8 bytes and one closing zero byte.

Equal bytes after equal contexts are sorted together, ``GROUP`` bytes at a time, and become bits once, with their number.

*Word model.*  Tokens are words (A-Z lower-cased) and one end.  Counts of all training tokens are a grouped sum.  The most frequent words, at most ``KNOWN``, travel to
the tasks; the others meet their counts in a join on the word, pre-aggregated per document.

Null texts are empty: one token, the end.  A null doc_id is learned from.  Repeated rows are scored alike, and each counts in training.  Without training
documents N and V are 0 and every text is scored by the uniform start of the model.  An empty table gives an empty result.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .store import written
from .text import _buffers, randoms, words

SLOT_BITS = 18
CONTEXTS = 3
LEVELS = 16
GROUP = 1 << 21
KNOWN = 1 << 19
SEGMENT = 512
_CHUNK = 1 << 16
_TOGETHER = 1 << 15
_BACK = 64
_MUL = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BYTE = (randoms(81, 256) >> np.uint64(32)).astype(np.uint32)


@dataclass
class Code:
    """The code tree: byte b is the branches ``nodes[start[b]:start[b] + size[b]]``, each taken as ``bits`` says."""
    start: np.ndarray
    size: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray

    @property
    def salt(self) -> np.ndarray:
        """A slot value per place in the code, the same for the same branch."""
        return slot_of((self.nodes.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1))

    @property
    def known(self) -> np.ndarray:
        """All that is known of a place in one number: the bit, eight bits of the branch, ``SLOT_BITS`` of the slot value."""
        return (self.bits.astype(np.int32) << 8 | self.nodes.astype(np.int32)) << SLOT_BITS | self.salt


def slot_of(h: np.ndarray) -> np.ndarray:
    """The upper ``SLOT_BITS`` bits of scrambled 32-bit values."""
    s = h >> np.uint32(16)
    s ^= h
    s *= np.uint32(0x2C1B3C6D)
    s ^= s >> np.uint32(15)
    s *= np.uint32(0x297A2D39)
    s >>= np.uint32(32 - SLOT_BITS)
    return s.view(np.int32)


def huffman(counts: np.ndarray) -> Code:
    heap = [(int(c), b, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    node = 256
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (node, 0), (node, 1)
        heapq.heappush(heap, (a + b, node, node))
        node += 1
    nodes, bits, start, size = [], [], [], []
    for b in range(256):
        path, at = [], b
        while at in parent:
            path.append((parent[at][0] - 256, parent[at][1]))
            at = parent[at][0]
        start.append(len(nodes))
        size.append(len(path))
        for n, bit in reversed(path):
            nodes.append(n)
            bits.append(bit)
    return Code(np.array(start), np.array(size), np.array(nodes, np.int64), np.array(bits, np.int8))


def texts_of(column: pa.Array, limit: int = _CHUNK, together: int = _TOGETHER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, row of each byte, place in its document, bytes of context in front) of consecutive documents, each closed by a zero byte.

    A document longer than ``limit`` comes in parts; a part repeats the last ``_BACK`` bytes before it as context.  Shorter ones come ``together``, up to about so many bytes.
    """
    if not len(column):
        return
    offsets, raw = _buffers(column)
    lo = 0
    while lo < len(column):
        hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + together, "right")) - 1), len(column))
        own, n = raw[offsets[lo]:offsets[hi]], np.diff(offsets[lo:hi + 1]) + 1
        if len(own) <= limit:
            ends = np.cumsum(n)
            data, inner = np.zeros(len(own) + hi - lo, np.uint8), np.ones(len(own) + hi - lo, bool)
            inner[ends - 1] = False
            data[inner] = own
            yield data, np.repeat(np.arange(lo, hi, dtype=np.int32), n), np.arange(len(data), dtype=np.int32) - np.repeat((ends - n).astype(np.int32), n), 0
        else:
            data = np.append(own, np.uint8(0))
            for at in range(0, len(data), limit):
                start = max(0, at - _BACK)
                part = data[start:at + limit]
                yield part, np.full(len(part), lo, np.int32), np.arange(start, start + len(part)), at - start
        lo = hi


@cache
def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.multiply.accumulate(np.full(n, f, np.uint32), dtype=np.uint32) for f in (0x01000193, pow(0x01000193, -1, 1 << 32)))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the word polynomial's factor and of its inverse; kept for sizes that are powers of two."""
    powers, inverses = _steps(1 << (n - 1).bit_length())
    return powers[:n], inverses[:n]


def contexts(data: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """A 32-bit value per byte and predictor: what the predictor knows before the byte."""
    mixed = _BYTE.take(data)
    early = np.flatnonzero(place < 3)
    place_of = place[early]
    before = np.zeros(len(data), np.uint32)
    out = []
    for k in range(1, 4):
        shifted = np.zeros(len(data), np.uint32)
        np.multiply(mixed[:-k], _MUL[k], out=shifted[k:]) if len(data) > k else None
        shifted[early[place_of < k]] = 0
        before = before * np.uint32(0x01000193)
        before += shifted
        if k > 1:
            out.append(before + np.uint32(k))
    # the word so far: a polynomial over the letters since the last other byte
    first, other = early[place_of == 0], ~_LETTER.take(data)
    mark = np.arange(1, len(data) + 1, dtype=np.int32)
    mark *= other
    mark[first] = first + other[first]
    start = np.zeros(len(data), np.int32)
    np.maximum.accumulate(mark[:-1], out=start[1:])
    start[first] = first
    powers, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint32)
    np.cumsum(mixed * powers[:-1], out=sums[1:], dtype=np.uint32)
    word = sums[:-1] - sums.take(start)
    word *= inverse.take(start)
    word ^= word >> np.uint32(15)
    word *= _MUL[0]
    none = np.flatnonzero(start == np.arange(len(data), dtype=np.int32))
    word[none] += before[none]
    word += np.uint32(77)
    out.append(word)
    return out


def _at(table: pa.Array, at: np.ndarray | pa.Array) -> np.ndarray:
    """``table`` at 32-bit places that lie inside it; not to be written to."""
    return pc.take(table, pa.array(at), boundscheck=False).to_numpy()


def places(code: Code, data: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(where every byte's bits begin, and their end, the byte of every bit, its place in the code, what is ``known`` of that)."""
    size = code.size.take(data)
    ends = np.concatenate([[0], np.cumsum(size)])
    of = pa.array(np.repeat(np.arange(len(data), dtype=np.int32), size))
    at = _at(pa.array((code.start.take(data) - ends[:-1]).astype(np.int32)), of) + np.arange(ends[-1], dtype=np.int32)
    return ends, of, at, _at(pa.array(code.known), at)


def known_bits(code: Code, data: np.ndarray, place: np.ndarray, skip: int, order: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(where every byte's bits begin, and their end, places in the code, what is ``known`` of these, slot per predictor) of all bits after the first ``skip`` bytes, which are context only.

    A bit's slot is that of its context, crossed with that of its branch: contexts are scrambled once a byte.  ``order``: the bytes after those in the order their bits are wanted.
    """
    ends, of, at, known = places(code, data[skip:][order])
    salt, slots = known & np.int32((1 << SLOT_BITS) - 1), []
    for h in contexts(data, place):
        slots.append(_at(pa.array(slot_of(h[skip:])[order]), of) ^ salt)
    return ends, at, known, slots


def bit_events(code: Code, data: np.ndarray, place: np.ndarray, skip: int, order: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(bits per byte, places in the code, slot per predictor) of the same bits."""
    ends, at, _, slots = known_bits(code, data, place, skip, order)
    return np.diff(ends), at, slots


def grouped(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(slot of the context per predictor, byte, times): equal bytes of about ``GROUP`` bytes, or of ``rows`` documents if these are fewer, are one."""
    held, total = [], 0
    for batch in batches:
        step = rows or max(1, batch.num_rows)
        for lo in range(0, batch.num_rows, step):
            for data, _, place, skip in texts_of(batch.column(0).slice(lo, step)):
                key = np.zeros(len(data) - skip, np.uint64)
                for h in contexts(data, place):
                    key <<= np.uint64(SLOT_BITS)
                    key |= slot_of(h[skip:]).astype(np.uint64)
                key <<= np.uint64(8)
                key |= data[skip:]
                held.append(key)
                total += len(key)
                if total >= GROUP:
                    yield _runs(held)
                    held, total = [], 0
            if rows and held:
                yield _runs(held)
                held, total = [], 0
    if held:
        yield _runs(held)


def _runs(held: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    key = np.concatenate(held)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times, key = np.diff(first, append=len(key)), key[first]
    slots = [((key >> np.uint64(8 + SLOT_BITS * (CONTEXTS - 1 - k))) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int32) for k in range(CONTEXTS)]
    return slots, (key & np.uint64(255)).astype(np.uint8), times


def grouped_bits(batches: Iterator[pa.RecordBatch], code: Code, rows: int | None = None) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """(``known`` of the place in the code, twice the slot and the bit per predictor, times) of all bits."""
    for slots, data, times in grouped(batches, rows):
        for lo in range(0, len(data), 1 << 18):
            own = data[lo:lo + (1 << 18)]
            _, of, _, known = places(code, own)
            salt, bit, out = known & np.int32((1 << SLOT_BITS) - 1), known >> SLOT_BITS + 8, []
            for s in slots:
                s = _at(pa.array(s[lo:lo + (1 << 18)]), of) ^ salt
                s <<= 1
                s |= bit
                out.append(s)
            yield known, out, _at(pa.array(times[lo:lo + (1 << 18)]), of)


def count_bits(batches: Iterator[pa.RecordBatch], code: Code, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """(slot, n0, n1) of one task's texts; a slot's number holds its predictor."""
    held = np.zeros((CONTEXTS, 2 << SLOT_BITS), np.int64)
    for _, slots, times in grouped_bits(batches, code, rows):
        for k, s in enumerate(slots):
            np.add.at(held[k], s, times)
    held = held.reshape(-1, 2)
    some = np.flatnonzero(held.any(1))
    for at in range(0, len(some), 1 << 16):
        s = some[at:at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(held[s, 0]), pa.array(held[s, 1])], names=["slot", "n0", "n1"])


def _stretch(n0, n1) -> np.ndarray:
    return np.log((n1 + 0.3) / (n0 + 0.3)).astype(np.float32)


def _seen(n: np.ndarray) -> np.ndarray:
    """How much a predictor has seen, in four steps."""
    return np.searchsorted([1, 4, 24], n, "right").astype(np.int16)


@dataclass
class Model:
    """``packed``: per predictor and slot, the log odds in 1/64 above two bits for how much was seen."""
    code: Code
    packed: np.ndarray
    by_node: np.ndarray
    by_seen: np.ndarray
    refined: np.ndarray
    rate: float = 3.0

    def bits_of(self, column: pa.Array) -> np.ndarray:
        """Code length in bits of every row.

        The bytes of a slice are ordered by the part of their document (up to byte 512, 1024, 2048, ...), so that the bits of a part are one stretch of every array.
        """
        total, adapted = np.zeros(len(column)), np.zeros((CONTEXTS, len(column)), np.float32)
        # log odds stay in 1/64: the weights carry the factor, a power of two
        unit = np.float32(1 / 64)
        gates = [pa.array(np.ascontiguousarray((self.by_node[:, None, k] + self.by_seen[None, :, k]).ravel()) * unit) for k in range(CONTEXTS)]
        packed, refined = [pa.array(p) for p in self.packed], pa.array(self.refined)
        step = np.float32(self.rate / 4) * unit * unit
        for data, row, place, skip in texts_of(column):
            row, place_of = row[skip:], place[skip:]
            # documents by parts: from which byte on, how many
            docs = np.arange(row[0], row[-1] + 1)
            begins = np.searchsorted(row, np.append(docs, row[-1] + 1))
            low, length = place_of[begins[:-1]].astype(np.int64), np.diff(begins)
            last = max(0, int((low + length).max() - 1) // SEGMENT).bit_length()
            edges = np.concatenate([[0], SEGMENT << np.arange(last + 1)])[:, None]
            from_, upto = np.clip(edges[:-1], low, low + length), np.clip(edges[1:], low, low + length)
            length, starts = upto - from_, from_ - low + begins[:-1]
            bytes_of = np.concatenate([[0], np.cumsum(length)])
            order = np.repeat(starts.ravel() - bytes_of[:-1], length.ravel()) + np.arange(len(row)) if last else slice(None)
            ends, _, known, slots = known_bits(self.code, data, place, skip, order)
            seen, xs = np.zeros(len(known), np.int16), []
            for k, s in enumerate(slots):
                v = _at(packed[k], s)
                seen <<= 2
                seen |= v & 3
                xs.append((v >> 2).astype(np.float32))
            known = known >> SLOT_BITS
            away = (1 - (known >> 8 << 1)).astype(np.float32)    # -1 for a bit that is 1
            known &= 255
            gate = known << 2 * CONTEXTS
            gate |= seen
            known *= 33
            known += 16
            weights = [_at(g, gate) for g in gates]
            for k in range(last + 1):
                some = np.flatnonzero(length[k])
                if not len(some):
                    continue
                # the documents in this part, and where their bits begin
                mine, begin = docs[some], ends[bytes_of[k * len(docs) + some]]
                here = slice(begin[0], ends[bytes_of[(k + 1) * len(docs)]])
                begin = begin - here.start
                n = np.diff(begin, append=here.stop - here.start)
                cell, x, y = known[here], [c[here] for c in xs], away[here]
                z = np.zeros(len(cell), np.float32)
                for c in range(CONTEXTS):
                    w = weights[c][here]
                    if k or skip:
                        w = w + np.repeat(adapted[c][mine], n)
                    z += w * x[c]
                level = z * np.float32(2)
                np.clip(level, -16, 16, out=level)
                np.rint(level, out=level)
                cell += level.astype(np.int32)
                z += _at(refined, cell)
                z *= y
                np.clip(z, -14, 14, out=z)
                e = np.exp(z, out=z)
                odds = e + 1
                if k < last or skip or len(data) >= _CHUNK:
                    e *= y
                    e /= odds
                    for c in range(CONTEXTS):
                        adapted[c][mine] -= step * np.add.reduceat(e * x[c], begin) / (n + np.float32(256))
                total[mine] += np.add.reduceat(np.log(odds, out=odds), begin) / np.log(2)
        return total


class Evidence:
    """What the predictors know of a bit that is left out of its counts, in ``LEVELS`` levels: four steps of how much was seen, cut by log odds.

    ``level``: per predictor, of twice the slot and the bit.  ``odds``: per predictor and level, the mean log odds of the bits that meet it.
    """
    CUTS = [np.zeros(0), np.array([-0.5, 0.5]), np.array([-2.2, -0.8, 0.8, 2.2]), np.array([-4.2, -2.0, -0.7, 0.7, 2.0, 4.2])]

    def __init__(self, n0: np.ndarray, n1: np.ndarray):
        base = np.cumsum([0, *[len(c) + 1 for c in self.CUTS]])
        self.seen_of = np.repeat(np.arange(4), np.diff(base))
        self.level, self.odds = np.zeros((CONTEXTS, 2 * n0.shape[1]), np.uint8), np.zeros((CONTEXTS, LEVELS))
        for k in range(CONTEXTS):
            total, bits = np.zeros(LEVELS), np.zeros(LEVELS)
            for y, n in enumerate((n0[k], n1[k])):
                a, b = (np.maximum(n0[k] - 1, 0), n1[k]) if y == 0 else (n0[k], np.maximum(n1[k] - 1, 0))
                x, seen = np.clip(_stretch(a, b), -8, 8), _seen(a + b)
                level = np.zeros(len(n), np.uint8)
                for s, cuts in enumerate(self.CUTS):
                    level[seen == s] = base[s] + np.searchsorted(cuts, x[seen == s])
                self.level[k, y::2] = level
                total += np.bincount(level, x * n.astype(np.float64), LEVELS)
                bits += np.bincount(level, n, LEVELS)
            self.odds[k] = total / np.maximum(bits, 1)


def count_evidence(batches: Iterator[pa.RecordBatch], code: Code, evidence: Evidence, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """(cell, n) of one task's texts; a cell's number holds the branch, the level of every predictor, and the bit."""
    held = np.zeros(512 * LEVELS ** CONTEXTS, np.int64)
    for known, slots, times in grouped_bits(batches, code, rows):
        cell = known >> SLOT_BITS & 255
        for k, s in enumerate(slots):
            cell *= LEVELS
            cell += _at(pa.array(evidence.level[k]), s)
        cell <<= 1
        cell |= known >> SLOT_BITS + 8
        np.add.at(held, cell, times)
    some = np.flatnonzero(held)
    for at in range(0, len(some), 1 << 16):
        s = some[at:at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(held[s])], names=["cell", "n"])


def fit(code: Code, n0: np.ndarray, n1: np.ndarray, evidence: Evidence, cell: np.ndarray, n: np.ndarray, rounds: int = 8, hold: float = 16.0) -> Model:
    """Weights and refinement with the highest likelihood of the counted cells, by Newton steps in turn; ``hold``: bits' worth of what they start from."""
    order = np.argsort(cell)
    n, rest = n[order].astype(np.float64), cell[order].astype(np.int64)
    y, rest = rest & 1, rest >> 1
    node, x, seen = rest // LEVELS ** CONTEXTS, np.zeros((CONTEXTS, len(n))), np.zeros(len(n), np.int64)
    for k in range(CONTEXTS):
        level = rest // LEVELS ** (CONTEXTS - 1 - k) % LEVELS
        x[k], seen = evidence.odds[k][level], seen * 4 + evidence.seen_of[level]
    start = np.full((256, CONTEXTS), 0.35)
    by_node, by_seen, refined = start.copy(), np.zeros((4 ** CONTEXTS, CONTEXTS)), np.zeros(256 * 33)

    def mixed():
        return ((by_node[node] + by_seen[seen]).T * x).sum(0)

    def slopes(z):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return n * (y - p), n * np.maximum(p * (1 - p), 1e-4)

    for _ in range(rounds):
        for table, key, prior in ((by_node, node, start), (by_seen, seen, np.zeros_like(by_seen))):
            miss, curve = slopes(mixed())
            g = np.stack([np.bincount(key, miss * x[c], len(table)) for c in range(CONTEXTS)], 1) + hold * (prior - table)
            h = np.zeros((len(table), CONTEXTS, CONTEXTS)) + hold * np.eye(CONTEXTS)
            for c in range(CONTEXTS):
                for d in range(c, CONTEXTS):
                    v = np.bincount(key, curve * x[c] * x[d], len(table))
                    h[:, c, d] += v
                    if d > c:
                        h[:, d, c] += v
            table += np.clip(np.linalg.solve(h, g[..., None])[..., 0], -0.5, 0.5)
    mix = mixed()
    place = node * 33 + np.clip(np.rint(mix * 2), -16, 16).astype(np.int64) + 16
    for _ in range(rounds):
        miss, curve = slopes(mix + refined[place])
        refined += np.clip((np.bincount(place, miss, len(refined)) - hold * refined) / (np.bincount(place, curve, len(refined)) + hold), -1, 1)
    packed = (np.rint(np.clip(_stretch(n0, n1), -8, 8) * 64).astype(np.int16) << 2) | _seen(n0 + n1)
    return Model(code, packed, *[t.astype(np.float32) for t in (by_node, by_seen, refined)])


def fit_gates(code: Code, n0: np.ndarray, n1: np.ndarray, texts: pa.Array) -> Model:
    """The model of ``texts`` alone, whose bits are counted in ``n0`` and ``n1``."""
    evidence = Evidence(n0, n1)
    found = pa.Table.from_batches(count_evidence(iter([pa.record_batch([texts], names=["text"])]), code, evidence))
    return fit(code, n0, n1, evidence, found.column("cell").to_numpy(), found.column("n").to_numpy())


def count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(byte, n) of one task's texts."""
    held = np.zeros(256, np.int64)
    for batch in batches:
        for data, *_ in texts_of(batch.column(0)):
            held += np.bincount(data, minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(held)], names=["byte", "n"])


def train(learned: DataFrame, text: str = "text", rows: int | None = None) -> Model:
    """The bit model of all texts of ``learned`` (columns doc_id, text).  ``rows``: documents whose equal bytes are sorted together at most; the model does not depend on it."""
    texts = learned.select(F.coalesce(text, F.lit("")).alias(text))
    counts = np.ones(256, np.int64)
    for byte, n in texts.mapInArrow(count_bytes, "byte int, n bigint").groupBy("byte").agg(F.sum("n")).collect():
        counts[byte] += n
    code = huffman(counts)
    summed = texts.mapInArrow(lambda b: count_bits(b, code, rows), "slot int, n0 bigint, n1 bigint").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    n0, n1 = np.zeros((2, CONTEXTS << SLOT_BITS), np.int64)
    slot = summed.column("slot").to_numpy()
    n0[slot], n1[slot] = summed.column("n0").to_numpy(), summed.column("n1").to_numpy()
    n0, n1 = n0.reshape(CONTEXTS, -1), n1.reshape(CONTEXTS, -1)
    evidence = Evidence(n0, n1)
    held = learned.sparkSession.sparkContext.broadcast((code, evidence))
    found = texts.mapInArrow(lambda b: count_evidence(b, *held.value, rows), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    return fit(code, n0, n1, evidence, found.column("cell").to_numpy(), found.column("n").to_numpy())


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of one task's texts, words by a 64-bit value; a flush bounds the memory."""
    held, total = [], 0
    for batch in batches:
        for w in words(batch.column(0), lower=True):
            held.append(np.unique(w.hashes(), return_counts=True))
            total += len(held[-1][0])
            if total > 1 << 20:
                yield _merged(held)
                held, total = [], 0
    if held:
        yield _merged(held)


def _merged(parts: list) -> pa.RecordBatch:
    key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    key, at = np.unique(key, return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(at, n, len(key)).astype(np.int64))], names=["word", "n"])


@dataclass
class Known:
    """Frequent words and their counts, found by a direct table and, where that is taken, by search."""
    keys: np.ndarray
    counts: np.ndarray
    table: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Known:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        table, rising = np.zeros(1 << 20, np.int32), np.argsort(counts, kind="stable")
        table[(keys[rising] & np.uint64((1 << 20) - 1)).astype(np.int64)] = rising    # the last one stays: of words in one place the most frequent
        return cls(keys, counts, table)

    def count(self, h: np.ndarray) -> np.ndarray:
        """The count of each word, or -1."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        at = self.table[(h & np.uint64((1 << 20) - 1)).astype(np.int64)].astype(np.int64)
        left = np.flatnonzero(self.keys[at] != h)
        at[left] = np.minimum(np.searchsorted(self.keys, h[left]), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.counts[at], -1)


def frequent(counts: DataFrame, most: int = KNOWN) -> Known:
    """The words with the highest counts, ``most`` at most: all words from the least count on with which they are no more."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("s")).count().collect()), reverse=True)
    held, least = 0, None
    for s, n in sizes:
        if held + n > most:
            break
        held, least = held + n, s
    if least is None:
        return Known.of(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    found = counts.where(step >= least).select("word", "n").toArrow()
    return Known.of(found.column("word").to_numpy().view(np.uint64), found.column("n").to_numpy())


def _logs(c, n: int, v: int):
    return np.log10((c + 0.1) / (n + 0.1 * (v + 1))) if n else np.zeros(np.shape(c))


def lm_scores(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and bits_per_byte.  ``held_out``: a boolean column."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learned = docs.where(~F.col("held_out")).select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast
    counts = written(learned.select("text").mapInArrow(count_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    tokens, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    ends = learned.count()
    n, v = (tokens or 0) + ends, distinct + (ends > 0)
    known, model = sent(frequent(counts)), sent(train(learned))  # both of fixed size

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            bits = np.concatenate([model.value.bits_of(text.slice(lo, 256)) for lo in range(0, len(text), 256)]) if len(text) else np.zeros(0)
            n_words, found, base, size, rest = [], [], [], [], []
            for w in words(text, lower=True):
                h, row, rows = w.hashes(), w.row_of_word(), w.hi - w.lo
                c = known.value.count(h)
                has = c >= 0
                n_words.append(w.counts)
                found.append(np.bincount(row[has], minlength=rows))
                base.append(np.bincount(row[has], _logs(c[has], n, v), rows))
                size.append(np.diff(w.offsets))
                cut, left = np.searchsorted(row[~has], np.arange(rows + 1)), h[~has].view(np.int64)
                rest += [left[a:b] if b > a else None for a, b in zip(cut[:-1], cut[1:])]
            whole = [np.concatenate(c) if c else np.zeros(0) for c in (n_words, found, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(c, pa.int64()) for c in whole], pa.array(np.concatenate(base) if base else [], pa.float64()), pa.array(bits),
                                              pa.array(rest, pa.list_(pa.int64()))], names=["doc_id", "held_out", "n_words", "found", "bytes", "base", "bits", "rest"])

    # the rest: words too rare to travel, each met once per document with its repeats
    scored = written(docs.select("doc_id", "text", "held_out").mapInArrow(first, "doc_id bigint, held_out boolean, n_words bigint, found bigint, bytes bigint, base double, bits double, rest array<bigint>")
                     .withColumn("key", F.xxhash64("rest")), "scored")
    rare = scored.where("rest is not null").select("doc_id", "key", F.explode("rest").alias("word")).groupBy("doc_id", "key", "word").agg(F.count("*").alias("times"))
    copies = scored.where("rest is not null").groupBy("doc_id", "key").agg(F.count("*").alias("rows"))
    met = rare.join(counts, "word", "left").groupBy("doc_id", "key").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(float(n + 0.1 * (v + 1))))).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("also"))
    extra = met.join(copies, (met["doc_id"].eqNullSafe(copies["doc_id"])) & (met["key"] == copies["key"])).select(
        met["doc_id"].alias("_doc"), met["key"].alias("_key"), (F.col("more") / F.col("rows")).alias("more"), (F.col("also") / F.col("rows")).cast("bigint").alias("also"))
    out = scored.join(extra, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    end = float(_logs(np.array(float(ends)), n, v))
    more = F.coalesce("more", F.lit(0.0)) if n else F.lit(0.0)
    return out.select("doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("found") + F.coalesce("also", F.lit(0)) + int(ends > 0)).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
                      (F.col("base") + more + end).alias("base_score"), (F.col("bits") * float(-np.log10(2))).alias("score"), (F.col("bits") / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"))

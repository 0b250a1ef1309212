"""Benchmark items inside documents: CGK embeddings, bit-sampling LSH, exact edit verification.

Items and documents are sequences of words (A-Z lower-cased).  A document holds an item of m words when some stretch of it lies within
``floor(tolerance * m)`` word edits (insert, delete, replace) of the item.

* *Embedding.*  The CGK walk reads a window word by word; at step j it writes the word under its cursor and moves on when bit j of the word's
  random value is set.  Two windows a few edits apart fall back into step after each edit, so their outputs differ in few places: edit distance
  has become Hamming distance.
* *Bit sampling.*  A table keys a window by outputs of a random stretch of the walk, ``COORDINATES`` or, for small windows, fewer; the stretches of
  a size differ.  Item windows (of the largest size in ``SIZES`` within two thirds of the item) start at every word, document windows at every
  ``STRIDE``-th, so a quarter of them is aligned; items too short for that are met at every word of a document.  In items of over twice the
  largest size, ``STRIDE`` neighbouring windows start at every half window.  ``WALKS`` independent walks with ``TABLES`` tables each give the
  target recall: over 0.95 of the items of any length with as many edits as are tolerated (measured in the tests), and all unedited ones.
* *Verification.*  Every collision is checked by the word edit distance of the whole item to the best stretch around the place.

Documents are read where they lie, without a shuffle, so a passage that a third of them share is no hot key.  Items travel to the tasks in
passes of about ``ITEMS_PER_PASS``, which bounds what is sent; more items make more passes.

Null and empty texts hold no item.  Items of fewer than ``LEAST_WORDS`` words tell nothing about a leak and are passed over, like null ones.
Repeated rows are answered each for itself.  Empty tables give an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .text import mix, randoms, words

SIZES = (4, 6, 9, 12, 16, 22, 30, 42, 60)
LEAST_WORDS = 4
STRIDE = 4
COORDINATES = 8
WALKS, TABLES = 4, 6
TOLERANCE = 0.2
ITEMS_PER_PASS = 2048
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _coordinates(size: int, walk: int, table: int) -> list[int]:
    """Sampled steps of one table: every step or every second one of a stretch inside the window's walk, another for each table while there are any."""
    n = min(COORDINATES, size - 1)
    steps = max(n, int(1.6 * size))
    ways = [(at, step) for step in (1, 2) for at in range(steps - step * (n - 1))]
    at, step = ways[np.argsort(randoms(61 + 1000 * walk + size, len(ways)), kind="stable")[table % len(ways)]]
    return [at + step * k for k in range(n)]


def item_windows(m: int) -> tuple[int, int, np.ndarray]:
    """(stride of the document windows, size, starts) of the windows of an item of m words."""
    if m < 2 * SIZES[1]:
        return 1, SIZES[0], np.arange(m - SIZES[0] + 1)
    size = max(s for s in SIZES if 3 * s <= 2 * m)
    starts = np.arange(m - size + 1)
    return STRIDE, size, starts if m <= 2 * SIZES[-1] else starts[starts % (size // 2) < STRIDE]


def window_keys(h: np.ndarray, starts: np.ndarray, sizes: list[int], walk: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(size, table, key per start) of one walk over the words ``h`` from each start."""
    wanted: dict[int, list] = {}
    for size in sizes:
        for table in range(TABLES):
            for k in _coordinates(size, walk, table):
                wanted.setdefault(k, []).append((size, table))
    steps = max(wanted) + 1
    padded = np.concatenate([h, np.zeros(steps + 1, np.uint64)])
    cursor, keys, bits = starts.astype(np.int64), {}, None
    for j in range(steps):
        if j % 64 == 0:
            bits = mix(padded + randoms(71 + walk, j // 64 + 1)[-1])
        if j in wanted:
            word = padded[cursor]
            for name in wanted[j]:
                keys[name] = keys[name] * _FACTOR + word if name in keys else word.copy()
        cursor += ((bits[cursor] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
    for (size, table), key in keys.items():
        yield size, table, mix(key)


@dataclass
class Items:
    """The items of one pass, ready for lookups.  ``tables``: by (stride, walk, size, table), sorted keys with item and offset."""
    ids: list
    words: list[np.ndarray]
    tables: dict = field(default_factory=dict)

    def sizes(self, stride: int) -> list[int]:
        return sorted({k[2] for k in self.tables if k[0] == stride})


def index(ids: list, texts: list[str]) -> Items:
    held = Items([], [])
    raw: dict[tuple, list] = {}
    for w in words(pa.array(texts, pa.string()), lower=True):
        h = w.hashes()
        for i in range(w.hi - w.lo):
            own = h[w.of(i)]
            if len(own) < LEAST_WORDS:
                continue
            number = len(held.ids)
            held.ids.append(ids[w.lo + i])
            held.words.append(own)
            stride, size, starts = item_windows(len(own))
            for walk in range(WALKS):
                for _, table, key in window_keys(own, starts, [size], walk):
                    raw.setdefault((stride, walk, size, table), []).append((key, np.full(len(starts), number), starts))
    for name, parts in raw.items():
        key, item, offset = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(key, kind="stable")
        seen = np.zeros(1 << 16, bool)
        seen[key >> np.uint64(48)] = True
        held.tables[name] = key[order], item[order], offset[order], seen
    return held


def collisions(h: np.ndarray, items: Items, first: np.ndarray) -> np.ndarray:
    """Rows (item, place, row): the items that share a key with a window, the word where the item would begin, and the text where the window does.

    ``first``: where the words of every text begin in ``h``.  An item that is cut short there has its place before its text.
    """
    found = [np.zeros((0, 3), np.int64)]
    for stride in sorted({k[0] for k in items.tables}):
        starts = np.arange(0, len(h), stride)
        for walk in range(WALKS):
            for size, table, key in window_keys(h, starts, items.sizes(stride), walk):
                if (stride, walk, size, table) not in items.tables:
                    continue
                known, item, offset, seen = items.tables[stride, walk, size, table]
                maybe = np.flatnonzero(seen[key >> np.uint64(48)])
                lo, hi = np.searchsorted(known, key[maybe], "left"), np.searchsorted(known, key[maybe], "right")
                n = hi - lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                start = np.repeat(starts[maybe], n)
                found.append(np.stack([item[at], start - offset[at], np.searchsorted(first, start, "right") - 1], 1))
    return np.unique(np.concatenate(found), axis=0)


def likely(h: np.ndarray, met: np.ndarray, items: Items, tolerance: float) -> np.ndarray:
    """The collisions whose stretch has all but the allowed number of words of the item, told by a few bits of each word: no match is lost."""
    low = np.uint64(1023)
    has, m = np.zeros((len(items.words), 1024), bool), np.array([len(w) for w in items.words], np.int64)
    for k, w in enumerate(items.words):
        has[k, w & low] = True
    h, kept = (h & low).astype(np.int64), [met[:0]]
    for part in np.array_split(met, len(met) // 4096 + 1):
        item, at = part[:, 0], part[:, 1]
        allowed = (tolerance * m[item]).astype(np.int64)
        slack = allowed + STRIDE + 2
        lo, hi = np.clip(at - slack, 0, len(h)), np.clip(at + m[item] + 2 * slack, 0, len(h))
        n = hi - lo
        ends = np.cumsum(n)
        word = h[np.repeat(lo - ends + n, n) + np.arange(n.sum())]
        shared = np.concatenate([[0], np.cumsum(has[np.repeat(item, n), word])])
        kept.append(part[shared[ends] - shared[ends - n] >= m[item] - allowed])
    return np.concatenate(kept)


def edit_distance(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int]:
    """Least word edits between the item and any part of the stretch, and the end of that part."""
    n = np.arange(len(stretch) + 1)
    row = np.zeros(len(stretch) + 1, np.int64)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (stretch != word))
        row = np.minimum.accumulate(new - n) + n
    end = int(row.argmin())
    return int(row[end]), end


def matches(own: np.ndarray, places: np.ndarray, items: Items, tolerance: float) -> Iterator[tuple]:
    """(item id, edits, words of the item, end) of the items that a document's words hold; ``places``: its collisions (item, place), sorted."""
    for number in np.unique(places[:, 0]):
        item = items.words[number]
        m = len(item)
        allowed = int(tolerance * m)
        slack, best, done = allowed + STRIDE + 2, None, -m - 1  # no place lies further before the text
        for at in places[places[:, 0] == number, 1]:
            if at <= done:  # the stretch before has covered this place
                continue
            lo, hi = max(0, at - slack), min(len(own), at + m + 2 * slack)
            done = at + slack // 2
            stretch = own[lo:hi]
            if np.isin(item, stretch).sum() < m - allowed:
                continue
            edits, end = edit_distance(item, stretch)
            if edits <= allowed and (best is None or edits < best[1]):
                best = items.ids[number], edits, m, lo + end
        if best:
            yield best


def found_in(column: pa.Array, items: Items, tolerance: float) -> Iterator[tuple]:
    """(row, item id, edits, words of the item, end) of the items that the texts of a column hold."""
    for w in words(column, lower=True):
        h = w.hashes()
        met = likely(h, collisions(h, items, w.first[:-1]), items, tolerance)
        met = met[np.argsort(met[:, 2], kind="stable")]
        rows, begin = np.unique(met[:, 2], return_index=True)
        for i, places in zip(rows.tolist(), np.split(met[:, :2], begin[1:])):
            for found in matches(h[w.of(i)], places - np.array([0, w.first[i]]), items, tolerance):
                yield w.lo + i, *found


def passes(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[Items]:
    """The benchmark in parts of about ``ITEMS_PER_PASS`` items, indexed."""
    listed = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    parts = listed.count() // ITEMS_PER_PASS + 1
    for k in range(parts):
        rows = listed.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect()  # about ITEMS_PER_PASS rows
        held = index([r[0] for r in rows], [r[1] for r in rows])
        if held.ids:
            yield held


def find_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document row and item it holds: doc_id, item_id, edits, item_words, end_word (the best match's end)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = T.StructType([docs.schema["doc_id"], T.StructField("item_id", benchmark.schema[item_id].dataType)] + T._parse_datatype_string("edits bigint, item_words bigint, end_word bigint").fields)
    kind = pa.string() if isinstance(benchmark.schema[item_id].dataType, T.StringType) else pa.int64()

    def one(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(zip(*found_in(batch.column(1), items, tolerance))) or [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], kind), *[pa.array(c, pa.int64()) for c in rows[2:]]], names=out.names)
        return docs.mapInArrow(run, out)

    result = docs.limit(0).mapInArrow(lambda b: iter(()), out)
    for items in passes(benchmark, item_id, item_text):
        result = result.unionByName(one(items))
    return result


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """The rows whose text holds no item, with their columns unchanged.  Every row is judged where it lies, without a join or shuffle."""
    def clean(items: Items):
        @F.arrow_udf("boolean")
        def of(column: pa.Array) -> pa.Array:
            ok = np.ones(len(column), bool)
            ok[[row for row, *_ in found_in(column, items, tolerance)]] = False
            return pa.array(ok)
        return of(F.col(text).cast("string"))

    for items in passes(benchmark, item_id, item_text):
        docs = docs.where(clean(items))
    return docs

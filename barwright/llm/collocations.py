"""Phrase collocations per language by direct-address tiling of ranked word ids.

Texts are lower-cased (A-Z), split at ``. , ; : ! ?`` and line breaks into pieces and those at blanks and tabs into words.  A candidate is a phrase of 2 to
``longest`` words inside a piece that occurs ``least`` times or more, overlaps included.

1. *Words* are counted in the map tasks and summed by Spark.  The ``HEAD`` most frequent ones get their rank as id; the table of their hashes travels with the tasks.
   Any other frequent word has one bit in a bitmap of at most 2^``MAP_BITS`` bits and is known by its hash; the bitmap may let rare words pass, which costs time
   and no correctness.
2. *Pairs.*  A task turns words into ids.  The plane of id pairs is cut into tiles of ``TILE`` x ``TILE``: a tile with many occurrences is counted by a dense
   bincount of the direct address, sparse tiles as sorted coordinates.  Sums leave the task under the hashes of the words, so ids need not agree between languages or runs.
3. *Recursion.*  Pairs that reach ``least`` are ranked by frequency like words and get ids themselves; a phrase of three words is a pair of
   (frequent pair, word) whose last two words are frequent as well, and so on up to ``longest``.
4. *Scores.*  Cutting a phrase after its first k words gives l = f(first part) and r = f(rest); the score is the least of ``floor(10^6 * a * a / (l * r))`` in
   exact decimals (38 digits), ties to the smallest k.  A phrase goes if one word more makes a candidate with ``100 * f >= share * a``; longer ones
   cannot be more frequent, so one word more is all there is to look at.

Null texts are empty; a null language is ``und``.  Rows that repeat a doc_id count like any others (ids are not read).  Equal scores are ordered by a, then by the phrase in byte order.
An empty table, or one without candidates, gives an empty result.  Words are told apart by 64-bit hashes of (language, word).
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .store import written
from .text import Words, mix, pieces, windows, words

HEAD, MAP_BITS = 1 << 17, 26
TILE, DENSE = 512, 1 << 16
CHUNK = 1 << 20
SHARES = 8
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[10, 11, 12, 13, *b".,;:!?"]] = 10  # every break of pieces becomes a line feed


def piece_words(column: pa.Array) -> Iterator[tuple[Words, np.ndarray]]:
    """Words of the rows and the number of the piece that each lies in, a slice of rows at a time."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    raw = _CLASS[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
    plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, offsets, pa.py_buffer(raw)], offset=column.offset)
    for w in words(plain, lower=True):
        breaks = np.flatnonzero(w.raw == 10)
        yield w, np.searchsorted(breaks, w.starts) + w.row_of_word()


def language_hashes(w: Words, lang: pa.Array) -> np.ndarray:
    """One 64-bit value for every (language, word)."""
    own = lang.slice(w.lo, w.hi - w.lo).dictionary_encode()
    values = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in own.dictionary.to_pylist()], np.uint64)
    return mix(w.hashes(5) ^ values[own.indices.to_numpy()][w.row_of_word()]) if len(w.starts) else np.zeros(0, np.uint64)


def _chunks(batches: Iterator[pa.RecordBatch]):
    """(word hashes, piece numbers) of about ``CHUNK`` words at a time; piece numbers differ between all rows of a chunk."""
    held, n, base = [], 0, 0
    for batch in pieces(batches):
        lang = batch.column(0)
        for w, piece in piece_words(batch.column(1)):
            if len(piece):
                held.append((language_hashes(w, lang), piece + base))
                n, base = n + len(piece), base + int(piece[-1]) + 1
            if n >= CHUNK:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, n, base = [], 0, 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, h, n) of slices of rows."""
    for batch in pieces(batches):
        lang = batch.column(0)
        for w, _ in piece_words(batch.column(1)):
            h = language_hashes(w, lang)
            value, at, n = np.unique(h, return_index=True, return_counts=True)
            length = w.ends[at] - w.starts[at]
            offsets = np.concatenate([[0], np.cumsum(length)])
            inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], length)
            text = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(w.raw[np.repeat(w.starts[at], length) + inside]))
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(w.lo + w.row_of_word()[at])), text.cast(pa.string()), pa.array(value.view(np.int64)), pa.array(n)], names=["lang", "word", "h", "n"])


@dataclass
class Ranked:
    """Frequent units: ``table[id]`` holds the word hashes of the unit of a rank; ``bits`` marks the frequent units beyond the ranked ones."""
    table: np.ndarray
    bits: np.ndarray

    def __post_init__(self):
        key = self.keys(self.table)
        self.order = np.argsort(key, kind="stable")
        self.sorted = key[self.order]

    @staticmethod
    def keys(table: np.ndarray) -> np.ndarray:
        """One value for each row of word hashes; of one word its hash."""
        return table[:, 0] if table.shape[1] == 1 else windows(table.reshape(-1), table.shape[1])[::table.shape[1]]

    def ids(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each key, -1 without one; and whether the unit may be frequent."""
        if not len(self.sorted):
            rank = np.full(len(key), -1)
        else:
            at = np.minimum(np.searchsorted(self.sorted, key), len(self.sorted) - 1)
            rank = np.where(self.sorted[at] == key, self.order[at], -1)
        maybe = rank >= 0
        if len(self.bits):
            bit = mix(key) % np.uint64(8 * len(self.bits))
            maybe |= (self.bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return rank, maybe


def _numbered(key: np.ndarray, unit: np.ndarray, ranked: Ranked, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of units: the rank, or a number beyond the ranks for each other key; and the word hashes of every id."""
    rest = np.flatnonzero(rank < 0)
    _, at, of = np.unique(key[rest], return_index=True, return_inverse=True)
    out = rank.copy()
    out[rest] = len(ranked.table) + of.reshape(-1)
    return out, np.concatenate([ranked.table, unit[rest[at]]])


def count_pairs(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b) and their counts.  Ids are ranks, so frequent pairs gather in few tiles, which are counted densely; sparse tiles are sorted."""
    across = n_b // TILE + 1
    tile = (a // TILE) * across + b // TILE
    own, size = np.unique(tile, return_counts=True)
    dense = own[size >= DENSE]
    out, left = [], np.ones(len(a), bool)
    for t in dense.tolist():
        inside = tile == t
        left &= ~inside
        cell = np.bincount((a[inside] % TILE) * TILE + b[inside] % TILE, minlength=TILE * TILE)
        some = np.flatnonzero(cell)
        out.append((some // TILE + t // across * TILE, some % TILE + t % across * TILE, cell[some]))
    code, n = np.unique(a[left] * np.int64(n_b) + b[left], return_counts=True)
    out.append((code // n_b, code % n_b, n))
    return tuple(np.concatenate(x) for x in zip(*out))


def _counted_phrases(batches: Iterator[pa.RecordBatch], size: int, single: Ranked, parts: Ranked) -> Iterator[pa.RecordBatch]:
    """(w0, ..., n): phrases of ``size`` words whose parts of size - 1 words may be frequent."""
    names = [f"w{k}" for k in range(size)] + ["n"]
    for h, piece in _chunks(batches):
        n = len(h) - size + 1
        if n <= 0:
            continue
        rank, maybe = single.ids(h)
        part_key = h if size == 2 else windows(h, size - 1)
        part_rank, part_maybe = (rank, maybe) if size == 2 else parts.ids(part_key)
        at = np.flatnonzero((piece[:n] == piece[size - 1:]) & part_maybe[:n] & part_maybe[1:n + 1])
        stretch = np.stack([h[at + k] for k in range(size - 1)], axis=1) if len(at) else np.zeros((0, size - 1), np.uint64)
        first, first_table = _numbered(part_key[at], stretch, parts, part_rank[at])
        last, last_table = _numbered(h[at + size - 1], h[at + size - 1][:, None], single, rank[at + size - 1])
        a, b, n = count_pairs(first, last, len(first_table), len(last_table))
        columns = [first_table[a, k] for k in range(size - 1)] + [last_table[b, 0]]
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns] + [pa.array(n)], names=names)


def ranked_units(units: DataFrame, columns: list[str], head: int, map_bits: int) -> Ranked:
    """The ``head`` most frequent rows of (columns, n) with their ranks, and a bitmap of all others; both have a fixed bound."""
    top = units.orderBy(F.desc("n"), *columns).limit(head).select(columns).toArrow()
    table = np.stack([top.column(c).to_numpy() for c in columns], axis=1).view(np.uint64) if len(top) else np.zeros((0, len(columns)), np.uint64)
    more = units.count() - len(top)
    if more <= 0:
        return Ranked(table, np.zeros(0, np.uint8))
    bits = min(1 << map_bits, 1 << (16 * more - 1).bit_length())
    width = max(bits // 64, 8)  # about 64 stretches of the bitmap, each made by one group

    def places(batches):
        for batch in batches:
            value = np.stack([batch.column(k).to_numpy() for k in range(len(columns))], axis=1).view(np.uint64)
            bit = np.unique(mix(Ranked.keys(np.ascontiguousarray(value))) % np.uint64(bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bit // width), pa.array(bit % width)], names=["stretch", "bit"])

    def stretch(key, group):
        marks = np.zeros(width, np.uint8)
        marks[group.column("bit").to_numpy()] = 1
        return pa.table({"stretch": [key[0].as_py()], "marks": [np.packbits(marks, bitorder="little").tobytes()]})
    found = units.select(columns).mapInArrow(places, "stretch bigint, bit bigint").distinct().groupBy("stretch").applyInArrow(stretch, "stretch bigint, marks binary").toArrow()
    out = np.zeros(bits // 8, np.uint8)
    for k, m in zip(found.column("stretch").to_pylist(), found.column("marks").to_pylist()):
        out[k * width // 8:(k + 1) * width // 8] = np.frombuffer(m, np.uint8)
    return Ranked(table, out)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, per_lang: int = 2000, text: str = "text", lang: str = "lang",
                 head: int | None = None, map_bits: int = MAP_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``per_lang`` phrases by score, a and phrase."""
    if longest < 2:
        raise ValueError("a phrase has two words or more")
    head = HEAD if head is None else head
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    counted = written(docs.mapInArrow(_counted_words, "lang string, word string, h bigint, n bigint").groupBy("lang", "word", "h").agg(F.sum("n").cast("bigint").alias("n")), "words")
    totals = counted.groupBy("lang").agg(F.sum("n").cast("bigint").alias("total"))
    levels = {1: written(counted.where(F.col("n") >= least).select(F.col("h").alias("w0"), "n", "lang", "word"), "frequent-words")}
    columns = [f"w{k}" for k in range(longest)]
    single = parts = ranked_units(levels[1].select("w0", "n"), ["w0"], head, map_bits)
    for size in range(2, longest + 1):
        if size > 2:
            parts = ranked_units(levels[size - 1], columns[:size - 1], head, map_bits)
        schema = ", ".join(f"{c} bigint" for c in [*columns[:size], "n"])

        def count(batches, size=size, parts=parts):
            return _counted_phrases(batches, size, single, parts)
        levels[size] = written(docs.mapInArrow(count, schema).groupBy(columns[:size]).agg(F.sum("n").cast("bigint").alias("n")).where(F.col("n") >= least), f"phrases-{size}")
    scored = [_scored(levels, size, columns, share, size < longest) for size in range(2, longest + 1)]
    everything = scored[0]
    for s in scored[1:]:
        everything = everything.unionByName(s)
    # a language is ranked in shares first, so that the last task of each sees SHARES * per_lang rows at most
    best = [F.desc("score"), F.desc("a"), "phrase"]
    shared = everything.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*best)))
    first = shared.where(F.col("rank") <= per_lang).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= per_lang)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _scored(levels: dict[int, DataFrame], size: int, columns: list[str], share: int, may_grow: bool) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of ``size`` words that no longer candidate replaces."""
    own = columns[:size]
    out = levels[size].select(*own, F.col("n").alias("a"))
    if may_grow:
        longer = levels[size + 1]
        inside = longer.select(*own, "n").unionByName(longer.select(*[F.col(f"w{k + 1}").alias(c) for k, c in enumerate(own)], "n")).groupBy(own).agg(F.max("n").alias("_longer"))
        out = out.join(inside, own, "left").where(F.expr(f"_longer is null or 100 * cast(_longer as decimal(20)) < {share} * cast(a as decimal(20))")).drop("_longer")
    for lo, hi in [(0, k) for k in range(1, size)] + [(k, size) for k in range(1, size)]:  # the frequency of every first part and every rest
        part = levels[hi - lo].select(*[F.col(f"w{j}").alias(f"w{lo + j}") for j in range(hi - lo)], F.col("n").alias(f"f{lo}_{hi}"))
        out = out.join(part, [f"w{lo + j}" for j in range(hi - lo)])
    whole = "cast(cast(1000000 as decimal(7)) * cast(a as decimal(15)) * cast(a as decimal(15)) as decimal(38)) div (cast(f0_{k} as decimal(19)) * cast(f{k}_{n} as decimal(18)))"
    cuts = [F.struct(F.expr(whole.format(k=k, n=size)).alias("score"), F.lit(k).alias("k"), F.col(f"f0_{k}").alias("l"), F.col(f"f{k}_{size}").alias("r")) for k in range(1, size)]
    out = out.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0])
    for k in range(size):
        name = levels[1].select(F.col("w0").alias(f"w{k}"), F.col("word").alias(f"t{k}"), *([F.col("lang")] if k == 0 else []))
        out = out.join(name, f"w{k}")
    return out.select("lang", F.concat_ws(" ", *[f"t{k}" for k in range(size)]).alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))

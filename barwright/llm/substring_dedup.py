"""Removal of repeated passages: every word covered by a window of ``size`` words that also starts earlier in the corpus.

Earlier means a smaller doc_id, or the same document and an earlier start.  Three steps:

1. *Sketch.*  Each task counts its windows in a count-min sketch: a window is counted under its anchor, the smallest hash among the 8-word
   grams inside it, at each place where that gram is chosen.  A window that occurs twice has its anchor chosen at two places at least, so a
   cell never counts less than the window occurs.  The sketch has one row of ``WIDTH`` cells and is kept as (cell, count) pairs, so partition
   sketches merge by adding up and grow with the data.  Neighbouring windows share anchors: a text has about one anchor in seven words.
2. *Candidates.*  A document keeps the anchors whose cell counts two or more (a join with the repeated cells).  Windows under such an anchor
   are estimated repeated; no repeated window is missing.  A document that repeats the whole text of an earlier one is settled here, so a
   group of exact copies enters the next step once.
3. *Exact groups.*  Candidate windows are grouped by a 128-bit value of their words.  The group keeps only its first doc_id: an aggregate
   that combines in the map tasks, so a passage in a third of all documents costs one row per task.  Each document then learns which windows
   it is the first to hold; of these the earliest start stays, and the words of all other candidate windows go.

Texts travel between tasks as Zstandard bytes, which more than halves what is shuffled.

Null and empty texts have no words and lose none.  Texts shorter than a window lose none.  Rows with equal doc_id are each other's equals, with
equal texts or not: neither removes words of the other.  A null doc_id counts as largest.  An empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from .store import dealt, kept_dealt, written
from .text import Words, covered, inside_rows, mix, pieces, windows, words

SIZE = 20
GRAM = 8
WIDTH = 1 << 44
_FLUSH = 1 << 21


def _sliding(values: np.ndarray, n: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``n`` neighbouring values."""
    have, out = 1, values
    while have * 2 <= n:
        out = pick(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    rest = n - have
    return out if not rest else pick(out[:-rest], out[rest:]) if len(out) > rest else out[:0]


def anchors(w: Words, size: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows of a slice and the sketch cell of each; places where a gram is chosen as anchor and their cells."""
    rows = w.row_of_word()
    grams = windows(w.hashes(), gram)
    if len(rows) < size:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    lowest = _sliding(grams, size - gram + 1, np.minimum)
    ok = inside_rows(rows, size)
    starts = np.flatnonzero(ok)
    # a gram is chosen if it is the lowest of some window inside its row that contains it
    span = size - gram + 1
    floor = np.zeros(len(grams), np.uint64)
    padded = np.zeros(len(lowest) + 2 * (span - 1), np.uint64)
    padded[span - 1:span - 1 + len(lowest)] = np.where(ok, lowest, np.uint64(0))
    best = _sliding(padded, span, np.maximum)
    floor[:len(best)] = best[:len(grams)]
    chosen = np.flatnonzero(floor == grams)
    return starts, _cells(lowest[starts]), chosen, _cells(grams[chosen])


def _cells(values: np.ndarray) -> np.ndarray:
    return (values % np.uint64(WIDTH)).astype(np.int64)


def partition_sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The (cell, count) pairs of one task's texts; a flush bounds the memory."""
    held: list[np.ndarray] = []
    total = 0

    def flush():
        cells, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.minimum(n, 2).astype(np.int64))], names=["cell", "n"])

    for batch in batches:
        for w in words(batch.column(0)):
            held.append(anchors(w, size)[3])
            total += len(held[-1])
            if total >= _FLUSH:
                yield flush()
                held, total = [], 0
    if held:
        yield flush()


def document_cells(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, cell) of every document's anchors, each once."""
    for batch in batches:
        ids = batch.column(0)
        for w in words(batch.column(1)):
            _, _, at, cells = anchors(w, size)
            rows = w.row_of_word()[at]
            once = np.unique(cells ^ mix(rows.astype(np.uint64) + np.uint64(1)).view(np.int64), return_index=True)[1]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[once] + w.lo)), pa.array(cells[once])], names=["doc", "cell"])


def _join(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join([data[s:e] for s, e in zip(starts.tolist(), ends.tolist())])


def _said(kept: bytes, texts: bool) -> str:
    return kept.decode("utf-8", "replace") if texts else hashlib.sha256(kept).hexdigest()


def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column (texts) as Zstandard bytes."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [None if t is None else pack.compress(t.encode()) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], names=batch.schema.names)


def _unzipped(column: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([None if z is None else unpack.decompress(z) for z in column.to_pylist()], pa.binary()).cast(pa.string())


def candidates(batches: Iterator[pa.RecordBatch], size: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """Per document: n_words, then for a settled one n_removed and what is kept, for an open one its text and candidate starts (packed).

    Input columns: place, doc, rest, zip, copy, cells.  A document without candidates, and a copy of an earlier one, is settled.
    """
    for batch in pieces(batches):
        text, copy, cells = _unzipped(batch.column(3)), batch.column(4).to_pylist(), batch.column(5)
        n_words, n_removed, kept, opened, packed = [], [], [], [], []
        for w in words(text):
            starts, cell, _, _ = anchors(w, size)
            cut, data = np.searchsorted(starts, w.first), w.raw.tobytes()
            for i in range(w.hi - w.lo):
                row, n, at = w.lo + i, int(w.counts[i]), w.of(i)
                found = np.zeros(0, np.uint32)
                if cells[row].is_valid and not copy[row]:
                    inside = slice(cut[i], cut[i + 1])
                    mine = cells[row].values.to_numpy(zero_copy_only=False)
                    found = (starts[inside][np.isin(cell[inside], mine)] - w.first[i]).astype(np.uint32)
                gone = bool(copy[row]) and n >= size
                n_words.append(n)
                n_removed.append(None if len(found) else n if gone else 0)
                kept.append(None if len(found) else _said(b"", texts) if gone else text[row].as_py() if texts else _said(_join(data, w.starts[at], w.ends[at]), False))
                opened.append(row if len(found) else None)
                packed.append(found.tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()),
                                          batch.column(3).take(pa.array(opened, pa.int64())), pa.array(packed, pa.binary())], names=["place", "doc", "rest", "n_words", "n_removed", "kept", "zip", "starts"])


def window_keys(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(doc, k1, k2) of every candidate window; the two keys hold 128 bits of its words.  Input columns: doc, zip, starts."""
    for batch in pieces(batches):
        packed = batch.column(2)
        for w in words(_unzipped(batch.column(1))):
            first, second = windows(w.hashes(1), size), windows(w.hashes(2), size, 11)
            marks = [np.frombuffer(packed[w.lo + i].as_py(), np.uint32).astype(np.int64) for i in range(w.hi - w.lo)]
            row = np.repeat(np.arange(w.lo, w.hi), [len(m) for m in marks])
            where = np.concatenate(marks) + w.first[row - w.lo]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(first[where].view(np.int64)), pa.array(second[where].view(np.int64))], names=["doc", "k1", "k2"])


def settle(batches: Iterator[pa.RecordBatch], size: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """The open documents, settled.  Input columns: doc, rest, zip, starts, firsts (first keys of the windows that no smaller doc_id holds)."""
    for batch in pieces(batches):
        text, packed, firsts = _unzipped(batch.column(2)), batch.column(3), batch.column(4)
        n_words, n_removed, kept = [], [], []
        for w in words(text):
            data, keys, seconds = w.raw.tobytes(), windows(w.hashes(1), size), windows(w.hashes(2), size, 11)
            for i in range(w.hi - w.lo):
                row, n, at = w.lo + i, int(w.counts[i]), w.of(i)
                marks = np.frombuffer(packed[row].as_py(), np.uint32).astype(np.int64)
                if firsts[row].is_valid:
                    own = np.rec.fromarrays([keys[marks + w.first[i]], seconds[marks + w.first[i]]])
                    earliest = np.zeros(len(marks), bool)
                    earliest[np.unique(own, return_index=True)[1]] = True
                    mine = firsts[row].values
                    held = np.rec.fromarrays([mine.field(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1)])
                    marks = marks[~(earliest & np.isin(own, held))]
                keep = ~covered(marks, size, n)
                n_words.append(n)
                n_removed.append(n - int(keep.sum()))
                kept.append(text[row].as_py() if texts and not n_removed[-1] else _said(_join(data, w.starts[at][keep], w.ends[at][keep]), texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                                         names=["doc", "rest", "n_words", "n_removed", "kept"])


def _schema(df: DataFrame, names: str, more: str = "") -> T.StructType:
    return T.StructType([df.schema[c] for c in names.split()] + list(T._parse_datatype_string(more).fields if more else []))


def repeats_removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, texts: bool = False) -> DataFrame:
    """Per row of ``docs``: doc, rest (a struct of its other columns), n_words, n_removed and kept.

    ``kept`` is the SHA-256 of the kept words joined by one space; with ``texts`` those words themselves, or the unchanged text where nothing
    is removed.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (doc_id, text)]
    docs = docs.select(F.col(doc_id).alias("doc"), F.struct(*others, F.lit(None).cast("int").alias("_")).alias("rest"), F.col(text).cast("string").alias("text"))
    sketch = docs.select("text").mapInArrow(lambda b: partition_sketch(b, size), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    repeated = written(sketch.where("n >= 2").select("cell"), "repeated-cells")
    # joins by document go by one column that is never null: a null doc_id has the empty name
    place = lambda doc: F.coalesce(F.concat(F.lit("="), F.col(doc).cast("string")), F.lit("")).alias("place")
    hot = (docs.select("doc", "text").mapInArrow(lambda b: document_cells(b, size), _schema(docs, "doc", "cell bigint")).join(repeated, "cell", "left_semi")
           .select(place("doc"), "cell", F.lit(None).cast("binary").alias("key")))
    valued = docs.select("doc", "rest", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    keyed = valued.select("doc", "key").where("key is not null")
    groups = keyed.groupBy("key").agg(F.min("doc").alias("first"), F.count("*").alias("rows")).where("rows > 1").select("key", "first")
    later = keyed.join(groups, "key").where(~F.col("doc").eqNullSafe(F.col("first"))).select(place("doc"), F.lit(None).cast("bigint").alias("cell"), "key").distinct()
    marks = hot.unionByName(later).groupBy("place").agg(F.collect_list("cell").alias("cells"), F.collect_list("key").alias("copies"))
    # the texts move once: they stay where this join puts them, and the second join brings the first windows to them
    small = dealt(valued.mapInArrow(zipped, _schema(valued, "doc rest key", "zip binary")).withColumn("place", place("doc")), "place")
    marked = small.join(marks, "place", "left").select("place", "doc", "rest", "zip", F.coalesce(F.array_contains("copies", F.col("key")), F.lit(False)).alias("copy"), "cells")
    staged = kept_dealt(marked.mapInArrow(lambda b: candidates(b, size, texts), T.StructType([T.StructField("place", T.StringType())] + _schema(
        docs, "doc rest", "n_words bigint, n_removed bigint, kept string, zip binary, starts binary").fields)), "staged", "place")
    opened = staged.where("starts is not null")
    keys = opened.select("doc", "zip", "starts").mapInArrow(lambda b: window_keys(b, size), _schema(docs, "doc", "k1 bigint, k2 bigint"))
    first = keys.groupBy("k1", "k2").agg(F.min("doc").alias("doc"))
    firsts = first.groupBy(place("doc")).agg(F.collect_list(F.struct("k1", "k2")).alias("firsts"))
    joined = opened.join(firsts, "place", "left").select("doc", "rest", "zip", "starts", "firsts")
    done = joined.mapInArrow(lambda b: settle(b, size, texts), _schema(docs, "doc rest", "n_words bigint, n_removed bigint, kept string"))
    return staged.where("starts is null").select(*done.columns).unionByName(done)


def remove_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` with the repeated words taken out of their texts (the others joined by one space); other columns and untouched texts stay."""
    out = repeats_removed(docs, doc_id, text, size, texts=True)
    value = {doc_id: F.col("doc"), text: F.col("kept")}
    return out.select(*[value[c].alias(c) if c in value else F.col("rest")[c].alias(c) for c in docs.columns])

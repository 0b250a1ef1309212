"""SimHash near-duplicate groups: fingerprints of word shingles, linked by covering locality-sensitive hashing.

1. *Fingerprints.*  A-Z are lower-cased; a document's shingles are its runs of ``size`` words, joined by one space, repeats included; a shorter text has its
   whole word sequence as its only shingle.  A bit of the 64-bit fingerprint is 1 if more than half of the shingles' XXH64 values (seed 42) have it.
2. *Covering masks.*  Every bit gets a nonzero vector of radius + 1 bits, all vectors about equally often; there is one mask for each nonzero
   vector v, made of the bits whose own vector has an odd product with v.  The vectors of the at most ``radius`` bits in which two fingerprints differ span less than
   the whole space, so some v is orthogonal to all of them: under its mask the two are equal.  Hence every pair within the radius
   meets in some of the 2^(radius + 1) - 1 tables, for certain and not just likely.
3. *Buckets.*  Documents of one fingerprint are one node.  Nodes that agree under a mask share a bucket.  A bucket of at most ``LEAF`` nodes is compared in
   memory and leaves a spanning forest of its links, never its pairs.  A larger one is cut again by the covering masks of the bits that its mask left
   open, which lose no pair either; as nodes of a bucket differ, a bucket with few open bits is small, so the cutting ends by itself.
4. *Groups.*  Components of all links.  Fingerprints that a thousandth of the documents share (fewer than 1,000 can exist) are joined by broadcast, all others by a shuffle.

Null, empty and wordless texts have fingerprint zero, which is linked like any other.  Rows that repeat a doc_id each have their own fingerprint.  Rows with a null doc_id
belong to the group of their text; a group of such rows only has a null component_id.  An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .near_dedup import components
from .store import temporary, written
from .text import pieces, words

BITS, SEED = 64, 42
LEAF = 512
_SLICE = 1 << 15


def shingle_hashes(raw: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(raw[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts))


def fingerprints_of(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Fingerprints of the rows, a slice of rows at a time."""
    for w in words(column, lower=True):
        rows = w.hi - w.lo
        length = w.ends - w.starts
        starts = np.cumsum(length + 1) - length - 1  # words of the slice joined by single blanks
        inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        raw = np.full(int((length + 1).sum()), 32, np.uint8)
        raw[np.repeat(starts, length) + inside] = w.raw[np.repeat(w.starts, length) + inside]
        ends, first, n = starts + length, w.first[:-1], w.counts
        # shingles of row i begin at its words, the last size - 1 of them excepted
        many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        begin = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        last = np.repeat(np.minimum(n, size) - 1, many) + begin
        raw, ones, of = raw.tobytes(), np.zeros((rows, BITS), np.int64), np.repeat(np.arange(rows), many)
        for lo in range(0, len(begin), _SLICE):
            part = slice(lo, lo + _SLICE)
            h = shingle_hashes(raw, starts[begin[part]].tolist(), ends[last[part]].tolist())
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            own, at = np.unique(of[part], return_index=True)
            ones[own] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        yield np.packbits(2 * ones > many[:, None], axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def _fingerprinted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        parts = list(fingerprints_of(batch.column(1), size))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts).view(np.int64))], names=["doc_id", "fp"])


def covering_masks(bits: np.ndarray, radius: int) -> np.ndarray:
    """Masks over the given bit positions; two values that differ in at most ``radius`` of these bits are equal under one of them at least."""
    n = (1 << (radius + 1)) - 1
    own = np.arange(len(bits)) % n + 1
    odd = np.array([[(int(x) & v).bit_count() & 1 for x in own] for v in range(1, n + 1)], bool)
    return np.array([sum(1 << int(b) for b in bits[o]) for o in odd], np.uint64)


def _open_bits(mask: int) -> np.ndarray:
    return np.array([b for b in range(BITS) if not mask >> b & 1])


def _cut(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """(mask, place, fp) under every mask that cuts the bucket of a row.  Input columns: mask, fp."""
    known: dict[int, np.ndarray] = {}
    for batch in pieces(batches, 4096):
        mask, fp = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
        for m in np.unique(mask).tolist():
            if m not in known:
                known[m] = np.unique(covering_masks(_open_bits(m), radius) | np.uint64(m))
            own = fp[mask == m]
            for finer in known[m]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), finer).view(np.int64)), pa.array((own & finer).view(np.int64)), pa.array(own.view(np.int64))],
                                                 names=["mask", "place", "fp"])


def forest(bucket: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside buckets; rows of a bucket (numbered in rising order) are neighbours."""
    n = len(fp)
    run = np.searchsorted(bucket, bucket, "right") - np.arange(n)  # rows of the bucket from here on
    label, links, reach, lag = np.arange(n), [], np.flatnonzero(run > 1), 1
    while len(reach):
        near = reach[np.bitwise_count(fp[reach] ^ fp[reach + lag]) <= radius]
        links.append(np.stack([near, near + lag]))
        lag += 1
        reach = reach[run[reach] > lag]
    if not links:
        return (np.zeros(0, np.int64),) * 2
    a, b = np.concatenate(links, axis=1)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(n))
    return fp[label[child]].view(np.int64), fp[child].view(np.int64)


def _leaves(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of buckets whose rows follow each other; the last bucket of a batch waits for the next one."""
    rest = [np.zeros(0, np.uint64)] * 3
    for batch in pieces(batches, 1 << 13):
        mask, place, fp = (np.concatenate([r, batch.column(k).to_numpy().view(np.uint64)]) for k, r in enumerate(rest))
        number = np.cumsum(np.concatenate([[0], (mask[1:] != mask[:-1]) | (place[1:] != place[:-1])])) if len(mask) else np.zeros(0, np.int64)
        done = np.searchsorted(number, number[-1]) if len(number) else 0
        rest = [mask[done:], place[done:], fp[done:]]
        a, b = forest(number[:done], fp[:done], radius)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    a, b = forest(np.zeros(len(rest[2]), np.int64), rest[2], radius)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(nodes: DataFrame, radius: int = 3, leaf: int | None = None) -> DataFrame:
    """(a, b): links that join all distinct values ``fp`` within ``radius`` bits into their components (not every pair is listed)."""
    leaf = LEAF if leaf is None else leaf
    level, found = nodes.select(F.lit(0).cast("bigint").alias("mask"), "fp"), None
    while True:
        cut = written(level.mapInArrow(lambda b: _cut(b, radius), "mask bigint, place bigint, fp bigint"), "simhash-buckets")
        sizes = written(cut.groupBy("mask", "place").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
        sized = cut.join(sizes, ["mask", "place"])
        small = sized.where(F.col("n") <= leaf).select("mask", "place", "fp").repartition("mask", "place").sortWithinPartitions("mask", "place")
        met = written(small.mapInArrow(lambda b: _leaves(b, radius), "a bigint, b bigint").distinct(), "simhash-links")
        found = met if found is None else found.unionByName(met)
        if sizes.where(F.col("n") > leaf).isEmpty():
            return found.distinct()
        # nodes of a large bucket go on, each mask with the places it has left; a node stands once under each mask
        level = written(sized.where(F.col("n") > leaf).select("mask", "fp").distinct(), "simhash-large")


def fingerprints(docs: DataFrame, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of every row as a signed number."""
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lambda b: _fingerprinted(b, size), "doc_id bigint, fp bigint")


def simhash_groups(docs: DataFrame, radius: int = 3, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint (16 lower-case hex digits) and component_id (the smallest doc_id of its group)."""
    spark = docs.sparkSession
    found = written(fingerprints(docs, size, doc_id, text), "simhash-fingerprints")
    nodes = written(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-nodes")
    with temporary(spark):
        comp = components(links(nodes, radius))
        member = nodes.join(comp.select(F.col("doc").alias("fp"), "comp"), "fp", "left").select("fp", "first", "n", F.coalesce("comp", "fp").alias("comp"))
        heads = member.groupBy("comp").agg(F.min("first").alias("component_id"))
        group = written(member.join(heads, "comp").select("fp", "n", "component_id"), "simhash-groups", stays=True)
    total = found.count()
    hot = group.where(F.col("n") * 1000 > total).select("fp", "component_id")
    in_hot = found.join(F.broadcast(hot), "fp")
    others = found.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(group.select("fp", "component_id"), "fp")
    return in_hot.select("doc_id", "fp", "component_id").unionByName(others.select("doc_id", "fp", "component_id")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

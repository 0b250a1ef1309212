"""Near-duplicate groups over whole texts: banded MinHash candidates, sequential Bayesian pruning, exact verification.

A document's set holds its distinct shingles of five words (A-Z lower-cased); a shorter text has its whole word sequence as the only element.
Documents are linked when ``100 * intersection >= 75 * union``; groups are the connected components.

1. *Features.*  One pass gives each document the size of its set, a 128-bit value of the set and ``HASHES`` minima.  Documents with equal sets
   form a class with the smallest doc_id in front, so exact copies, however many, enter once.
2. *Bands.*  Minima are cut into bands of ``ROWS``; classes that agree in a band share a bucket.  At the threshold a pair shares none of the 32
   bands with probability 5e-6.  A bucket is known by its smallest member (an aggregate that combines in the map tasks).
3. *Stars.*  Each member is compared with the smallest member of its buckets, in batches of ``BATCH`` minima.  After a batch with m
   of n equal minima the similarity has the posterior Beta(m + 1, n - m + 1); a pair whose posterior probability of reaching the threshold is
   below ``MISS`` is dropped.  The most similar survivor of each member is verified on the full sets.
4. *Rest.*  A bucket that still holds several components is cut into blocks of at most ``BLOCK`` members.  Every pair of blocks is one small group
   that some task works off: its pairs of different components are pruned the same way, the survivors verified on the full sets, and one link
   for each pair of components that meet leaves the task.  Pairs inside the largest component of a bucket are never looked at.
   So no bucket is capped, no link between components is left out, and no list of pairs is made.

Null and empty texts have an empty set and are linked with nothing.  Rows that repeat a doc_id with equal texts are one document; with different
texts, each row takes the group of its own text, and where the doc_id is the smallest of two groups these are one.  Rows with a null doc_id are not documents and are left out.  An empty
table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import temporary, written
from .text import Words, inside_rows, mix, randoms, windows, words

SHINGLE = 5
HASHES, ROWS, BATCH = 128, 4, 16
MISS = 1e-6
BLOCK = 256
_ODD, _ADD = randoms(21, HASHES) | np.uint64(1), randoms(22, HASHES)


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each batch end: the fewest equal minima with which a pair goes on.  P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every distinct element of the rows' sets, sorted by row."""
    h, rows, n = w.hashes(), w.row_of_word(), w.counts
    ok = np.flatnonzero(inside_rows(rows, size))
    of, value = [rows[ok]], [windows(h, size)[ok]]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):  # the whole sequence; its length takes part, so it equals no full shingle
        total = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = n[short] > j
            total[has] += h[w.first[short[has]] + j] * (randoms(31, size)[j] | np.uint64(1))
        of.append(short)
        value.append(mix(total + n[short].astype(np.uint64)))
    of, value = np.concatenate(of), np.concatenate(value)
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    return of[new], value[new]


def features(batches: Iterator[pa.RecordBatch], size: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    """(doc, n, key, sig): size of the set, its 128-bit value, its minima as 32-bit integers.  Input columns: doc, text."""
    for batch in batches:
        for w in words(batch.column(1), lower=True, limit=1 << 18):
            rows = w.hi - w.lo
            of, value = shingles(w, size)
            n = np.bincount(of, minlength=rows)
            some = np.flatnonzero(n)
            begin = np.concatenate([[0], np.cumsum(n[some])])[:-1]
            sig = np.zeros((rows, HASHES), np.uint32)
            key = np.zeros((rows, 2), np.uint64)
            if len(some):
                for k in range(HASHES):
                    sig[some, k] = (np.minimum.reduceat(value * _ODD[k] + _ADD[k], begin) >> np.uint64(32)).astype(np.uint32)
                key[some, 0] = np.add.reduceat(value, begin)
                key[some, 1] = np.add.reduceat(mix(value ^ np.uint64(0x5851F42D4C957F2D)), begin)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(w.lo, rows), pa.array(n.astype(np.int64)), pa.array([k.tobytes() if c else None for k, c in zip(key, n)], pa.binary()),
                 pa.array([s.tobytes() if c else None for s, c in zip(sig, n)], pa.binary())], names=["doc", "n", "key", "sig"])


def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, doc) of every band.  Input columns: doc, sig."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
        for k in range(HASHES // ROWS):
            value = np.full(len(sig), k + 1, np.uint64) * randoms(41, 1)[0]
            for j in range(ROWS):
                value = mix(value + sig[:, k * ROWS + j])
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), batch.column(0)], names=["bucket", "doc"])


def _likely(a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs (rows of a and b) that outlast every batch, and their equal minima."""
    left, same = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, m in enumerate(least):
        at = slice(k * BATCH, (k + 1) * BATCH)
        same += (a[left, at] == b[left, at]).sum(1)
        stay = same >= m
        left, same = left[stay], same[stay]
    return left, same


def compare_pairs(batches: Iterator[pa.RecordBatch], least: list[int]) -> Iterator[pa.RecordBatch]:
    """The pairs whose minima leave them a chance, with their equal minima.  Input columns: a, b, sig_a, sig_b."""
    for batch in batches:
        sig = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, HASHES) for k in (2, 3)]
        left, same = _likely(*sig, least)
        at = pa.array(left)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(same)], names=["a", "b", "same"])


def compare_blocks(table: pa.Table, least: list[int], percent: int, size: int) -> pa.Table:
    """One verified link (components a < b) for each two components that meet in a pair of blocks.

    Columns: left and right (in which of the two blocks a row stands), comp, sig, text.
    """
    table = table.combine_chunks()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
    comp = table.column("comp").to_numpy()
    left, right = (np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
    pairs = [np.zeros((0, 2), np.int64)]
    for at in range(0, len(left), 32):  # a bounded number of pairs at a time
        i, j = np.nonzero(comp[left[at:at + 32], None] != comp[None, right])
        i, j = left[at + i], right[j]
        stay, _ = _likely(sig[i], sig[j], least)
        pairs.append(np.stack([i[stay], j[stay]], 1))
    pairs = np.concatenate(pairs)
    met = pairs[_reach(pairs, table.column("text"), percent, size)]
    links = np.unique(np.sort(comp[met], axis=1), axis=0) if len(met) else met
    return pa.table({"a": pa.array(links[:, 0], pa.int64()), "b": pa.array(links[:, 1], pa.int64())})


def _reach(pairs: np.ndarray, text: pa.ChunkedArray, percent: int, size: int) -> np.ndarray:
    """Which pairs of rows reach the threshold on their full sets."""
    if not len(pairs):
        return np.zeros(0, bool)
    used, at = np.unique(pairs, return_inverse=True)
    pairs = at.reshape(pairs.shape)
    sets = _sets(text.take(pa.array(used)).combine_chunks(), size)
    n = np.array([len(s) for s in sets])
    if len(pairs) <= 4 * len(used):
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs])
    else:  # intersections of all rows at once, as a product of membership matrices, some elements at a time
        element, times = np.unique(np.concatenate(sets), return_counts=True)
        element = element[times > 1]
        found = [np.searchsorted(element, s[np.isin(s, element, assume_unique=True)]) for s in sets]
        row, column = np.repeat(np.arange(len(sets)), [len(f) for f in found]), np.concatenate(found)
        order = np.argsort(column, kind="stable")
        row, column, both = row[order], column[order], np.zeros((len(sets),) * 2, np.float32)
        for lo in range(0, len(element), 4096):
            part = slice(*np.searchsorted(column, [lo, lo + 4096]))
            member = np.zeros((len(sets), min(4096, len(element) - lo)), np.float32)
            member[row[part], column[part] - lo] = 1
            both += member @ member.T
        common = both[pairs[:, 0], pairs[:, 1]].astype(np.int64)
    return 100 * common >= percent * (n[pairs[:, 0]] + n[pairs[:, 1]] - common)


def _sets(text: pa.Array, size: int) -> list[np.ndarray]:
    """The set of every row, as sorted values."""
    out = []
    for w in words(text, lower=True):
        of, value = shingles(w, size)
        out += np.split(value, np.searchsorted(of, np.arange(1, w.hi - w.lo)))
    return out


def linked(batches: Iterator[pa.RecordBatch], percent: int, size: int) -> Iterator[pa.RecordBatch]:
    """Whether each pair reaches the threshold on its full sets.  Input columns: a, b, text_a, text_b."""
    for batch in batches:
        verdicts = []
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            for x, y in zip(_sets(part.column(2), size), _sets(part.column(3), size)):
                n = len(np.intersect1d(x, y, assume_unique=True))
                verdicts.append(len(x) > 0 and 100 * n >= percent * (len(x) + len(y) - n))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(verdicts, pa.bool_())], names=["a", "b", "ok"])


def roots(parents: DataFrame) -> DataFrame:
    """(doc, comp) for a forest of (doc, parent) pointers; every round doubles how far a pointer reaches, and is written."""
    while True:
        up = parents.select(F.col("doc").alias("_d"), F.col("parent").alias("_p"))
        new = written(parents.join(up, F.col("parent") == F.col("_d"), "left").select("doc", F.coalesce("_p", "parent").alias("parent"), F.col("_p").isNotNull().alias("moved")), "roots")
        if new.where("moved").isEmpty():
            return new.select("doc", F.col("parent").alias("comp"))
        parents = new.select("doc", "parent")


def components(edges: DataFrame) -> DataFrame:
    """(doc, comp) of all nodes of (a, b) links; comp is the smallest node of the component.

    Every round gives a node the smallest label around it and then that label's own label; each round is written, so rounds do not pile up in the plan.
    Labels combine in the map tasks, so a node with very many edges is no hot key.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    label = both.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("b"), F.col("a")).alias("comp"))
    while True:
        near = both.join(label.withColumnRenamed("doc", "b"), "b").groupBy(F.col("a").alias("doc")).agg(F.min("comp").alias("around"))
        step = label.join(near, "doc").select("doc", F.least("comp", "around").alias("next"), F.col("comp").alias("was"))
        jump = label.select(F.col("doc").alias("_d"), F.col("comp").alias("_n"))
        new = written(step.join(jump, F.col("next") == F.col("_d")).select("doc", F.least("next", "_n").alias("comp"), "was"), "labels")
        if new.where("comp <> was").isEmpty():
            return new.select("doc", "comp")
        label = new.select("doc", "comp")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    with_a = pairs.select("a", "b").join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return written(with_b.mapInArrow(lambda x: linked(x, percent, size), "a bigint, b bigint, ok boolean"), "verified")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75, size: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id of its group) and kept (it is that document)."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text")).where("doc is not null")
    least = least_matches(percent / 100)
    found = written(docs.mapInArrow(lambda b: features(b, size), "doc bigint, n bigint, key binary, sig binary"), "features")
    classes = found.where("n > 0").groupBy("key").agg(F.min("doc").alias("head"))
    heads = written(found.where("n > 0").join(classes.select(F.col("key").alias("_k"), "head"), (F.col("key") == F.col("_k")) & (F.col("doc") == F.col("head")), "left_semi")
                    .groupBy("doc", "key").agg(F.first("sig").alias("sig")), "heads")
    banded = heads.select("doc", "sig").mapInArrow(bands, "bucket bigint, doc bigint")
    shared = banded.groupBy("bucket").agg(F.min("doc").alias("head"), F.max("doc").alias("last")).where("head <> last").select("bucket", "head")
    members = written(banded.join(shared, "bucket").select("bucket", "head", "doc"), "members")
    wanted = written(members.select("doc").distinct(), "wanted")
    texts = written(docs.join(wanted, "doc", "left_semi").distinct(), "texts")
    sigs = written(heads.join(wanted, "doc", "left_semi").select("doc", "sig"), "signatures")

    star = members.where("doc <> head").select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct()
    joined = (star.join(sigs.select(F.col("doc").alias("b"), F.col("sig").alias("sig_b")), "b").join(sigs.select(F.col("doc").alias("a"), F.col("sig").alias("sig_a")), "a")
              .select("a", "b", "sig_a", "sig_b"))
    likely = joined.mapInArrow(lambda b: compare_pairs(b, least), "a bigint, b bigint, same bigint")
    # one partner for each member: the smallest of those that are surely similar, else the most similar; smallest partners keep the pointers short
    sure = F.col("same") >= int(HASHES * (percent / 100 + 0.1))
    rank = F.struct(sure.alias("sure"), F.when(sure, -F.col("a")).otherwise(F.col("same")).alias("by"), F.col("a").alias("a"))
    best = written(likely.groupBy("b").agg(F.max(rank).alias("m")).select(F.col("m.a").alias("a"), "b"), "best")
    pointed = roots(_verified(best, texts, percent, size).where("ok").groupBy(F.col("b").alias("doc")).agg(F.min("a").alias("parent")))
    label = written(wanted.join(pointed, "doc", "left").select("doc", F.coalesce("comp", "doc").alias("comp")), "label")

    mine = members.select("bucket", "doc").join(label, "doc")
    several = mine.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    met = written(_rest_links(mine.join(several, "bucket", "left_semi"), sigs, texts, least, percent, size), "met")
    merged = components(met).select(F.col("doc").alias("_c"), F.col("comp").alias("_new"))
    label = label.join(merged, F.col("comp") == F.col("_c"), "left").select("doc", F.coalesce("_new", "comp").alias("comp"))

    of_class = found.join(classes.select(F.col("key").alias("_k"), "head"), F.col("key") == F.col("_k"), "left").select("doc", "n", "head")
    grouped = of_class.join(label.select(F.col("doc").alias("head"), "comp"), "head", "left").select("doc", "n", F.coalesce("comp", "head", "doc").alias("comp"))
    return grouped.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), (F.col("doc") == F.col("comp")).alias("kept"))


def _rest_links(mine: DataFrame, sigs: DataFrame, texts: DataFrame, least: list[int], percent: int, size: int) -> DataFrame:
    """(a, b): components that a verified link joins, from buckets (bucket, doc, comp) with several of them, block against block."""
    sized = mine.groupBy("bucket", "comp").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("all")).select(
        "bucket", F.col("m.comp").alias("main"), F.ceil((F.col("all") - F.col("m.n")) / BLOCK).alias("rest_blocks"), F.ceil(F.col("m.n") / BLOCK).alias("main_blocks"))
    placed = mine.join(sized, "bucket").withColumn("is_main", F.col("comp") == F.col("main")).withColumn("block", F.pmod(F.xxhash64("doc"), F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("rest_blocks"))))
    span = lambda name: F.sequence(F.lit(0).cast("bigint"), F.col(name) - 1)
    # a pair of blocks is (x, y, y is main); blocks of the main component meet the others only
    spot = lambda x, y, of_main, is_left, is_right: F.struct(x.alias("x"), y.alias("y"), F.lit(of_main).alias("of_main"), is_left.alias("left"), is_right.alias("right"))
    yes, no, b = F.lit(True), F.lit(False), F.col("block")
    meets = F.when(F.col("is_main"), F.transform(span("rest_blocks"), lambda x: spot(x, b, True, no, yes))).otherwise(F.concat(
        F.transform(span("rest_blocks"), lambda o: spot(F.least(o, b), F.greatest(o, b), False, o >= b, o <= b)), F.transform(span("main_blocks"), lambda y: spot(b, y, True, yes, no))))
    spread = placed.select("bucket", "doc", "comp", F.explode(meets).alias("at")).select("bucket", "at.*", "doc", "comp")
    full = spread.join(sigs, "doc").join(texts, "doc").select("bucket", "x", "y", "of_main", "left", "right", "comp", "sig", "text")
    return full.groupBy("bucket", "x", "y", "of_main").applyInArrow(lambda t: compare_blocks(t, least, percent, size), "a bigint, b bigint").distinct()


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; its columns are unchanged.  Equal rows count once.

    An id that several texts bear goes only when none of its rows is kept, so no group loses its kept document."""
    with temporary(docs.sparkSession):
        gone = written(near_groups(docs, doc_id, text, **options).groupBy(F.col("doc_id").alias("_gone")).agg(F.bool_or("kept").alias("kept")).where("not kept").select("_gone"), "dropped", stays=True)
    kept = docs.join(gone, F.col(doc_id) == F.col("_gone"), "left_anti")
    again = docs.groupBy(doc_id).count().where("count > 1")
    return kept if again.isEmpty() else kept.dropDuplicates()

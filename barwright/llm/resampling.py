"""Importance resampling towards a target: hashed word n-grams weigh documents, Gumbel noise and a global rank draw them.

1. *Features.*  A-Z are lower-cased; words are runs of digits, letters a-z and characters beyond ASCII.  The features of a document are its
   runs of ``sizes`` consecutive words, joined by one space, repeats counted; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``.
   Feature bytes of equal length form one uint8 matrix whose distinct rows have their CRCs updated column by column; the buckets are scattered
   back to the places of the features.  Long features are cut into rows of ``CHUNK`` bytes, whose CRCs a linear step chains.
2. *Gains.*  Bucket counts of the corpus (S, s) and of the target (T, t) are sums that combine in the map tasks; the gain of a bucket is
   ``floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))``.  The driver holds one number a bucket, whatever the corpus.
3. *Draw.*  score = floored mean gain + floor(1000 * Gumbel noise of the doc_id).  Scores are whole numbers of a bounded range, so the rows above each score
   are known from a small table of counts; only rows at or above the score of the last place are ranked, each score for itself.

Null and empty texts have no feature, weight 0 and are never drawn if ``least_words`` is positive.  Rows that repeat a doc_id are documents of their own
with the same noise; equal (score, doc_id) rows share places in any order.  A null doc_id counts as the empty text in the noise and comes last among ties.
An empty table gives an empty result; with an empty target all buckets have the gains of t = T = 0.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Column, Window, functions as F

from .store import written
from .text import Words, pieces, words

CHUNK = 256
_POLYNOMIAL = 0xEDB88320
_FEATURES = 1 << 18
_KEPT = np.full(256, 32, np.uint8)  # bytes of words stay (A-Z lower-cased), all others become blanks
_KEPT[48:58], _KEPT[65:91], _KEPT[97:123], _KEPT[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)


def _byte_steps() -> np.ndarray:
    """The register after one byte, for every low byte of a register whose other bits are zero."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1)
    return t.astype(np.uint32)


_STEP = _byte_steps()


def _skips() -> np.ndarray:
    """The register after ``CHUNK`` zero bytes, by each of its four bytes (the step is linear)."""
    out = (np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(CHUNK):
        out = _STEP[out & 0xFF] ^ (out >> 8)
    return out


_SKIP = _skips()


def _columns(register: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    for k in range(matrix.shape[1]):
        register = _STEP[(register ^ matrix[:, k]) & 0xFF] ^ (register >> 8)
    return register


def crc32_rows(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a two-dimensional uint8 array."""
    n, length = matrix.shape
    head = length % CHUNK if length > CHUNK else length
    register = _columns(np.full(n, 0xFFFFFFFF, np.uint32), matrix[:, :head])
    if head < length:
        rest = matrix[:, head:].reshape(-1, CHUNK)
        # a register that starts at zero gives each chunk's own share; the register before it passes over CHUNK zero bytes
        share = _columns(np.zeros(len(rest), np.uint32), rest).reshape(n, -1)
        for k in range(share.shape[1]):
            register = _SKIP[0][register & 0xFF] ^ _SKIP[1][(register >> 8) & 0xFF] ^ _SKIP[2][(register >> 16) & 0xFF] ^ _SKIP[3][register >> 24] ^ share[:, k]
    return register ^ np.uint32(0xFFFFFFFF)


def _distinct(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct content, and for every row which of them it equals."""
    if matrix.shape[1] <= 8:
        wide = np.zeros((len(matrix), 8), np.uint8)
        wide[:, :matrix.shape[1]] = matrix
        key = wide.view(np.uint64)[:, 0]
    else:
        key = np.ascontiguousarray(matrix).view(np.dtype((np.void, matrix.shape[1])))[:, 0]
    _, at, of = np.unique(key, return_index=True, return_inverse=True)
    return at, of.reshape(-1)


def crc32_ranges(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges: one matrix for each length."""
    out, length = np.zeros(len(starts), np.uint32), ends - starts
    order = np.argsort(length, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
        matrix = raw[starts[own][:, None] + np.arange(length[own[0]])]
        at, of = _distinct(matrix)
        out[own] = crc32_rows(matrix[at])[of]
    return out


def feature_words(column: pa.Array) -> Iterator[Words]:
    """Words of the feature alphabet, a bounded slice of rows at a time, joined by single blanks."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bytes_ = _KEPT[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
    plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, offsets, pa.py_buffer(bytes_)], offset=column.offset)
    for w in words(plain, limit=_FEATURES):
        length = w.ends - w.starts
        starts = np.cumsum(length + 1) - length - 1
        raw = np.full(int((length + 1).sum()), 32, np.uint8)
        raw[np.repeat(starts, length) + _within(length)] = w.raw[np.repeat(w.starts, length) + _within(length)]
        yield Words(w.lo, w.hi, raw, w.offsets, starts, starts + length, w.first)


def _within(length: np.ndarray) -> np.ndarray:
    return np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)


def features(w: Words, sizes: tuple[int, int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every feature, repeats included."""
    rows, of, out = w.row_of_word(), [], []
    for size in range(sizes[0], sizes[1] + 1):
        n = len(rows) - size + 1
        at = np.flatnonzero(rows[:n] == rows[size - 1:]) if n > 0 else np.zeros(0, np.int64)
        for lo in range(0, max(len(at), 1), _FEATURES):
            part = at[lo:lo + _FEATURES]
            of.append(rows[part])
            out.append(crc32_ranges(w.raw, w.starts[part], w.ends[part + size - 1]) % np.uint32(buckets))
    return np.concatenate(of), np.concatenate(out).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], sizes: tuple[int, int], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in pieces(batches):
        for w in feature_words(batch.column(0)):
            total += np.bincount(features(w, sizes, buckets)[1], minlength=buckets)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text: str = "text", sizes: tuple[int, int] = (1, 2), buckets: int = 10_000) -> DataFrame:
    """(bucket, n): features of all texts; buckets without any are left out."""
    if not 1 <= sizes[0] <= sizes[1]:
        raise ValueError("sizes are a smallest and a largest number of words, 1 at least")
    return (texts.select(F.col(text).cast("string")).mapInArrow(lambda b: _counted(b, sizes, buckets), "bucket bigint, n bigint")
            .groupBy("bucket").agg(F.sum("n").cast("bigint").alias("n")))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of every bucket from (bucket, n) counts; the driver receives at most one row a bucket."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t"))).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    found = both.toArrow()
    s, t = np.zeros(buckets), np.zeros(buckets)
    at = found.column("bucket").to_numpy()
    s[at], t[at] = found.column("s").to_numpy(), found.column("t").to_numpy()
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weighed(batches: Iterator[pa.RecordBatch], gain: np.ndarray, sizes: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        for w in feature_words(batch.column(1)):
            rows, bucket = features(w, sizes, len(gain))
            n = np.bincount(rows, minlength=w.hi - w.lo)
            total = np.zeros(w.hi - w.lo, np.int64)
            np.add.at(total, rows, gain[bucket])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.hi - w.lo), pa.array(w.counts), pa.array(n), pa.array(total // np.maximum(n, 1))],
                                             names=["doc_id", "n_words", "n_features", "weight"])


def noise(doc_id: Column, seed: int) -> Column:
    """Floored thousandfold Gumbel noise of a document."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, sizes: tuple[int, int] = (1, 2), buckets: int = 10_000, least_words: int = 20, seed: int = 2024,
             doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score and rank (null if not drawn).

    Drawn are the ``floor(percent * N / 100)`` highest scores of the N documents with ``least_words`` words, ties to the smaller doc_id.
    """
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    gain = gains(bucket_counts(docs, "text", sizes, buckets), bucket_counts(target, target_text, sizes, buckets), buckets)
    weighed = docs.mapInArrow(lambda b: _weighed(b, gain, sizes), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    scored = written(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resampling-scores")
    # one row a score: gains and noise are whole numbers between about -30,000 and 60,000 at any corpus size
    per_score = scored.where(F.col("n_words") >= least_words).groupBy("score").agg(F.count("*").alias("n"))
    above = per_score.select("score", (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("_above"), F.sum("n").over(Window.partitionBy()).alias("_all"))
    places = above.select("score", "_above", F.floor(F.col("_all") * percent / 100).alias("_places")).where("_above < _places")
    drawable = scored.where(F.col("n_words") >= least_words).join(F.broadcast(places), "score")
    # noise spreads documents over scores: no score holds more than a two-thousandth of them
    within = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id")))
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    ranked = drawable.withColumn("_rank", F.col("_above") + within).select(*columns, F.when(F.col("_rank") <= F.col("_places"), F.col("_rank")).alias("rank"))
    rest = scored.where(F.col("n_words") < least_words).select(columns).unionByName(scored.where(F.col("n_words") >= least_words).join(F.broadcast(places.select("score")), "score", "left_anti").select(columns))
    return ranked.unionByName(rest.withColumn("rank", F.lit(None).cast("bigint")))

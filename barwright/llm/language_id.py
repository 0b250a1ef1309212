"""Language of whole texts, word first: known words by their frequency per language, unknown words by ever shorter n-grams.

Training counts words and character n-grams (1 to ``LONGEST`` letters, over words with a mark at both ends) per language in a bounded sample of
the labelled rows: about ``SAMPLE_ROWS`` rows per language, chosen by a hash of doc_id, whole texts.  A feature's score in a language is its log
frequency there, smoothed and relative to the mean over the languages, so a feature that is common everywhere says nothing.

Prediction looks every distinct word of a text up among the known words.  A word that is not there is scored by its n-grams of the longest length
that the model knows any of, then of the next shorter one, down to single letters.  Words count as often as they occur.
The score is the posterior share of the best language under equal priors.

Texts that are null or hold no letter are ``und`` with score 0.  Ties go to the language that comes first in the alphabet.  Repeated rows are answered
alike.  Without a labelled row every text is ``und``.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

SAMPLE_ROWS = 2000
LONGEST = 5
CACHED = 200_000
BROADCAST_LANGS = 10_000
SMOOTHING = 0.5
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
OUT = "doc_id bigint, lang_pred string, score double"


def letters(text: str | None) -> list[str]:
    """The words of a text: runs of letters, in lower case."""
    return _LETTERS.findall((text or "").lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """``words`` and ``grams[n]``: feature to a row of ``weights`` (a score per language)."""
    langs: list[str]
    weights: np.ndarray
    words: dict[str, int]
    grams: dict[int, dict[str, int]]

    def word_score(self, word: str) -> np.ndarray:
        at = self.words.get(word)
        if at is not None:
            return self.weights[at]
        for n in range(LONGEST, 0, -1):
            known = self.grams[n]
            rows = [known[g] for g in grams(word, n) if g in known]
            if rows:
                return self.weights[rows].mean(0)
        return np.zeros(len(self.langs))


def sampled(labelled: DataFrame, doc_id: str, lang: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows of each language, by a hash of the id; every row where a language has no more."""
    sizes = labelled.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("_n"))
    if sizes.count() <= BROADCAST_LANGS:
        sizes = F.broadcast(sizes)
    share = F.xxhash64(F.col(doc_id), F.lit(17)) / F.lit(2.0 ** 64) + 0.5
    return labelled.join(sizes, F.col(lang) == F.col("_lang")).where(share * F.col("_n") < rows)


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, feature, count): n is 0 for words.  Input columns: lang, text."""
    for batch in batches:
        held: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(lang, Counter()).update(letters(text))
        rows = []
        for lang, found in held.items():
            counts: Counter = Counter()
            for word, n in found.items():
                counts[0, word] += n
                for size in range(1, LONGEST + 1):
                    for g in grams(word, size):
                        counts[size, g] += n
            rows += [(lang, size, g, n) for (size, g), n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "n", "feature", "count"])


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, least: int = 2) -> Model:
    """The model of the rows with a language.  Features met fewer than ``least`` times are left to shorter ones."""
    chosen = sampled(labelled.select(F.col(doc_id).alias(doc_id), F.col(text).cast("string").alias(text), F.col(lang).cast("string").alias(lang)).where(F.col(lang).isNotNull()), doc_id, lang, rows)
    counted = chosen.select(lang, text).mapInArrow(count_features, "lang string, n int, feature string, count bigint").groupBy("lang", "n", "feature").agg(F.sum("count").alias("count"))
    per = counted.groupBy("n", "feature").agg(F.map_from_entries(F.collect_list(F.struct("lang", "count"))).alias("by"), F.sum("count").alias("all")).where((F.col("all") >= least) | (F.col("n") == 1))
    found = per.select("n", "feature", "by").toArrow()  # bounded by the sample
    by = pa.concat_arrays(found.column("by").chunks) if found.num_rows else pa.array([], pa.map_(pa.string(), pa.int64()))
    langs = sorted(by.keys.unique().to_pylist())
    counts = np.zeros((found.num_rows, len(langs)))
    offsets = by.offsets.to_numpy()
    rows = np.repeat(np.arange(found.num_rows), np.diff(offsets))
    held = slice(offsets[0], offsets[-1]) if len(offsets) else slice(0, 0)
    if langs:
        counts[rows, pc.index_in(by.keys, pa.array(langs)).to_numpy()[held]] = by.items.to_numpy()[held]
    sizes, names = found.column("n").to_numpy(), found.column("feature").to_pylist()
    weights = np.zeros_like(counts)
    for n in range(LONGEST + 1):
        mine = sizes == n
        if mine.any():
            value = np.log((counts[mine] + SMOOTHING) / (counts[mine].sum(0) + SMOOTHING * mine.sum()))
            weights[mine] = value - value.mean(1, keepdims=True)
    tables: dict[int, dict] = {n: {} for n in range(LONGEST + 1)}
    for row, (n, name) in enumerate(zip(sizes.tolist(), names)):
        tables[n][name] = row
    return Model(langs, weights.astype(np.float32), tables.pop(0), tables)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred and score."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        cache: dict[str, np.ndarray] = {}
        for batch in batches:
            rows = [scored(known, value.as_py(), cache) for value in batch.column(1)]
            langs, scores = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, OUT)


def scored(model: Model, text: str | None, cache: dict[str, np.ndarray]) -> tuple[str, float]:
    """Language and score of one text; ``cache`` keeps the scores of words met before and is emptied when full."""
    found = letters(text)
    if not found or not model.langs:
        return UNKNOWN, 0.0
    if len(cache) > CACHED:
        cache.clear()
    for word in set(found):
        if word not in cache:
            cache[word] = model.word_score(word)
    total = np.array([cache[word] for word in found], np.float64).sum(0)
    best = int(total.argmax())
    return model.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def held_out(doc_id: str | Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls into the fold that is not learned from (a null id never does)."""
    return F.coalesce(F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))

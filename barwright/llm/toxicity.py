"""Toxicity of whole texts by weak supervision: many voters, a generative label model over them, a linear classifier on its posteriors.

* *Voters.*  Lexicon voters fire on a word or on a word beginning (``STEMS`` letters).  They are mined from a bounded sample of the rows to learn
  from (about ``SAMPLE_ROWS`` labelled ones, by a hash of doc_id, whole texts): features whose documents are labelled toxic clearly more often than
  others.  Pattern voters fire on how densely such features stand in a text, on shouting and on exclamation marks.
* *Label model.*  Each voter fires with one probability in toxic and one in clean texts; a label is one more, noisy voter.  EM estimates these
  accuracies and the posterior of every sampled row.  Voters that go together inside a class share their say: a voter counts by
  ``1 / (1 + sum of its within-class correlations)``.
* *Classifier.*  A logistic regression on the counts of the features and the patterns is fitted to the posteriors, so it can weigh features that
  the label model takes as plain votes.  Its probability is the score.

Null and empty texts hold no feature; their score is that of an empty feature list.  Repeated rows are scored alike.  Without labels every score is
0.5 and the prediction 1 (0.5 is at least ``THRESHOLD``); without a toxic or without a clean label the score is the smoothed share.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SAMPLE_ROWS = 20_000
STEMS = (4, 5, 6)
VOTERS, FEATURES = 400, 2000
THRESHOLD = 0.3
PATTERNS = ("some", "several", "many", "dense", "densest", "shouting", "exclaiming")
CACHED = 300_000
_LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """The features of a lower-case word: itself and its beginnings."""
    return [f"={word}", *[f"{word[:n]}~" for n in STEMS if len(word) > n]]


def capitals(text: str, lower: str) -> int:
    """How many characters of the whole text lower-casing changes."""
    if len(lower) != len(text):
        return sum(c != c.lower() for c in text)
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (text, lower))
    return int(np.count_nonzero(a != b))


@dataclass
class Model:
    """Known features and the weights of the classifier: features first, then ``extras``."""
    features: dict[str, int]
    strong: np.ndarray
    weights: np.ndarray
    bias: float

    def counted(self, text: str | None, cache: dict[str, tuple]) -> tuple[dict[int, int], int, list[float]]:
        """Counts of the known features, the number of words, shares of capitals and of exclamation marks."""
        text = text or ""
        if len(cache) > CACHED:
            cache.clear()
        counts: dict[int, int] = {}
        lower = text.lower()
        found = _LETTERS.findall(lower)
        for word in found:
            known = cache.get(word)
            if known is None:
                known = cache[word] = tuple(self.features[f] for f in word_features(word) if f in self.features)
            for k in known:
                counts[k] = counts.get(k, 0) + 1
        size = max(1, len(text))
        return counts, len(found), [capitals(text, lower) / size, text.count("!") / size]

    def row(self, text: str | None, cache: dict[str, tuple]) -> tuple[list[int], list[float]]:
        """Sparse row of the classifier."""
        counts, words, shares = self.counted(text, cache)
        hits = sum(n for k, n in counts.items() if self.strong[k])
        at, n = list(counts), len(self.features)
        return at + list(range(n, n + 5)), [min(v, 3) / 3 for v in counts.values()] + [np.log1p(hits), min(1.0, 20 * hits / max(1, words)), *shares, np.log1p(words) / 10]

    def votes(self, text: str | None, cache: dict[str, tuple]) -> tuple[list[int], list[bool]]:
        counts, words, (capitals, marks) = self.counted(text, cache)
        hits = sum(n for k, n in counts.items() if self.strong[k])
        share = hits / max(1, words)
        return list(counts), [hits >= 1, hits >= 2, hits >= 4, share >= 0.005, share >= 0.02, capitals >= 0.4, marks >= 0.02]


def sampled(labelled: DataFrame, doc_id: str, rows: int) -> DataFrame:
    """About ``rows`` rows by a hash of the id; all if there are no more."""
    share = min(1.0, rows / max(1, labelled.count()))
    return labelled.where(F.xxhash64(F.col(doc_id), F.lit(29)) / F.lit(2.0 ** 64) + 0.5 <= share)


def document_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, n): number of documents of the batch with the feature.  Input columns: text, toxic."""
    for batch in batches:
        held: dict[tuple, int] = {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for f in {f for word in set(_LETTERS.findall((text or "").lower())) for f in word_features(word)}:
                held[f, toxic] = held.get((f, toxic), 0) + 1
        rows = [(f, t, n) for (f, t), n in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, (pa.string(), pa.int32(), pa.int64()))], names=["feature", "toxic", "n"])


def mine(sample: DataFrame, toxic: int, clean: int, least: int = 3) -> list[tuple[str, int, int]]:
    """The features that speak for toxicity most, with their toxic and clean documents: ``FEATURES`` at most, ordered."""
    counted = (sample.select("text", "toxic").mapInArrow(document_features, "feature string, toxic int, n bigint").groupBy("feature")
               .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("q")))
    lift = ((F.col("p") + 0.5) / (toxic + 1)) / ((F.col("q") + 0.5) / (clean + 1))
    gain = F.col("p") * F.log(lift)
    return [tuple(r) for r in counted.where(F.col("p") >= least).where(lift >= 3).orderBy(gain.desc(), "feature").limit(FEATURES).select("feature", "p", "q").collect()]


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each row and accuracies (P(fires | clean), P(fires | toxic)) of each voter.  ``labels``: 0, 1, or -1 for none."""
    v = votes.astype(np.float64)
    known = labels >= 0
    post = np.where(known, np.where(labels == 1, 0.97, 0.03), 0.1)
    for _ in range(rounds):
        fires = np.stack([((1 - post) @ v + 0.5) / ((1 - post).sum() + 1), (post @ v + 0.5) / (post.sum() + 1)])
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        share = np.ones(v.shape[1])
        together = np.zeros((v.shape[1],) * 2)
        for weight, rate in ((1 - post, fires[0]), (post, fires[1])):
            centred = (v - rate) * np.sqrt(weight / max(weight.sum(), 1))[:, None]
            cov = centred.T @ centred
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            together = np.maximum(together, np.abs(cov / spread[:, None] / spread[None, :]))
        np.fill_diagonal(together, 0)
        share = 1 / (1 + np.where(together > 0.15, together, 0).sum(1))
        on, off = np.log(fires[1] / fires[0]) * share, np.log((1 - fires[1]) / (1 - fires[0])) * share
        odds = np.log(prior / (1 - prior)) + v @ (on - off) + off.sum() + np.where(known, np.where(labels == 1, 3.0, -3.0), 0.0)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - post).max() < 1e-4:
            break
        post = new
    return post, fires


def fit(rows: list[tuple[list[int], list[float]]], target: np.ndarray, width: int, rounds: int = 400, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows by full-batch steps with adaptive rates."""
    size = np.array([len(at) for at, _ in rows])
    of, at, x = np.repeat(np.arange(len(rows)), size), np.concatenate([np.array(a, np.int64) for a, _ in rows]), np.concatenate([np.array(v, np.float64) for _, v in rows])
    w, bias = np.zeros(width), float(np.log(np.clip(target.mean(), 1e-3, 1 - 1e-3) / (1 - np.clip(target.mean(), 1e-3, 1 - 1e-3))))
    m, s = np.zeros(width + 1), np.zeros(width + 1)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, x * w[at], len(rows)) + bias, -30, 30)))
        err = p - target
        g = np.append(np.bincount(at, err[of] * x, width) / len(rows) + ridge * w / 10, err.mean())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9 ** k)) / (np.sqrt(s / (1 - 0.999 ** k)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """The model of the labelled documents among ``docs``."""
    named = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("toxic"))
    chosen = sampled(named, "_id", rows)
    sample = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "_id").select("text", "toxic")  # about ``rows`` ids
    size = dict(sample.groupBy("toxic").count().collect())
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        p = (toxic + 1) / (toxic + clean + 2)
        return Model({}, np.zeros(0, bool), np.zeros(5), float(np.log(p / (1 - p))))
    found = mine(sample, toxic, clean)
    model = Model({f: k for k, (f, _, _) in enumerate(found)}, np.array([p / (toxic + 1) >= 10 * (q + 0.5) / (clean + 1) for _, p, q in found], bool), np.zeros(len(found) + 5), 0.0)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple] = {}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            at, x = zip(*[model.row(t, cache) for t in texts]) if texts else ((), ())
            fires, patterns = zip(*[model.votes(t, cache) for t in texts]) if texts else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float64())), pa.array(fires, pa.list_(pa.int32())), pa.array(patterns, pa.list_(pa.bool_()))],
                                             names=["toxic", "at", "x", "fires", "patterns"])

    # about ``rows`` sparse rows; no text comes to the driver
    held = sample.mapInArrow(measured, "toxic int, at array<int>, x array<double>, fires array<int>, patterns array<boolean>").toArrow()
    y, voters = held.column("toxic").to_numpy().astype(np.int64), min(VOTERS, len(found))
    votes = np.zeros((len(y), voters + len(PATTERNS)), bool)
    for k, (fires, patterns) in enumerate(zip(held.column("fires").to_pylist(), held.column("patterns").to_pylist())):
        votes[k, [a for a in fires if a < voters]] = True
        votes[k, voters:] = patterns
    post, _ = label_model(votes, y)
    model.weights, model.bias = fit(list(zip(held.column("at").to_pylist(), held.column("x").to_pylist())), post, len(found) + 5)
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cache = sent.value, {}
        for batch in batches:
            out = []
            for t in batch.column(1):
                at, x = known.row(t.as_py(), cache)
                out.append(1 / (1 + np.exp(-np.clip(float(np.dot(known.weights[at], x)) + known.bias, -30, 30))))
            out = np.array(out, np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double, predicted int")

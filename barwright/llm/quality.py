"""Quality rules whose cut-offs follow the data: quantile sketches per language and source instead of fixed limits.

Base measures of a whole text (null: no word) come from one vectorised pass.  The adaptive rules look at three shares: symbols per word,
capitals per ASCII letter, repeated lines per line.  Each share of each (lang, source) is summarised by a sketch of logarithmic buckets
(relative error 1 %); sketches merge by adding bucket counts, so one pass serves the group, the language and the whole.  A document is
rejected when a share lies above ``max(median + spread * (median - 10th percentile), 90th percentile) + margin`` of its group: what a tenth of a
source's documents carry is normal for it.  A share that is zero in at least half of a group says nothing in its lower half; its cut rises by the share of
non-zero documents times the median of their values, a mean that outliers do not move.  A group's cut is at most ``bound`` times its language's, and that
at most ``bound`` times the cut of all, so that a source full of junk does not set its own measure.  A group with fewer than ``min_rows``
documents uses its language's sketch, then that of all.

Null lang or source form a group of their own.  Empty and null texts have zero measures and fail the base rule.  Equal rows are judged
alike.  An empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .store import text_column, written
from .text import covered, inside_rows, mix, row_sums, windows, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
MARGINS = {"symbols": 0.1, "capitals": 0.1, "dup_lines": 0.5}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BASE = 1.02
_TINY = 1e-6


def counts(column: pa.Array, window: int = 8) -> list[np.ndarray]:
    """The measures of ``COUNTS`` for every row of a string column."""
    parts = [[] for _ in COUNTS]
    for w in words(column):
        n, rows = w.hi - w.lo, w.row_of_word()
        upper = (w.raw >= 65) & (w.raw <= 90)
        letters = upper | ((w.raw >= 97) & (w.raw <= 122))
        line_row, s, e = w.lines()
        line_key = w.range_hashes(s, e, 3) ^ mix(line_row.astype(np.uint64) + np.uint64(1))
        again = np.ones(len(line_key), bool)
        again[np.unique(line_key, return_index=True)[1]] = False
        key = windows(w.hashes(), window)
        ok = np.flatnonzero(inside_rows(rows, window))
        key = key[ok] ^ mix(rows[ok].astype(np.uint64) + np.uint64(1))
        _, at, times = np.unique(key, return_inverse=True, return_counts=True)
        repeated = covered(ok[times[at] > 1], window, len(rows))
        for part, values in zip(parts, (w.counts, w.code_points(), row_sums(_SYMBOL[w.raw], w.offsets), np.bincount(line_row[again], minlength=n),
                                        np.bincount(rows[repeated], minlength=n), np.bincount(line_row, minlength=n), row_sums(upper, w.offsets), row_sums(letters, w.offsets))):
            part.append(values)
    return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]


def measure(docs: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``into`` of the base measures."""
    @F.arrow_udf(", ".join(f"{c} long" for c in COUNTS).join(["struct<", ">"]).replace(" long", ":bigint"))
    def of(column: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in counts(column)], names=list(COUNTS))

    return text_column(docs, text).withColumn(into, of(F.col(text)))


def _shares(q: str) -> dict:
    part = lambda a, b: F.when(F.col(f"{q}.{b}") > 0, F.col(f"{q}.{a}") / F.col(f"{q}.{b}")).otherwise(F.lit(0.0))
    return {"symbols": part("n_symbols", "n_words"), "capitals": part("n_upper", "n_letters"), "dup_lines": part("n_dup_lines", "n_lines")}


def base_failed(q: str):
    return (F.col(f"{q}.n_words") < 20) | (100 * F.col(f"{q}.n_repeat_words") > 30 * F.col(f"{q}.n_words"))


def sketches(measured: DataFrame, q: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (level, lang, source, rule, bucket): how many documents with a word fall into the bucket.

    Counts are combined in the map tasks, so a hot source sends as little as any other; the coarser levels add up the finer one.
    """
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.when(v <= _TINY, F.lit(-1000)).otherwise(F.ceil(F.log(v) / F.lit(float(np.log(_BASE))))).cast("int").alias("bucket"))
                      for k, v in _shares(q).items()])
    fine = (measured.where(F.col(f"{q}.n_words") > 0).select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(rules).alias("r"))
            .groupBy("lang", "source", "r.rule", "r.bucket").agg(F.count("*").alias("n")))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), a.alias("lang"), b.alias("source")) for k, a, b in (
        (0, F.col("lang"), F.col("source")), (1, F.col("lang"), F.lit(None).cast("string")), (2, F.lit(None).cast("string"), F.lit(None).cast("string")))])
    return (fine.select(F.explode(levels).alias("g"), "rule", "bucket", "n").groupBy("g.level", "g.lang", "g.source", "rule", "bucket").agg(F.sum("n").alias("n")))


def limits(sketch: DataFrame, spread: float = 8.0, margins: dict[str, float] = MARGINS) -> DataFrame:
    """Per (level, lang, source): the number of documents and the cut of every rule, read off the sketches."""
    group = ["level", "lang", "source", "rule"]
    w = Window.partitionBy(*group)
    value = F.when(F.col("bucket") == -1000, F.lit(0.0)).otherwise(F.pow(F.lit(_BASE), F.col("bucket")) * (2 / (1 + _BASE)))
    zeros = F.coalesce(F.sum(F.when(F.col("bucket") == -1000, F.col("n"))).over(w), F.lit(0))
    run = sketch.select(*group, "bucket", value.alias("v"), F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("all"), zeros.alias("zeros"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("v")))
    beyond = F.when((F.col("v") > 0) & (F.col("upto") - F.col("zeros") >= 0.5 * (F.col("all") - F.col("zeros"))), F.col("v"))
    cut = run.groupBy(*group).agg(at(0.5).alias("mid"), at(0.1).alias("low"), at(0.9).alias("high"), F.coalesce(F.min(beyond), F.lit(0.0)).alias("typical"),
                                  F.max("all").alias("rows"), F.max("zeros").alias("zeros"))
    margin = F.create_map(*[F.lit(x) for kv in margins.items() for x in kv])
    rise = F.when(F.col("mid") == 0, (F.col("rows") - F.col("zeros")) / F.col("rows") * F.col("typical")).otherwise(F.lit(0.0))
    cut = cut.withColumn("cut", F.greatest(F.col("mid") + spread * (F.col("mid") - F.col("low")), F.col("high")) + margin[F.col("rule")] + rise)
    return cut.groupBy("level", "lang", "source").agg(F.max("rows").alias("rows"), *[F.max(F.when(F.col("rule") == k, F.col("cut"))).alias(k) for k in margins])


def judged(measured: DataFrame, lim: DataFrame, q: str, lang: str = "lang", source: str = "source", min_rows: int = 100, into: str = "verdict", bound: float = 2.0) -> DataFrame:
    """``measured`` with a struct ``into`` (base_failed, kept): the filter joined on (lang, source), else lang, else all."""
    pick = lambda level, *keys: lim.where(f"level = {level}").select(*[F.col(k).alias(f"_k{level}_{k}") for k in keys], F.struct("rows", *MARGINS).alias(f"_l{level}"))
    out = (measured.join(pick(0, "lang", "source"), F.col(lang).eqNullSafe(F.col("_k0_lang")) & F.col(source).eqNullSafe(F.col("_k0_source")), "left")
           .join(pick(1, "lang"), F.col(lang).eqNullSafe(F.col("_k1_lang")), "left")
           .join(F.broadcast(pick(2)), F.lit(True), "left"))  # one row
    over = F.lit(False)
    for k, v in _shares(q).items():
        cut = F.col(f"_l2.{k}")
        for finer in ("_l1", "_l0"):
            cut = F.when(F.col(f"{finer}.rows") >= min_rows, F.least(F.col(f"{finer}.{k}"), bound * cut)).otherwise(cut)
        over = over | F.coalesce(v > cut, F.lit(False))
    return out.withColumn(into, F.struct(base_failed(q).alias("base_failed"), (~base_failed(q) & ~over).alias("kept"))).drop("_k0_lang", "_k0_source", "_k1_lang", "_l0", "_l1", "_l2")


def quality_verdicts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", spread: float = 8.0, min_rows: int = 100) -> tuple[DataFrame, str, str]:
    """All rows without their texts, with the names of the two added struct columns of measures and verdicts (free of clashes)."""
    q, v = fresh(docs, "quality"), fresh(docs, "verdict")
    measured = written(measure(docs, text, q).drop(text), "measured")
    lim = written(limits(sketches(measured, q, lang, source), spread), "limits")
    return judged(measured, lim, q, lang, source, min_rows, v), q, v


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", spread: float = 8.0, min_rows: int = 100) -> DataFrame:
    """The documents that pass, with their columns unchanged.  Texts are measured once for the cuts and once to be judged, and never written or shuffled."""
    q, v = fresh(docs, "quality"), fresh(docs, "verdict")
    lim = written(limits(sketches(measure(docs, text, q).select(lang, source, q), q, lang, source), spread), "limits")
    out = judged(measure(docs, text, q), lim, q, lang, source, min_rows, v)
    return out.where(F.col(v)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

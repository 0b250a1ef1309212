"""Merges of overlapping bar sources and comparisons of two feeds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.quantiles import quantiles
from . import candles as co

W = Window
DAY = ["symbol", "et_date"]
OHLCV = ["open", "high", "low", "close", "volume"]


def later_wins(frames: list[DataFrame], keys=("symbol", "et_date", "et_min")) -> DataFrame:
    """Union of sources in priority order; the last source that has a key wins (an aggregate, no row is sorted)."""
    u = None
    for i, f in enumerate(frames):
        d = f.withColumn("_src", F.lit(i))
        u = d if u is None else u.unionByName(d, allowMissingColumns=True)
    rest = [c for c in u.columns if c not in (*keys, "_src")]
    return u.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_src").alias("_r")).select(*keys, "_r.*")


def stream_over_history(history: DataFrame, stream: DataFrame, price_tol: float = 1e-4, volume_tol: float = 1.0) -> DataFrame:
    """Merged bars, the stream winning, with per-row overlap and disagreement flags."""
    h = history.select(*DAY, "et_min", F.struct(*OHLCV).alias("h"))
    s = stream.select(*DAY, "et_min", F.struct(*OHLCV).alias("s"))
    j = h.join(s, [*DAY, "et_min"], "full")
    differs = F.lit(False)
    for c in OHLCV:
        differs = differs | (F.abs(F.col(f"h.{c}") - F.col(f"s.{c}")) > (volume_tol if c == "volume" else price_tol))
    overlap = F.col("h").isNotNull() & F.col("s").isNotNull()
    return j.select(*DAY, "et_min", overlap.alias("overlap"), (overlap & differs).alias("disagrees"), F.col("h").isNotNull().alias("in_history"),
                    F.col("s").isNotNull().alias("in_stream"), *[F.coalesce(F.col(f"s.{c}"), F.col(f"h.{c}")).alias(c) for c in OHLCV])


def merge_report(merged: DataFrame) -> DataFrame:
    """Row counts, overlaps, disagreements and missing regular minutes per (symbol, date)."""
    w = W.partitionBy(*DAY).orderBy("et_min")
    rth = F.col("et_min").between(570, 959)
    m = merged.withColumn("_p", F.max(F.when(rth, F.col("et_min"))).over(w.rowsBetween(W.unboundedPreceding, -1)))
    gap = F.when(rth & F.col("_p").isNotNull(), F.greatest(F.lit(0), F.col("et_min") - F.col("_p") - 1)).otherwise(0)
    return m.groupBy(*DAY).agg(F.count_if("in_history").alias("history_rows"), F.count_if("in_stream").alias("stream_rows"), F.count(F.lit(1)).alias("merged_rows"),
                               F.count_if("overlap").alias("deduplicated"), F.count_if("disagrees").alias("disagreements"), F.sum(gap).cast("long").alias("gap_minutes"))


def chart_upsert(history: DataFrame, minutes: DataFrame, tf: int) -> DataFrame:
    """Chart buckets: live minutes replace a history bucket when it is complete or the newest one."""
    live = co.chart_buckets(minutes, tf)
    last = live.groupBy(*DAY).agg(F.max("bucket").alias("_last"))
    live = live.join(last, DAY).where((F.col("n_bars") == tf) | (F.col("bucket") == F.col("_last")))
    h = history.select(*DAY, "bucket", F.struct(*OHLCV).alias("h"))
    v = live.select(*DAY, "bucket", F.struct(*OHLCV).alias("v"))
    return h.join(v, [*DAY, "bucket"], "full").select(*DAY, "bucket", F.col("v").isNotNull().alias("is_live"), F.coalesce("v", "h").alias("r")).select(
        *DAY, "bucket", "is_live", "r.*")


def completed_only(bars: DataFrame, minutes: int, now_min: Column) -> DataFrame:
    """Candles whose interval has ended."""
    return bars.where(F.col("bucket") + minutes <= now_min)


def match_alerts(a: DataFrame, b: DataFrame, keys: list[str], window: int = 3) -> DataFrame:
    """One-to-one matches of two alert lists: A in time order, each taking its nearest unused B within ``window`` minutes.

    Alerts of one key and minute stay separate.  Both sides meet in one grouping per (key, date), whose minutes are folded in order
    inside the JVM; all three outcomes come out of that fold.  Result: side (both / a / b), a_min, b_min.
    """
    k = [*keys, "et_date"]
    tagged = a.select(*k, "et_min", F.lit(True).alias("is_a")).unionByName(b.select(*k, "et_min", F.lit(False).alias("is_a")))
    mine = lambda side: F.sort_array(F.collect_list(F.when(side, F.col("et_min"))))
    lists = tagged.groupBy(*k).agg(mine(F.col("is_a")).alias("as"), mine(~F.col("is_a")).alias("bs"))
    places = F.transform("bs", lambda m, n: F.struct(m.alias("b_min"), n.alias("n")))
    picks = F.array().cast("array<struct<a_min:int,b_min:int,n:int>>")

    def step(acc, m):
        free = F.filter(places, lambda p: (F.abs(p["b_min"] - m) <= window) & ~F.exists(acc, lambda x: F.coalesce(x["n"] == p["n"], F.lit(False))))
        best = F.array_min(F.transform(free, lambda p: F.struct(F.abs(p["b_min"] - m).alias("dt"), p["b_min"].alias("b_min"), p["n"].alias("n"))))
        return F.concat(acc, F.array(F.struct(m.alias("a_min"), best["b_min"].alias("b_min"), best["n"].alias("n"))))
    folded = lists.withColumn("m", F.aggregate("as", picks, step))
    left = F.filter(places, lambda p: ~F.exists("m", lambda x: F.coalesce(x["n"] == p["n"], F.lit(False))))
    rest = F.transform(left, lambda p: F.struct(F.lit(None).cast("int").alias("a_min"), p["b_min"].alias("b_min"), p["n"].alias("n")))
    one = folded.select(*k, F.explode(F.concat("m", rest)).alias("r"))
    side = F.when(F.col("r.a_min").isNull(), "b").when(F.col("r.b_min").isNull(), "a").otherwise("both")
    return one.select(*k, side.alias("side"), "r.a_min", "r.b_min")


def state_diff(a: DataFrame, b: DataFrame, fields: list[str], keys: list[str], by: list[str]) -> DataFrame:
    """Median signed, median absolute and worst percent difference of each field per group."""
    x = a.select(*keys, *by, *[F.col(f).alias(f"a_{f}") for f in fields])
    y = b.select(*keys, *[F.col(f).alias(f"b_{f}") for f in fields])
    pairs = ", ".join(f"'{f}', try_divide(b_{f} - a_{f}, a_{f}) * 100" for f in fields)
    long = x.join(y, keys).select(*by, F.expr(f"stack({len(fields)}, {pairs}) as (field, d)")).where("d is not null")
    both = long.select(*by, "field", F.expr("stack(2, true, d, false, abs(d)) as (_signed, _d)"))
    q = quantiles(both, [*by, "field", "_signed"], "_d", {"_m": 0.5})
    of = lambda signed, c: F.max(F.when(F.col("_signed") == signed, F.col(c)))
    return q.groupBy(*by, "field").agg(F.max("n").alias("n"), of(True, "_m").alias("median_diff"), of(False, "_m").alias("median_abs"), of(False, "largest").alias("worst_abs"))


def parity(df: DataFrame, a: str, b: str, order: str, by: list[str]) -> DataFrame:
    """First row where both columns exist, rows compared, largest absolute difference and the last values."""
    ok = F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.where(ok).groupBy(*by).agg(F.min(order).alias("first_valid"), F.count(F.lit(1)).alias("compared"), F.max(F.abs(F.col(a) - F.col(b))).alias("max_abs"),
                                         F.max_by(a, order).alias("last_a"), F.max_by(b, order).alias("last_b"))

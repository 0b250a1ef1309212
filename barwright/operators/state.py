"""Running session columns of each minute bar.  Every window is bounded by one (symbol, date)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clock

W = Window
DAY = ["symbol", "et_date"]


def bar_state(bars: DataFrame) -> DataFrame:
    w = W.partitionBy(*DAY).orderBy("et_min")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    rth, pre = F.col("session") == "rth", F.col("session") == "pre"

    def when(cond, c) -> Column:
        return F.when(cond, F.col(c))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    pv = F.sum(F.when(rth, typical * F.col("volume"))).over(upto)
    vol = F.sum(when(rth, "volume")).over(upto)
    s = bars.withColumns({
        "prev_close": F.lag("close").over(w),
        "day_high": F.max(when(rth, "high")).over(upto), "day_low": F.min(when(rth, "low")).over(upto),
        "prev_day_high": F.max(when(rth, "high")).over(before), "prev_day_low": F.min(when(rth, "low")).over(before),
        "ext_high": F.max("high").over(upto), "ext_low": F.min("low").over(upto),
        "prev_ext_high": F.max("high").over(before), "prev_ext_low": F.min("low").over(before),
        "pm_high": F.max(when(pre, "high")).over(upto), "pm_low": F.min(when(pre, "low")).over(upto),
        "pm_volume": F.sum(when(pre, "volume")).over(upto),
        "pm_last": F.last(when(pre, "close"), ignorenulls=True).over(upto),
        "session_open": F.first(when(rth, "open"), ignorenulls=True).over(upto),
        "open_10am": F.first(F.when(F.col("et_min") == 600, F.col("open")), ignorenulls=True).over(upto),
        "cum_volume": vol, "vwap": F.try_divide(pv, vol),
        "last_close": F.last(when(rth, "close"), ignorenulls=True).over(upto),
        "rth_n": F.count(when(rth, "close")).over(upto),
    })
    # columns that count regular bars only: the same rows ordered inside their session
    sw = W.partitionBy(*DAY, "session").orderBy("et_min")
    side = (F.col("close") > F.col("vwap")).cast("int")
    s = s.withColumns({
        "close_15ago": F.when(rth, F.lag("close", 15).over(sw)),
        "stop_low": F.when(rth, F.min("low").over(sw.rowsBetween(-4, 0))),
        "stop_high": F.when(rth, F.max("high").over(sw.rowsBetween(-4, 0))),
        "_side": F.when(rth, side)})
    flip = (F.col("_side") != F.lag("_side").over(sw)).cast("int")
    s = s.withColumn("_flip", F.when(rth, F.coalesce(flip, F.lit(0))))
    crosses = F.sum("_flip").over(sw.rowsBetween(-28, 0))
    return s.withColumn("vwap_crosses_30m", F.when(rth, crosses)).drop("_side", "_flip")


def rvol(state: DataFrame, profile: DataFrame) -> DataFrame:
    """Adds ``rvol``: cumulative volume over the expected volume of the same elapsed minutes.

    The profile has 78 slots per (symbol, session); its running sums are joined on (symbol, et_date, slot).
    """
    w = W.partitionBy("symbol", "et_date")
    mean = F.coalesce("mean_volume", F.lit(0.0))
    sums = profile.select("symbol", "et_date", "slot", mean.alias("_mean"), F.sum(mean).over(w).alias("_whole"),
                          F.coalesce(F.sum(mean).over(w.orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_full"))
    minutes = F.least(F.col("et_min") - clock.RTH_OPEN + 1, F.lit(390))
    s = (state.withColumn("_m", F.when(F.col("session") == "rth", minutes))
              .withColumn("slot", F.least(F.floor(F.col("_m") / 5) * 5, F.lit(385)).cast("int")))
    j = s.join(sums, ["symbol", "et_date", "slot"], "left")
    expected = F.when(F.col("_m") == 390, F.col("_whole")).otherwise(F.col("_full") + F.col("_mean") * (F.col("_m") % 5) / 5)
    value = F.when(expected > 0, F.col("cum_volume") / expected)
    return j.withColumn("rvol", value).drop("_m", "slot", "_mean", "_full", "_whole")


def derived(state: DataFrame, context: DataFrame) -> DataFrame:
    """Percent columns of a bar against the session and the prior day."""
    s = state.join(context, DAY, "left")
    pct = lambda a, b: F.try_divide(a - b, b) * 100.0
    return s.withColumns({
        "gap_pct": pct(F.col("session_open"), F.col("prior_close")),
        "prior_day_chg_pct": pct(F.col("prior_close"), F.col("prior_open")),
        "rth_chg_pct": pct(F.col("last_close"), F.col("session_open")),
        "mom_15m_pct": pct(F.col("close"), F.col("close_15ago")),
        "dist_vwap_pct": pct(F.col("last_close"), F.col("vwap")),
        "day_range_pos": F.try_divide(F.col("last_close") - F.col("day_low"), F.col("day_high") - F.col("day_low")),
    })


def market_regime(price, vwap, band: float = 0.001) -> Column:
    """bullish / bearish / neutral by the distance of the benchmark from its session VWAP."""
    ratio = F.try_divide(price - vwap, vwap)
    return (F.when(vwap.isNull() | (vwap <= 0), "neutral").when(ratio > band, "bullish")
             .when(ratio < -band, "bearish").otherwise("neutral"))


def suggested_stop(state: DataFrame) -> DataFrame:
    """Stop behind the last five regular bars, per direction, with its distance in percent of the close."""
    c = F.col("close")
    return state.where(F.col("session") == "rth").withColumns({
        "stop_long": F.col("stop_low"), "stop_short": F.col("stop_high"),
        "stop_long_pct": F.try_divide(F.abs(c - F.col("stop_low")), c) * 100.0,
        "stop_short_pct": F.try_divide(F.abs(F.col("stop_high") - c), c) * 100.0})

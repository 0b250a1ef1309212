"""Daily-bar indicators and the per-session context (everything known before a session opens)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ordered import Smooth, position, recurrence, rolling
from .indicators import true_range

SYMBOL = ["symbol"]


def with_pos(daily: DataFrame, day: str) -> DataFrame:
    """Number the daily bars of a symbol, year by year."""
    d = daily.withColumn("_y", F.year(day))
    return position(d, SYMBOL, ["_y"], [day], "pos").drop("_y")


def daily_indicators(daily: DataFrame, day: str = "et_date") -> DataFrame:
    d = true_range(with_pos(daily, day), SYMBOL, "pos", "_tr")
    d = recurrence(d, SYMBOL, "pos", [
        Smooth("ema8_d", "close", 8), Smooth("ema9_d", "close", 9), Smooth("ema21_d", "close", 21), Smooth("ema50_d", "close", 50),
        Smooth("atr_d1", "_tr", 5, wilder=True, start=2), Smooth("atr14_d1", "_tr", 14, wilder=True, start=2)])

    def cols(w):
        back = lambda n: w.rowsBetween(-(n - 1), 0)
        full = lambda n, c: F.when(F.count(F.lit(1)).over(back(n)) == n, c)
        return {
            **{f"sma{n}_d": full(n, F.avg("close").over(back(n))) for n in (50, 100, 200)},
            "adv20": F.avg("volume").over(back(20)),
            "hi_52w": F.max("high").over(back(252)), "lo_52w": F.min("low").over(back(252)),
            "days": F.count(F.lit(1)).over(back(252)),
            "highs_60": F.collect_list("high").over(back(60)), "lows_60": F.collect_list("low").over(back(60)),
            "body_ratio": F.avg(F.try_divide(F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low"))).over(back(20)),
            "n20": F.count(F.lit(1)).over(back(20)),
        }
    d = rolling(d, SYMBOL, "pos", 251, cols)
    return d.withColumn("chart_quality", chart_quality()).drop("_tr")


def chart_quality():
    """0-100: half decisive candles over 20 days, half closeness to the EMA(8) in ATRs; 50 with a short history."""
    ext = F.coalesce(F.try_divide(F.abs(F.col("close") - F.col("ema8_d")), F.col("atr_d1")), F.lit(0.0))
    score = F.col("body_ratio") * 100 * 0.5 + F.greatest(F.lit(0.0), (1 - ext / 4.0) * 100) * 0.5
    return F.when(F.col("n20") < 20, F.lit(50.0)).otherwise(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)), 1))


def n_day_extremes(daily_with_pos: DataFrame, days: int) -> DataFrame:
    """Highest high and lowest low of the last ``days`` daily bars, NULL when fewer are loaded."""
    def cols(w):
        b = w.rowsBetween(-(days - 1), 0)
        ok = F.count(F.lit(1)).over(b) == days
        return {"n_day_high": F.when(ok, F.max("high").over(b)), "n_day_low": F.when(ok, F.min("low").over(b))}
    return rolling(daily_with_pos, SYMBOL, "pos", days - 1, cols)


def n_day_levels(sessions: DataFrame, days: int) -> DataFrame:
    """``n_day_high`` / ``n_day_low`` of the ``days`` sessions before each session; NULL while there are fewer."""
    d = n_day_extremes(with_pos(sessions, "et_date"), days)
    prior = rolling(d, SYMBOL, "pos", 1, lambda w: {"_h": F.lag("n_day_high").over(w), "_l": F.lag("n_day_low").over(w)})
    return prior.select("symbol", "et_date", F.col("_h").alias("n_day_high"), F.col("_l").alias("n_day_low"))


# context column -> daily column of the session before
CONTEXT = {"prior_open": "open", "prior_high": "high", "prior_low": "low", "prior_close": "close",
           **{c: c for c in ("ema8_d", "ema9_d", "ema21_d", "ema50_d", "atr_d1", "atr14_d1", "sma50_d", "sma100_d", "sma200_d",
                             "adv20", "hi_52w", "lo_52w", "days", "highs_60", "lows_60", "chart_quality")}}


def daily_context(sessions: DataFrame, n_days: int = 3) -> DataFrame:
    """Values of the latest earlier session, keyed by the session they apply to (strictly earlier, no look-ahead)."""
    d = daily_indicators(sessions).withColumnRenamed("pos", "spos")
    d = n_day_extremes(d.withColumnRenamed("spos", "pos"), n_days)
    prior = rolling(d, SYMBOL, "pos", 1, lambda w: {f"_c_{k}": F.lag(v).over(w) for k, v in
                                                    {**CONTEXT, "n_day_high": "n_day_high", "n_day_low": "n_day_low"}.items()})
    return prior.select("symbol", "et_date", *[F.col(f"_c_{k}").alias(k) for k in (*CONTEXT, "n_day_high", "n_day_low")])


def bar_metrics(daily: DataFrame, days: int = 20, day: str = "d") -> DataFrame:
    """Average volume, dollar volume, range % and last price of the newest ``days`` bars of each symbol."""
    d = with_pos(daily, day)
    last = d.groupBy("symbol").agg(F.max("pos").alias("_top"))
    recent = d.join(last, "symbol").where(F.col("pos") > F.col("_top") - days)
    g = recent.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg("volume").alias("avg_volume"),
        F.avg(F.col("high") - F.col("low")).alias("_range"), F.max_by("close", day).alias("last_price"))
    return (g.where((F.col("n") >= max(5, days // 2)) & (F.col("last_price") > 0))
             .withColumn("avg_dollar_volume", F.col("avg_volume") * F.col("last_price"))
             .withColumn("atr_pct", F.col("_range") / F.col("last_price") * 100).drop("_range"))

"""Candles of several timeframes from minute bars, with coverage and completion columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clock
from ..functions.ordered import rolling

W = Window
CARRIED = (5, 15, 30, 60)       # timeframes whose candle history continues over sessions
SERIES = ["symbol", "tf", "series"]


def ohlcv(order) -> list[Column]:
    return [F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", order).alias("close"), F.sum("volume").alias("volume")]


def _chosen(c: str, cases: dict) -> Column:
    """The value that belongs to what ``c`` holds, NULL for anything else."""
    return F.coalesce(*[F.when(F.col(c) == k, v) for k, v in cases.items()])


def candles(state: DataFrame, timeframes=clock.TIMEFRAMES) -> DataFrame:
    """One row per candle, covered or not.

    ``covered``: every minute present, from the slot start.  ``done_min``/``done_session``: the next incoming bar of the
    same date, when the completion is seen (NULL for the last candle of a date).  ``series``: candles of 1-3 minutes restart
    every session, longer ones continue.  ``cpos`` numbers the covered candles of a series and ``cbefore`` counts those that
    precede any candle; ``rpos``/``rbefore`` do the same for covered candles that started in the regular session.
    """
    day = ["symbol", "et_date"]
    nxt = W.partitionBy(*day).orderBy("et_min")
    # the next session goes through the aggregate by its number: with text among the values rows would be sorted instead of hashed
    b = (state.withColumn("nmin", F.lead("et_min").over(nxt))
              .withColumn("nsess", F.lead("session").over(nxt))
              .withColumn("_ns", _chosen("nsess", {s: F.lit(n) for n, s in enumerate(clock.SESSIONS)})).drop("nsess")
              .withColumn("tf", F.explode(F.array(*[F.lit(t) for t in timeframes])))
              .withColumn("key_session", clock.key_session("et_min"))
              .withColumn("slot", clock.candle_slot("et_min", F.col("tf"))))
    agg = b.groupBy(*day, "tf", "key_session", "slot").agg(
        *ohlcv("et_min"), F.max_by("vwap", "et_min").alias("vwap"), F.min("et_min").alias("start_min"),
        F.max("et_min").alias("last_min"), F.count(F.lit(1)).cast("int").alias("n_bars"),
        F.max_by("nmin", "et_min").alias("done_min"), F.max_by("_ns", "et_min").alias("_ns")) \
        .withColumn("done_session", _chosen("_ns", {n: F.lit(s) for n, s in enumerate(clock.SESSIONS)})).drop("_ns")
    expected = (F.when(F.col("key_session") == "pre", F.lit(clock.PRE_OPEN)).otherwise(F.lit(clock.RTH_OPEN))
                + F.col("slot") * F.col("tf"))
    c = (agg.withColumn("covered", (F.col("n_bars") == F.col("tf")) & (F.col("start_min") == expected)
                        & (F.col("last_min") == expected + F.col("tf") - 1))
            .withColumn("start_session", clock.session_of("start_min"))
            .withColumn("series", F.when(F.col("tf") >= 5, F.lit("all")).otherwise(F.col("et_date").cast("string"))))
    is_r = F.col("covered") & (F.col("start_session") == "rth")
    inside = W.partitionBy(*day, "tf").orderBy("start_min")
    c = (c.withColumn("_cc", F.sum(F.col("covered").cast("long")).over(inside.rowsBetween(W.unboundedPreceding, 0)))
          .withColumn("_rc", F.sum(is_r.cast("long")).over(inside.rowsBetween(W.unboundedPreceding, 0))))
    # candles of the earlier sessions: one row per (symbol, date) with a count per carried timeframe
    counts = [a for t in CARRIED for a in (
        F.count_if(F.col("covered") & (F.col("tf") == t)).alias(f"c{t}"), F.count_if(is_r & (F.col("tf") == t)).alias(f"r{t}"))]
    # every bar lies in a candle of each timeframe, so the carried ones alone know all dates
    per_day = c.where(F.col("tf").isin(*([t for t in timeframes if t in CARRIED] or timeframes))).groupBy(*day).agg(*counts)
    before = W.partitionBy("symbol").orderBy("et_date").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_day.select(*day, *[F.coalesce(F.sum(f"{p}{t}").over(before), F.lit(0)).alias(f"{p}{t}")
                                     for t in CARRIED for p in "cr"])
    j = c.join(offsets, day)

    def off(p):
        col = F.lit(0).cast("long")
        for t in CARRIED:
            col = F.when(F.col("tf") == t, F.col(f"{p}{t}")).otherwise(col)
        return col
    total_c, total_r = F.col("_cc") + off("c"), F.col("_rc") + off("r")
    return (j.withColumn("cpos", F.when(F.col("covered"), total_c))
             .withColumn("cbefore", total_c - F.col("covered").cast("long"))
             .withColumn("rpos", F.when(is_r, total_r))
             .withColumn("rbefore", total_r - is_r.cast("long"))
             .select(*day, "tf", "series", "key_session", "start_session", "slot", "start_min", "last_min", "n_bars", "covered",
                     "done_min", "done_session", "cpos", "cbefore", "rpos", "rbefore",
                     "open", "high", "low", "close", "volume", "vwap"))


def covered(candles: DataFrame, *timeframes: int) -> DataFrame:
    c = candles.where("covered")
    return c.where(F.col("tf").isin(*timeframes)) if timeframes else c


def recent(candles: DataFrame, back: int, columns, pos: str = "cpos") -> DataFrame:
    """Look-back columns over the last ``back`` + 1 covered candles of each series.

    ``columns(w)`` may use ``_gap``: true when the slot does not follow the previous one inside the same date and session.
    """
    same = (F.col("_pd") == F.col("et_date")) & (F.col("_ps") == F.col("key_session"))

    def cols(w):
        return columns(w)
    base = rolling(candles, SERIES, pos, 1, lambda w: {
        "_pd": F.lag("et_date").over(w), "_ps": F.lag("key_session").over(w), "_pslot": F.lag("slot").over(w)})
    base = base.withColumn("_gap", F.coalesce(same & (F.col("slot") != F.col("_pslot") + 1), F.lit(False))) \
               .drop("_pd", "_ps", "_pslot")
    return rolling(base, SERIES, pos, back, cols).drop("_gap")


def last_n_ok(w, n: int) -> Column:
    """The last ``n`` candles exist and no slot is missing between them."""
    count = F.count(F.lit(1)).over(w.rowsBetween(-(n - 1), 0)) == n
    if n == 1:
        return count
    return count & (F.sum(F.col("_gap").cast("int")).over(w.rowsBetween(-(n - 2), 0)) == 0)


def asof_candle(candles: DataFrame, values: DataFrame, cols: list[str], pos: str = "cpos", before: str = "cbefore") -> DataFrame:
    """Each candle with ``cols`` of the newest completed candle before it (an equi-join on the candle number)."""
    v = values.select(*SERIES, F.col(pos).alias("_at"), *cols)
    return candles.join(v, [candles.symbol == v.symbol, candles.tf == v.tf, candles.series == v.series,
                            candles[before] == v["_at"]], "left") \
                  .select(*[candles[c] for c in ("symbol", "et_date", "tf", "key_session", "slot")],
                          *[v[c] for c in cols])


def bars_with_candle(bars: DataFrame, per_candle: DataFrame, tf: int) -> DataFrame:
    """Attach candle-level columns to every minute bar of the candle (equi-join on the candle key)."""
    keyed = (bars.withColumn("key_session", clock.key_session("et_min"))
                 .withColumn("slot", clock.candle_slot("et_min", F.lit(tf))))
    return keyed.join(per_candle.where(F.col("tf") == tf), ["symbol", "et_date", "key_session", "slot"])


def history_candles(bars_5m: DataFrame) -> DataFrame:
    """15/30/60-minute regular-session candles from 5-minute history, without a coverage test."""
    b = (bars_5m.where(clock.session_of("et_min") == "rth")
                .withColumn("tf", F.explode(F.array(*[F.lit(t) for t in CARRIED])))
                .withColumn("slot", clock.candle_slot("et_min", F.col("tf"))))
    return b.groupBy("symbol", "et_date", "tf", "slot").agg(*ohlcv("et_min"))


def widen(bars: DataFrame, minutes: int) -> DataFrame:
    """Clock-floored bars of ``minutes`` (30-minute feed to 1 or 4 hours); vwap averaged, trade counts summed."""
    return (bars.withColumn("bucket", (F.floor(F.col("et_min") / minutes) * minutes).cast("int"))
                .groupBy("symbol", "et_date", "bucket")
                .agg(*ohlcv("et_min"), F.avg("vwap").alias("vwap"), F.sum("trade_count").alias("trade_count")))


def weekly(daily: DataFrame, day: str = "d") -> DataFrame:
    return daily.groupBy("symbol", F.date_trunc("week", F.col(day)).cast("date").alias("week")).agg(*ohlcv(day))


def session_bars(bars: DataFrame) -> DataFrame:
    """The regular session of each (symbol, date) as one daily bar."""
    return bars.where(F.col("session") == "rth").groupBy("symbol", "et_date").agg(*ohlcv("et_min"))


def chart_buckets(bars: DataFrame, tf: int) -> DataFrame:
    """Chart candles: an hour and longer are anchored at the open, shorter ones at the clock."""
    m = F.col("et_min")
    bucket = (F.floor((m - clock.RTH_OPEN) / tf) * tf + clock.RTH_OPEN) if tf >= 60 else F.floor(m / tf) * tf
    return (bars.withColumn("bucket", bucket.cast("int")).groupBy("symbol", "et_date", "bucket")
                .agg(*ohlcv("et_min"), F.count(F.lit(1)).alias("n_bars")))


def volume_profile(bars: DataFrame, sessions: int = 20) -> DataFrame:
    """Per (symbol, session) and 5-minute slot after the open: mean volume of the slot over the ``sessions`` sessions before (no look-ahead).

    Every session has all 78 slots; a slot that no earlier session traded has a NULL mean.
    """
    from .daily import with_pos
    slot = (F.floor(F.col("et_min") / 5) * 5 - clock.RTH_OPEN).cast("int")
    five = (bars.where(F.col("et_min").between(clock.RTH_OPEN, clock.RTH_CLOSE - 1))
                .groupBy("symbol", "et_date", slot.alias("slot")).agg(F.sum("volume").alias("volume")))
    days = with_pos(five.select("symbol", "et_date").distinct(), "et_date")
    grid = days.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(385), F.lit(5)))).join(five, ["symbol", "et_date", "slot"], "left")
    out = rolling(grid, ["symbol", "slot"], "pos", sessions, lambda w: {"mean_volume": F.avg("volume").over(w.rowsBetween(-sessions, -1))})
    return out.select("symbol", "et_date", "slot", "mean_volume")


def opening_range(bars: DataFrame, minutes: int, trusted: list[str]) -> DataFrame:
    """High/low of the first ``minutes`` when every minute is there and from a trusted source, with an identity digest."""
    w = bars.where(F.col("et_min").between(clock.RTH_OPEN, clock.RTH_OPEN + minutes - 1))
    ok = (F.count(F.lit(1)) == minutes) & F.every(F.col("source").isin(*trusted))
    g = (w.groupBy("symbol", "et_date")
          .agg(F.max("high").alias("or_high"), F.min("low").alias("or_low"), ok.alias("ok"),
               F.sort_array(F.collect_list(F.struct("et_min", "high", "low"))).alias("rows"))
          .where("ok"))
    return g.select("symbol", "et_date", F.lit(minutes).alias("interval"), "or_high", "or_low",
                    F.sha2(F.to_json("rows"), 256).alias("range_id"))


def premarket(bars: DataFrame) -> DataFrame:
    return bars.where(F.col("session") == "pre").groupBy("symbol", "et_date").agg(
        F.max("high").alias("pm_high"), F.min("low").alias("pm_low"), F.sum("volume").alias("pm_volume"),
        F.max_by("close", "et_min").alias("pm_last"))

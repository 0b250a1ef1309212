"""Candles, session columns and clock projections."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..operators import candles as co
from ..operators import state as st
from .registry import out, query, r6

OHLCV = "open high low close volume"

@query("bars_minute", "select symbol, day, et_min, open, high, low, close, volume, session from bars")
def _(t):
    return out(t.bars, "symbol day et_min open high low close volume session")


@query("candles_covered", """select symbol, day, tf, session as key_session, slot, open, high, low, close, volume, n_bars, covered,
 start_min, done_min, done_session, cpos, cbefore, rpos, rbefore, round(vwap, 6) as vwap from candles""")
def _(t):
    return out(t.candles, f"symbol day tf key_session slot {OHLCV} n_bars covered start_min done_min done_session cpos cbefore "
                          "rpos rbefore", "vwap")


@query("candles_from_history", """select symbol, day, tf, cast(floor((b - 570) / tf) as int) as slot, min_by(open, b) as open,
 max(high) as high, min(low) as low, max_by(close, b) as close, sum(volume) as volume from (
  select symbol, day, cast(floor(et_min / 5) * 5 as int) as b, min_by(open, et_min) as open, max(high) as high, min(low) as low,
   max_by(close, et_min) as close, sum(volume) as volume from bars where session = 'rth' group by all)
 cross join (select unnest([5, 15, 30, 60]) as tf) group by all""")
def _(t):
    five = co.chart_buckets(t.bars.where("session = 'rth'"), 5).withColumnRenamed("bucket", "et_min")
    return out(co.history_candles(five), f"symbol day tf slot {OHLCV}")


@query("state_five_minute_slots", """select symbol, day, start_min as slot5, open, high, low, close, volume from candles
 where tf = 5 and covered and session = 'rth'""")
def _(t):
    c = co.covered(t.candles, 5).where("start_session = 'rth'").withColumnRenamed("start_min", "slot5")
    return out(c, f"symbol day slot5 {OHLCV}")


@query("candles_widened", """select symbol, day, h as bucket, width, min_by(open, b) as open, max(high) as high, min(low) as low,
 max_by(close, b) as close, sum(volume) as volume, round(avg(vwap), 6) as vwap, cast(sum(trade_count) as bigint) as trade_count
 from (select *, cast(floor(b / width) * width as int) as h from (
  select symbol, day, cast(floor(et_min / 30) * 30 as int) as b, min_by(open, et_min) as open, max(high) as high, min(low) as low,
   max_by(close, et_min) as close, sum(volume) as volume, max_by(vwap, et_min) as vwap, count(*) as trade_count
  from state where session = 'rth' group by all) cross join (select unnest([60, 240]) as width)) group by all""")
def _(t):
    s = t.state.where("session = 'rth'").withColumn("b", (F.floor(F.col("et_min") / 30) * 30).cast("int"))
    half = (s.groupBy("symbol", "et_date", "b").agg(*co.ohlcv("et_min"), F.max_by("vwap", "et_min").alias("vwap"),
                                                    F.count(F.lit(1)).alias("trade_count")).withColumnRenamed("b", "et_min"))
    both = co.widen(half, 60).withColumn("width", F.lit(60)).unionByName(co.widen(half, 240).withColumn("width", F.lit(240)))
    return out(both, f"symbol day bucket width {OHLCV} trade_count", "vwap")


@query("candles_weekly", """select symbol, cast(date_trunc('week', d) as date)::varchar as week, min_by(open, d) as open,
 max(high) as high, min(low) as low, max_by(close, d) as close, sum(volume) as volume from daily group by 1, 2""")
def _(t):
    return co.weekly(t.daily).withColumn("week", F.col("week").cast("string"))


@query("session_daily_bars", "select symbol, day, open, high, low, close, volume from sessions")
def _(t):
    return out(t.sessions, f"symbol day {OHLCV}")


@query("chart_buckets", """select symbol, day, tf, case when tf >= 60 then cast(floor((et_min - 570) / tf) * tf + 570 as int)
 else cast(floor(et_min / tf) * tf as int) end as bucket, min_by(open, et_min) as open, max(high) as high, min(low) as low,
 max_by(close, et_min) as close, sum(volume) as volume, count(*) as n_bars
 from bars cross join (select unnest([15, 60]) as tf) group by all""")
def _(t):
    a = co.chart_buckets(t.bars, 15).withColumn("tf", F.lit(15))
    b = co.chart_buckets(t.bars, 60).withColumn("tf", F.lit(60))
    return out(a.unionByName(b), f"symbol day tf bucket {OHLCV} n_bars")


@query("volume_profile", "select symbol, day, slot, round(mv, 6) as mean_volume from profile")
def _(t):
    return out(t.profile, "symbol day slot", "mean_volume")


@query("opening_range", """select symbol, day, n as interval, max(high) as or_high, min(low) as or_low
 from bars cross join (select unnest([5, 15]) as n) where et_min between 570 and 569 + n and source in ('stream', 'history')
 group by all having count(*) = n""")
def _(t):
    trusted = ["stream", "history"]
    r = co.opening_range(t.bars, 5, trusted).unionByName(co.opening_range(t.bars, 15, trusted))
    return out(r, "symbol day interval or_high or_low")


@query("premarket_levels", """select symbol, day, max(high) as pm_high, min(low) as pm_low, sum(volume) as pm_volume,
 max_by(close, et_min) as pm_last from bars where session = 'pre' group by all""")
def _(t):
    return out(co.premarket(t.bars), "symbol day pm_high pm_low pm_volume pm_last")


STATE_KEEP = ("symbol day et_min prev_close day_high day_low prev_day_high prev_day_low ext_high ext_low prev_ext_high prev_ext_low "
              "pm_high pm_low pm_volume pm_last session_open open_10am cum_volume last_close close_15ago stop_low stop_high rth_n")


@query("bar_state_running", f"select {', '.join(STATE_KEEP.split())}, {r6('vwap')} from state")
def _(t):
    return out(t.state, STATE_KEEP, "vwap")


@query("hod_lod_running", """select symbol, day, et_min, day_high, day_low, prev_day_high, prev_day_low, ext_high, ext_low
 from state where session = 'rth'""")
def _(t):
    return out(t.state.where("session = 'rth'"), "symbol day et_min day_high day_low prev_day_high prev_day_low ext_high ext_low")


@query("session_opens", """select symbol, day, max(session_open) as session_open, max(open_10am) as open_10am from state
 group by all""")
def _(t):
    return out(t.state.groupBy("symbol", "et_date").agg(F.max("session_open").alias("session_open"),
                                                        F.max("open_10am").alias("open_10am")), "symbol day session_open open_10am")


@query("vwap_session", "select symbol, day, et_min, round(vwap, 6) as vwap from state where session = 'rth'")
def _(t):
    return out(t.state.where("session = 'rth'"), "symbol day et_min", "vwap")


@query("vwap_side_flips", """select symbol, day, et_min, coalesce(sum(flip) over (partition by symbol, day order by et_min
 rows between 28 preceding and current row), 0)::bigint as vwap_crosses_30m from (
 select symbol, day, et_min, case when (close > vwap) <> lag(close > vwap) over (partition by symbol, day order by et_min)
 then 1 else 0 end as flip from state where session = 'rth')""")
def _(t):
    return out(t.state.where("session = 'rth'"), "symbol day et_min vwap_crosses_30m")


@query("suggested_stop", """select symbol, day, et_min, stop_low as stop_long, stop_high as stop_short,
 round(abs(close - stop_low) / close * 100, 6) as stop_long_pct, round(abs(stop_high - close) / close * 100, 6) as stop_short_pct
 from state where session = 'rth'""")
def _(t):
    return out(st.suggested_stop(t.state), "symbol day et_min stop_long stop_short", "stop_long_pct stop_short_pct")


@query("market_regime", """select day, et_min, case when vwap is null or vwap <= 0 then 'neutral'
 when (close - vwap) / vwap > 0.001 then 'bullish' when (close - vwap) / vwap < -0.001 then 'bearish' else 'neutral' end as regime
 from state where symbol = 'S00'""")
def _(t):
    s = t.state.where("symbol = 'S00'").withColumn("regime", st.market_regime(F.col("close"), F.col("vwap")))
    return out(s, "day et_min regime")


@query("clock_et_columns", """select event_id, cast(et as date)::varchar as et_date,
 cast(hour(et) * 60 + minute(et) as int) as et_min, cast(floor((hour(et) * 60 + minute(et)) / 5) * 5 as int) as slot5,
 case when hour(et) * 60 + minute(et) < 570 then 'pre' when hour(et) * 60 + minute(et) < 960 then 'rth' else 'post' end as session
 from (select event_id, ts - interval 5 hour as et from events)""")
def _(t):
    e = clock.add_clock(t.raw("events").select("event_id", "ts"))      # the table lies in January: New York is UTC-5
    return e.select("event_id", F.col("et_date").cast("string").alias("et_date"), "et_min", "slot5", "session")


@query("clock_candle_keys", """select symbol, day, et_min, tf, session as key_session,
 cast(floor((et_min - case when session = 'pre' then 240 else 570 end) / tf) as int) as slot
 from bars cross join (select unnest([1, 2, 3, 5, 15, 30, 60]) as tf)""")
def _(t):
    b = t.bars.withColumn("tf", F.explode(F.array(*[F.lit(x) for x in clock.TIMEFRAMES])))
    b = b.withColumn("key_session", clock.key_session("et_min")).withColumn("slot", clock.candle_slot("et_min", F.col("tf")))
    return out(b, "symbol day et_min tf key_session slot")


@query("clock_session_now", """select event_id, case when dow in (0, 6) or m < 240 or m >= 1200 then 'closed' when m < 570 then 'pre'
 when m < 960 then 'rth' else 'post' end as session_label,
 strftime(date_trunc('day', et) + to_minutes(cast(case when dow in (0, 6) or m < 240 or m >= 1200 then 240 when m < 570 then 570
   when m < 960 then 960 else 1200 end as bigint)) + to_days(cast(case when dow = 6 then 2 when dow = 0 then 1
   when dow = 5 and m >= 1200 then 3 when m >= 1200 then 1 else 0 end as int)), '%Y-%m-%d %H:%M') as next_boundary
 from (select event_id, ts as et, dayofweek(ts) as dow, hour(ts) * 60 + minute(ts) as m from events)""")
def _(t):
    e = clock.session_clock(t.raw("events").select("event_id", "ts"), "ts")
    return e.select("event_id", "session_label", F.date_format("next_boundary", "yyyy-MM-dd HH:mm").alias("next_boundary"))

"""Event detectors; every query returns the same fire columns."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candles as co
from ..operators import indicators as ind
from ..operators import state as st
from ..operators import triggers as tr
from .q_indicators import streaks, swing_cte
from .registry import CTES, add_smooth, out, query


def inputs(t) -> tr.Inputs:
    return tr.Inputs(st.derived(t.state, t.context), t.candles, t.sessions)


def show(df):
    return out(df, "symbol day et_min trigger option tf direction", "value")


def fire(src, cond, trig, opt, direction, value, tf="tf", qualify=""):
    q = f" qualify {qualify}" if qualify else ""
    return (f"(select symbol, day, et_min, '{trig}' as trigger, cast({opt} as varchar) as option, cast({tf} as int) as tf, "
            f"'{direction}' as direction, round(cast({value} as double), 6) as value from {src} where {cond}{q})")


def fires(*parts):
    return "\nunion all ".join(parts)


def once(*keys):
    return f"row_number() over (partition by {', '.join(('symbol', 'day') + keys)} order by et_min) = 1"


def edge_src(src, cond, extra="tf"):
    """Rows of ``src`` on which ``cond`` turns true; NULL leaves the latch alone."""
    return (f"(select * from (select *, last_value(cnd ignore nulls) over (partition by symbol, day{', ' + extra if extra else ''} "
            f"order by et_min rows between unbounded preceding and 1 preceding) as latch from (select *, {cond} as cnd from {src})) "
            f"where cnd and not coalesce(latch, false))")


CTES["sb"] = "select * from state left join ctx using (symbol, day)"
CTES["bc"] = """select s.*, c.tf, c.slot, c.series, c.cbefore, c.rbefore from sb s join candles c on s.symbol = c.symbol
 and s.day = c.day and s.session = c.session and c.slot = cast(floor((s.et_min - case when s.session = 'pre' then 240 else 570 end) / c.tf) as int)"""
CTES["done"] = "select * exclude (session), session as ksess, done_min as et_min, done_session as session from cg where done_min is not null"


# ---- minute bars ---------------------------------------------------------------------------------------------------------

@query("trigger_hod", fires(
    fire("state", "session = 'rth' and high > prev_day_high", "hod", "'high'", "long", "high", "1"),
    fire("state", "session = 'rth' and low < prev_day_low", "hod", "'low'", "short", "low", "1")))
def _(t):
    return show(tr.new_extreme(inputs(t), "hod"))


@query("trigger_hod_ext", fires(
    fire("state", "high > prev_ext_high", "hod_ext", "'high'", "long", "high", "1"),
    fire("state", "low < prev_ext_low", "hod_ext", "'low'", "short", "low", "1")))
def _(t):
    return show(tr.new_extreme(inputs(t), "hod_ext"))


CTES["c1tr"] = """select * from (select *, greatest(high - low, abs(high - pc), abs(low - pc)) as tr from (select *, lag(close) over
 (partition by symbol, series order by cpos) as pc from candles where tf = 1 and covered)) where cpos >= 2"""
add_smooth("c1atr20", "c1tr", "symbol, series", "tr", 20, wilder=True, start=2, pos="cpos")
CTES["nearhod"] = """select b.*, y as atr from bc b left join c1atr20 a on a.symbol = b.symbol and a.series = b.series and a.cpos = b.cbefore
 where b.tf = 1 and b.session = 'rth'"""


@query("trigger_near_hod", fires(
    fire(edge_src("nearhod", "case when atr > 0 and prev_day_high is not null then prev_day_high - close > 0 and prev_day_high - close < atr and high <= prev_day_high end"),
         "true", "near_hod", "'high'", "long", "prev_day_high - close"),
    fire(edge_src("nearhod", "case when atr > 0 and prev_day_low is not null then close - prev_day_low > 0 and close - prev_day_low < atr and low >= prev_day_low end"),
         "true", "near_hod", "'low'", "short", "close - prev_day_low")))
def _(t):
    return show(tr.near_hod(inputs(t)))


def breach_sql(trig, hi, lo, p, sess):
    s = f"session in ({sess})"
    return fires(fire("sb", f"{s} and high > {hi} and coalesce({p}_high <= {hi}, true)", trig, "'high'", "long", hi, "1"),
                 fire("sb", f"{s} and low < {lo} and coalesce({p}_low >= {lo}, true)", trig, "'low'", "short", lo, "1"))


def n_day_sql(days):
    """Bars with the extremes of the ``days`` sessions before theirs."""
    return f"""(select s.*, l.nh, l.nl from state s left join (select symbol, day, case when count(*) over w = {days} then max(high) over w end as nh, case when count(*) over w = {days} then min(low) over w end as nl
 from sessions window w as (partition by symbol order by pos rows between {days} preceding and 1 preceding)) l using (symbol, day))"""


for _days in (3, 5, 60):
    @query("trigger_n_day_high_low" if _days == 3 else f"trigger_{_days}_day_high_low", fires(
        fire(n_day_sql(_days), "session = 'rth' and high > nh and coalesce(prev_day_high <= nh, true)", "hi_lo_60d", "'high'", "long", "nh", "1"),
        fire(n_day_sql(_days), "session = 'rth' and low < nl and coalesce(prev_day_low >= nl, true)", "hi_lo_60d", "'low'", "short", "nl", "1")))
    def _(t, days=_days):
        return show(tr.n_day_breach(inputs(t), days))


@query("trigger_52_week_high_low", breach_sql("hi_lo_52w", "hi_52w", "lo_52w", "prev_day", "'rth'"))
def _(t):
    return show(tr.first_breach(inputs(t), "hi_lo_52w", "hi_52w", "lo_52w"))


@query("trigger_prior_day_break", breach_sql("prior_day_break", "prior_high", "prior_low", "prev_ext", "'pre', 'rth'"))
def _(t):
    return show(tr.first_breach(inputs(t), "prior_day_break", "prior_high", "prior_low", extended=True))


@query("trigger_premarket_break", breach_sql("pm_break", "pm_high", "pm_low", "prev_day", "'rth'"))
def _(t):
    return show(tr.first_breach(inputs(t), "pm_break", "pm_high", "pm_low"))


@query("trigger_pct_change", fires(
    fire("sb", "(prev_close / prior_close - 1) * 100 < 5 and (close / prior_close - 1) * 100 >= 5", "pct_change", "'up'", "long", "(close / prior_close - 1) * 100", "1"),
    fire("sb", "(prev_close / prior_close - 1) * 100 > -5 and (close / prior_close - 1) * 100 <= -5", "pct_change", "'down'", "short", "(close / prior_close - 1) * 100", "1")))
def _(t):
    return show(tr.pct_change(inputs(t)))


CTES["first_rth"] = "select *, (session_open / prior_close - 1) * 100 as g from sb where session = 'rth' qualify " + once()


@query("trigger_gap", fires(fire("first_rth", "g >= 2", "gap", "'up'", "long", "g", "1"),
                            fire("first_rth", "g <= -2", "gap", "'down'", "short", "g", "1")))
def _(t):
    return show(tr.gap(inputs(t)))


@query("trigger_rvol_cross", fire(edge_src("rvol", "rvol >= 1.2", ""), "true", "rvol_cross", "''", "neutral", "rvol", "1"))
def _(t):
    return show(tr.rvol_cross(st.rvol(inputs(t).bars, t.profile), 1.2))


CTES["rsb"] = """select s.*, (s.close - s.close_15ago) / s.close_15ago * 100 - b.mom as rs from state s left join
 (select day, et_min as m0, coalesce(lead(et_min) over (partition by day order by et_min) - 1, 1200) as m1,
  (close - close_15ago) / close_15ago * 100 as mom from state where symbol = 'S00' and session = 'rth') b
 on s.day = b.day and s.et_min between b.m0 and b.m1 where s.session = 'rth'"""


@query("trigger_rs_benchmark", fires(
    fire(edge_src("rsb", "rs >= 0.5", ""), "true", "rs_spy", "'strong'", "long", "rs", "1"),
    fire(edge_src("rsb", "rs <= -0.5", ""), "true", "rs_spy", "'weak'", "short", "rs", "1")))
def _(t):
    return show(tr.rs_benchmark(inputs(t), "S00"))


@query("trigger_momentum_burst", fires(
    fire("sb", "session = 'rth' and high > low and close >= open and high - low >= 0.25 * atr_d1 and (close - low) / (high - low) >= 0.7", "momentum_burst", "'up'", "long", "(high - low) / atr_d1", "1"),
    fire("sb", "session = 'rth' and high > low and close <= open and high - low >= 0.25 * atr_d1 and 1 - (close - low) / (high - low) >= 0.7", "momentum_burst", "'down'", "short", "(high - low) / atr_d1", "1")))
def _(t):
    return show(tr.momentum_burst(inputs(t)))


CTES["runbase"] = """select symbol, series, cpos, case when n20 = 20 and g = 0 then a20 when nr >= 10 then ar end as base from (
 select *, count(*) over (w rows between 19 preceding and current row) as n20, sum(gap) over (w rows between 18 preceding and current row) as g,
  avg(high - low) over (w rows between 19 preceding and current row) as a20, count(*) over (w rows between 127 preceding and current row) as nr,
  avg(high - low) over (w rows between 127 preceding and current row) as ar from cg where tf = 1
 window w as (partition by symbol, series order by cpos))"""
CTES["run2"] = """select b.*, case when base > 0 then (close - prev_close) / base end as chg from bc b left join runbase r
 on r.symbol = b.symbol and r.series = b.series and r.cpos = b.cbefore where tf = 1"""


@query("trigger_running_pct", fires(
    fire("sb", "(close - prev_close) / prev_close * 100 >= 0.5", "running", "'up'", "long", "(close - prev_close) / prev_close * 100", "1"),
    fire("sb", "(close - prev_close) / prev_close * 100 <= -0.5", "running", "'down'", "short", "(close - prev_close) / prev_close * 100", "1")))
def _(t):
    return show(tr.running(inputs(t)))


@query("trigger_running_avg_candle", fires(
    fire("run2", "chg >= 1.5", "running", "'up'", "long", "chg", "1"), fire("run2", "chg <= -1.5", "running", "'down'", "short", "chg", "1")))
def _(t):
    return show(tr.running(inputs(t), 1.5, "candle"))


CTES["tv"] = """select *, case when count(*) over w = 10 then avg(high - low) over w end as ar from state
 window w as (partition by symbol, day, session order by et_min rows between 10 preceding and 1 preceding)"""


@query("trigger_through_vwap", fires(
    fire("tv", "session = 'rth' and prev_close <= vwap and close > vwap and high - low >= 1.5 * ar and ar > 0", "through_vwap", "'above'", "long", "(high - low) / ar", "1"),
    fire("tv", "session = 'rth' and prev_close >= vwap and close < vwap and high - low >= 1.5 * ar and ar > 0", "through_vwap", "'below'", "short", "(high - low) / ar", "1")))
def _(t):
    return show(tr.through_vwap(inputs(t), 1.5))


@query("trigger_hod_breakout", fires(
    fire("state", "session = 'rth' and high > prev_day_high", "hod_breakout", "'long'", "long", "high - prev_day_high", "1"),
    fire("state", "session = 'rth' and low < prev_day_low", "hod_breakout", "'short'", "short", "prev_day_low - low", "1")))
def _(t):
    return show(tr.hod_breakout(inputs(t)))


@query("extreme_event_stream", """select symbol, day, et_min, type, price, row_number() over (partition by day order by et_min, symbol, type) as seq
 from (select symbol, day, et_min, 'HOD' as type, high as price from state where session = 'rth' and symbol <> 'S00' and high > prev_day_high
 union all select symbol, day, et_min, 'LOD', low from state where session = 'rth' and symbol <> 'S00' and low < prev_day_low)""")
def _(t):
    return out(tr.extreme_events(inputs(t), "S00"), "symbol day et_min type price seq")


@query("extreme_events_of_members", """select symbol, day, et_min, type, price from (select symbol, day, et_min, 'HOD' as type, high as price from state where session = 'rth' and symbol <> 'S00' and high > prev_day_high
 union all select symbol, day, et_min, 'LOD', low from state where session = 'rth' and symbol <> 'S00' and low < prev_day_low) where symbol in (select symbol from sessions group by symbol having count(*) >= 8)""")
def _(t):
    """Events of the symbols in a list (here: symbols with at least eight sessions)."""
    members = t.sessions.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n >= 8").select("symbol")
    return out(tr.members_only(tr.extreme_events(inputs(t), "S00"), members), "symbol day et_min type price")


# ---- bars with the newest completed candle -----------------------------------------------------------------------------------

CTES["swing1"] = swing_cte(1)
for _n in (1, 5):
    CTES[f"bs{_n}"] = f"""select b.*, s.swing_high, s.swing_low from bc b join swing{_n} s on s.symbol = b.symbol and s.tf = b.tf
 and s.series = b.series and s.cpos = b.cbefore"""
CUR = ("tf", "session", "slot")


@query("trigger_new_candle_high", fire("bs1", "tf = 5 and high > swing_high", "new_candle_high", "tf", "long", "swing_high", qualify=once(*CUR)))
def _(t):
    return show(tr.new_candle_extreme(inputs(t), 5).where("direction = 'long'"))


@query("trigger_new_candle_low", fire("bs1", "tf = 15 and low < swing_low", "new_candle_low", "tf", "short", "swing_low", qualify=once(*CUR)))
def _(t):
    return show(tr.new_candle_extreme(inputs(t), 15).where("direction = 'short'"))


@query("trigger_break_recent_high", fires(*[
    fire("bs5", f"tf = {tf} and prev_close <= swing_high and close > swing_high", "break_recent_high", "tf", "long", "swing_high", qualify=once(*CUR)) for tf in (1, 5)]))
def _(t):
    i = inputs(t)
    return show(tr.both(tr.break_recent(i, 1), tr.break_recent(i, 5)).where("direction = 'long'"))


@query("trigger_break_recent_low", fire("bs5", "tf = 5 and prev_close >= swing_low and close < swing_low", "break_recent_low", "tf", "short", "swing_low", qualify=once(*CUR)))
def _(t):
    return show(tr.break_recent(inputs(t), 5).where("direction = 'short'"))


CTES["near5"] = """select b.*, a.y as atr from bs5 b left join c5atr20 a on a.symbol = b.symbol and a.cpos = b.cbefore where b.tf = 5"""


@query("trigger_near_last_high", fire(edge_src("near5", "case when atr > 0 and swing_high is not null then swing_high - close > 0 and swing_high - close < atr and high <= swing_high end"), "true", "near_last_high", "5", "long", "swing_high - close"))
def _(t):
    return show(tr.near_last(inputs(t), 5).where("direction = 'long'"))


@query("trigger_near_last_low", fire(edge_src("near5", "case when atr > 0 and swing_low is not null then close - swing_low > 0 and close - swing_low < atr and low >= swing_low end"), "true", "near_last_low", "5", "short", "close - swing_low"))
def _(t):
    return show(tr.near_last(inputs(t), 5).where("direction = 'short'"))


CTES["orbb"] = """select s.*, c.tf, c.high as or_high, c.low as or_low from state s join candles c on c.symbol = s.symbol and c.day = s.day
 and c.covered and c.session = 'rth' and c.slot = 0 and s.session = 'rth' and s.et_min >= 570 + c.tf"""


@query("trigger_orb_breakout", fires(*[fire("orbb", f"tf = {tf} and prev_close <= or_high and close > or_high", "orb_breakout", "tf", "long", "or_high", qualify=once("tf")) for tf in (5, 15)]))
def _(t):
    i = inputs(t)
    return show(tr.both(tr.opening_range_break(i, 5), tr.opening_range_break(i, 15)).where("direction = 'long'"))


@query("trigger_orb_breakdown", fire("orbb", "tf = 5 and prev_close >= or_low and close < or_low", "orb_breakdown", "tf", "short", "or_low", qualify=once("tf")))
def _(t):
    return show(tr.opening_range_break(inputs(t), 5).where("direction = 'short'"))


CTES["rc"] = "select * from candles where rpos is not null"
for _tf, _p in ((1, 3), (1, 9), (2, 20), (5, 9), (5, 21), (15, 9), (15, 21), (60, 9), (60, 21)):
    CTES[f"rc{_tf}"] = f"select * from rc where tf = {_tf}"
    add_smooth(f"re{_tf}x{_p}", f"rc{_tf}", "symbol, series", "close", _p, pos="rpos")
CTES["bte"] = """select c.symbol, c.series, c.rpos, e.y as ema, count(e.y) over w = 5 and bool_and(low > e.y * (1 + 0.002)) over w as above,
 count(e.y) over w = 5 and bool_and(high < e.y * (1 - 0.002)) over w as below from rc1 c left join re1x9 e
 on e.symbol = c.symbol and e.series = c.series and e.rpos = c.rpos
 window w as (partition by c.symbol, c.series order by c.rpos rows between 4 preceding and current row)"""
CTES["bteb"] = "select b.*, ema, above, below from bc b join bte e on e.symbol = b.symbol and e.series = b.series and e.rpos = b.rbefore where b.tf = 1"


@query("trigger_back_to_ema", fires(
    fire("bteb", "above and low <= ema and ema <= close", "back_to_ema", "'ema9_1'", "long", "ema", qualify=once(*CUR)),
    fire("bteb", "below and high >= ema and ema >= close", "back_to_ema", "'ema9_1'", "short", "ema", qualify=once(*CUR))))
def _(t):
    return show(tr.back_to_ema(inputs(t), 1, 9, 0.2))


CTES["ece"] = """select b.*, f.y as fast, s.y as slow from bc b left join re1x3 f on f.symbol = b.symbol and f.series = b.series and f.rpos = b.rbefore
 left join re1x9 s on s.symbol = b.symbol and s.series = b.series and s.rpos = b.rbefore where b.tf = 1"""


@query("trigger_ema_cross_ema", fires(
    fire(edge_src("ece", "fast > slow"), "true", "ema_cross_ema", "'up'", "long", "fast"),
    fire(edge_src("ece", "fast < slow"), "true", "ema_cross_ema", "'down'", "short", "fast")))
def _(t):
    return show(tr.ema_cross_ema(inputs(t)))


CTES["rbc"] = """select symbol, day, session, slot, max(high) over w as rhi, min(low) over w as rlo, avg(volume) over w / 5 as rvol5, count(*) over w as n
 from candles where covered and tf = 5 window w as (partition by symbol, day, session order by slot rows between 4 preceding and current row)"""
CTES["rbb"] = """select b.*, r.rhi, r.rlo, r.rvol5 from bc b left join rbc r on r.symbol = b.symbol and r.day = b.day and r.session = b.session and r.n = 5
 and r.slot = (select max(x.slot) from candles x where x.covered and x.tf = 5 and x.symbol = b.symbol and x.day = b.day and x.session = b.session and x.slot < b.slot)
 where b.tf = 5"""


def _rb(side, outside):
    return (f"case when rhi - rlo <= (rhi + rlo) / 2 * 1.9 and not ({outside}) then false "
            f"when rhi - rlo <= (rhi + rlo) / 2 * 1.9 and {outside} and rvol5 > 0 and volume >= rvol5 * 1.5 then true end")


@query("trigger_range_break", fires(
    fire(edge_src("rbb", _rb("up", "close > rhi")), "true", "range_break", "'up'", "long", "rhi"),
    fire(edge_src("rbb", _rb("down", "close < rlo")), "true", "range_break", "'down'", "short", "rlo")))
def _(t):
    return show(tr.range_break(inputs(t), width=190.0))


# ---- completed candles ----------------------------------------------------------------------------------------------------------

@query("trigger_bull_candle_close", fire("done", "tf in (1, 5, 15) and close > open", "bull_candle_close", "tf", "long", "close"))
def _(t):
    return show(tr.candle_close(inputs(t), 1, 5, 15).where("direction = 'long'"))


@query("trigger_bear_candle_close", fire("done", "tf in (1, 5, 15) and close < open", "bear_candle_close", "tf", "short", "close"))
def _(t):
    return show(tr.candle_close(inputs(t), 1, 5, 15).where("direction = 'short'"))


CTES["pair"] = """select * from (select * exclude (session), session as ksess, done_min as et_min, done_session as session, lag(open) over w as o1, lag(high) over w as h1, lag(low) over w as l1,
  lag(close) over w as c1, lag(high, 2) over w as h2, lag(low, 2) over w as l2 from candles where covered window w as (partition by symbol, day, tf, session order by slot))
 where et_min is not null and session = ksess"""
PAIRS = {
    "bull_engulfing": ("c1 < o1 and close > open and open <= c1 and close >= o1 and abs(close - open) > abs(c1 - o1)", "long", "close"),
    "bear_engulfing": ("c1 > o1 and close < open and open >= c1 and close <= o1 and abs(close - open) > abs(c1 - o1)", "short", "close"),
    "bull_harami": ("c1 < o1 and close > open and open >= c1 and close <= o1 and abs(close - open) < abs(c1 - o1)", "long", "close"),
    "bear_harami": ("c1 > o1 and close < open and open <= c1 and close >= o1 and abs(close - open) < abs(c1 - o1)", "short", "close"),
    "inside_bar": ("tf in (5, 15, 30, 60) and high < h1 and low > l1", "neutral", "high - low"),
    "double_inside_bar": ("tf in (5, 15, 30, 60) and high < h1 and low > l1 and h1 < h2 and l1 > l2", "neutral", "high - low"),
}


def _register_pair(name, cond, direction, value):
    @query(f"trigger_{name}", fire("pair", f"tf in (1, 5, 15) and {cond}", name, "tf", direction, value))
    def _(t):
        return show(tr.pair_patterns(inputs(t), 1, 5, 15).where(F.col("trigger") == name))


for _k, _v in PAIRS.items():
    _register_pair(_k, *_v)

SINGLES = {
    "doji": ("high > low and abs(close - open) / (high - low) * 100 <= 10", "neutral", "abs(close - open) / (high - low) * 100"),
    "upper_shadow": ("high > greatest(open, close) and (high - greatest(open, close)) / greatest(abs(close - open), 1e-9) >= 0.5", "short",
                     "(high - greatest(open, close)) / greatest(abs(close - open), 1e-9)"),
    "lower_shadow": ("least(open, close) > low and (least(open, close) - low) / greatest(abs(close - open), 1e-9) >= 0.5", "long",
                     "(least(open, close) - low) / greatest(abs(close - open), 1e-9)"),
}


def _register_single(name, cond, direction, value):
    @query(f"trigger_{name}", fire("done", f"tf in (5, 15) and {cond}", name, "tf", direction, value))
    def _(t):
        return show(tr.single_patterns(inputs(t), 5, 15, ratio=0.5).where(F.col("trigger") == name))


for _k, _v in SINGLES.items():
    _register_single(_k, *_v)

CTES["rej"] = """select *, case when n = 6 and g = 0 then h5 end as lvl_hi, case when n = 6 and g = 0 then l5 end as lvl_lo from (
 select *, max(high) over (w rows between 5 preceding and 1 preceding) as h5, min(low) over (w rows between 5 preceding and 1 preceding) as l5,
  count(*) over (w rows between 5 preceding and current row) as n, sum(gap) over (w rows between 4 preceding and current row) as g from cg
 window w as (partition by symbol, tf, series order by cpos)) where done_min is not null"""
CTES["rejd"] = "select * exclude (session), done_min as et_min, done_session as session from rej"


@query("trigger_reject_last_high", fire("rejd", "tf in (1, 5) and session = 'rth' and high >= lvl_hi and close < lvl_hi and close < open", "reject_last_high", "tf", "short", "lvl_hi"))
def _(t):
    return show(tr.reject_last(inputs(t), 1, 5).where("direction = 'short'"))


@query("trigger_reject_last_low", fire("rejd", "tf in (1, 5) and session = 'rth' and low <= lvl_lo and close > lvl_lo and close > open", "reject_last_low", "tf", "long", "lvl_lo"))
def _(t):
    return show(tr.reject_last(inputs(t), 1, 5).where("direction = 'long'"))


CTES["vsp"] = """select * exclude (session), done_min as et_min, done_session as session, volume / m as ratio from (
 select *, avg(volume) over (w rows between 10 preceding and 1 preceding) as m, count(*) over (w rows between 10 preceding and current row) as n,
  sum(gap) over (w rows between 9 preceding and current row) as g from cg window w as (partition by symbol, tf, series order by cpos))
 where n = 11 and g = 0 and m > 0 and done_min is not null"""


@query("trigger_volume_spike", fire("vsp", "tf in (1, 5) and ratio >= 1.5", "volume_spike", "tf", "neutral", "ratio"))
def _(t):
    return show(tr.volume_spike(inputs(t), 1, 5, ratio=1.5))


CTES["stk"] = """select *  exclude (session), done_min as et_min, done_session as session, case when session = done_session then streak else 0 end as run
 from streak where done_min is not null and tf = 5"""


@query("trigger_consec_candles", fires(
    fire(edge_src("stk", "run >= 3"), "true", "consec_candles", "'green'", "long", "3"),
    fire(edge_src("stk", "run <= -3"), "true", "consec_candles", "'red'", "short", "3")))
def _(t):
    return show(tr.consec_candles(streaks(co.covered(t.candles, 5))))


CTES["two"] = """select * exclude (session), done_min as et_min, done_session as session from (select *, lag(close) over w as pc, lag(vwap) over w as pv,
 lag(day) over w as pday from cg window w as (partition by symbol, tf, series order by cpos)) where gap = 0 and pday = day and done_min is not null"""
CTES["twolv"] = "select t.*, s.prior_close as lvl from two t join sb s on s.symbol = t.symbol and s.day = t.day and s.et_min = t.et_min"


@query("trigger_cross_above_candles", fires(
    fire("two", "tf in (3, 5) and pc <= pv and close > vwap", "cross_above", "'vwap'", "long", "vwap"),
    fire("twolv", "tf = 5 and pc <= lvl and close > lvl", "cross_above", "'prior_close'", "long", "lvl")))
def _(t):
    i = inputs(t)
    c = tr.both(tr.candle_level_cross(i, 3), tr.candle_level_cross(i, 5), tr.candle_level_cross(i, 5, "prior_close"))
    return show(c.where("direction = 'long'"))


@query("trigger_cross_below_candles", fire("two", "tf in (5, 15) and pc >= pv and close < vwap", "cross_below", "'vwap'", "short", "vwap"))
def _(t):
    i = inputs(t)
    return show(tr.both(tr.candle_level_cross(i, 5), tr.candle_level_cross(i, 15)).where("direction = 'short'"))


def _ema_join(a, tf, p):
    return f" left join (select * from bc where tf = {tf}) b{tf}{a} on b{tf}{a}.symbol = s.symbol and b{tf}{a}.day = s.day and b{tf}{a}.et_min = s.et_min"


CTES["lv"] = """select s.symbol, s.day, s.et_min, s.session, s.close, s.prev_close, s.session_open, s.prior_close, s.vwap, s.pm_high, s.pm_low, s.prior_high, s.prior_low,
 e20_2.y as ema20_2, e9_5.y as ema9_5, e21_5.y as ema21_5, e9_15.y as ema9_15, e21_15.y as ema21_15, e9_60.y as ema9_60, e21_60.y as ema21_60 from sb s
 left join bc b2 on b2.symbol = s.symbol and b2.day = s.day and b2.et_min = s.et_min and b2.tf = 2
 left join bc b5 on b5.symbol = s.symbol and b5.day = s.day and b5.et_min = s.et_min and b5.tf = 5
 left join bc b15 on b15.symbol = s.symbol and b15.day = s.day and b15.et_min = s.et_min and b15.tf = 15
 left join bc b60 on b60.symbol = s.symbol and b60.day = s.day and b60.et_min = s.et_min and b60.tf = 60
 left join re2x20 e20_2 on e20_2.symbol = s.symbol and e20_2.series = b2.series and e20_2.rpos = b2.rbefore
 left join re5x9 e9_5 on e9_5.symbol = s.symbol and e9_5.rpos = b5.rbefore left join re5x21 e21_5 on e21_5.symbol = s.symbol and e21_5.rpos = b5.rbefore
 left join re15x9 e9_15 on e9_15.symbol = s.symbol and e9_15.rpos = b15.rbefore left join re15x21 e21_15 on e21_15.symbol = s.symbol and e21_15.rpos = b15.rbefore
 left join re60x9 e9_60 on e9_60.symbol = s.symbol and e9_60.rpos = b60.rbefore left join re60x21 e21_60 on e21_60.symbol = s.symbol and e21_60.rpos = b60.rbefore"""
_LV = {"open": "session_open", "prior_close": "prior_close", "vwap": "vwap", "pm_high": "pm_high", "pm_low": "pm_low", "prior_high": "prior_high",
       "prior_low": "prior_low", **{n: n for n in tr.EMA_LEVELS}}
CTES["sdx"] = """select symbol, day, lag(e9.y) over w as ema9_d from sessions left join sema9 e9 using (symbol, pos) window w as (partition by symbol order by day)"""
add_smooth("sema9", "sessions", "symbol", "close", 9)
CTES["lvlong"] = " union all ".join(f"select symbol, day, et_min, session, close, prev_close, '{k}' as level, {v} as price from lv where {v} is not null"
                                    for k, v in _LV.items())


@query("levels_long_form", """select symbol, day, level, count(*) as n, round(avg(price), 6) as mean_price, round(max(price), 6) as max_price
 from lvlong group by all""")
def _(t):
    x = tr.level_long(tr.with_ema_levels(inputs(t))).groupBy("symbol", "et_date", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean_price"), F.max("price").alias("max_price"))
    return out(x, "symbol day level n", "mean_price max_price")


@query("trigger_cross_above", fire("lvlong", "prev_close <= price and close > price", "cross_above", "level", "long", "price", "1"))
def _(t):
    return show(tr.level_cross(tr.with_ema_levels(inputs(t))).where("direction = 'long'"))


@query("trigger_cross_below", fire("lvlong", "prev_close >= price and close < price", "cross_below", "level", "short", "price", "1"))
def _(t):
    return show(tr.level_cross(tr.with_ema_levels(inputs(t))).where("direction = 'short'"))


CTES["v3"] = """select * exclude (session), done_min as et_min, done_session as session from (select *, close - vwap as d0, lag(close - vwap) over w as d1,
 lag(close - vwap, 2) over w as d2, lag(slot, 2) over w as s2 from candles where covered and tf in (1, 3, 5)
 window w as (partition by symbol, day, tf, session order by slot)) where session = done_session and session = 'rth' and s2 = slot - 2"""


@query("trigger_vwap_cross_confirmed", fires(
    fire("v3", "d2 <= 0 and d1 > 0 and d0 > 0", "vwap_cross_confirmed", "'above'", "long", "vwap"),
    fire("v3", "d2 >= 0 and d1 < 0 and d0 < 0", "vwap_cross_confirmed", "'below'", "short", "vwap")))
def _(t):
    return show(tr.vwap_cross_confirmed(inputs(t), 1, 3, 5))


CTES["vt"] = """select t.*, atr_d1 * 0.03 as tol from (select * exclude (session), done_min as et_min, done_session as session from (
 select *, lag(close) over w as pc, lag(vwap) over w as pv, lag(1) over w as has from cg window w as (partition by symbol, tf, series order by cpos))
 where gap = 0 and has = 1 and done_session = 'rth') t join (select symbol, day, atr_d1 from ctx) c on c.symbol = t.symbol and c.day = t.day
 where atr_d1 > 0 and tf in (1, 3, 5)"""


@query("trigger_vwap_support", fire("vt", "pc > pv and low between vwap - tol and vwap + tol and close > vwap and close > open", "vwap_support", "tf", "long", "vwap"))
def _(t):
    return show(tr.vwap_hold_touch(inputs(t), 1, 3, 5).where("direction = 'long'"))


@query("trigger_vwap_resistance", fire("vt", "pc < pv and high between vwap - tol and vwap + tol and close < vwap and close < open", "vwap_resistance", "tf", "short", "vwap"))
def _(t):
    return show(tr.vwap_hold_touch(inputs(t), 1, 3, 5).where("direction = 'short'"))


CTES["vv"] = """select * exclude (session), done_min as et_min, done_session as session from (select c.*, x.atr_d1 as atr,
 max(close - vwap) over p as fu, max(vwap - close) over p as fd, sum(case when abs(close - vwap) <= 0.3 * x.atr_d1 then 1 else 0 end) over p as nr,
 count(vwap) over (partition by c.symbol, c.day, c.tf, c.session order by slot rows between 5 preceding and current row) as n
 from candles c join ctx x on x.symbol = c.symbol and x.day = c.day where covered and tf = 5
 window p as (partition by c.symbol, c.day, c.tf, c.session order by slot rows between 5 preceding and 1 preceding))
 where session = done_session and n = 6 and atr > 0 and nr <= 3 and high > low"""


@query("trigger_vwap_v", fires(
    fire("vv", "fu >= 0.3 * atr and low <= vwap + 0.3 * atr and close >= vwap + 0.3 * atr and close > open and close - low >= 0.6 * (high - low)", "vwap_v", "'support'", "long", "vwap"),
    fire("vv", "fd >= 0.3 * atr and high >= vwap - 0.3 * atr and close <= vwap - 0.3 * atr and close < open and high - close >= 0.6 * (high - low)", "vwap_v", "'resistance'", "short", "vwap")))
def _(t):
    return show(tr.vwap_v(inputs(t), band=0.3, dwell=3))


# ---- study crosses ------------------------------------------------------------------------------------------------------------------

CTES["c5x"] = """select c.*, lag(close) over (partition by symbol order by cpos) as pc, high - lag(high) over (partition by symbol order by cpos) as up,
 lag(low) over (partition by symbol order by cpos) - low as dn from c5 c"""
CTES["c5gl"] = """select symbol, cpos, greatest(close - pc, 0) as g, greatest(pc - close, 0) as l, greatest(high - low, abs(high - pc), abs(low - pc)) as tr,
 case when up > dn and up > 0 then up else 0 end as pu, case when dn > up and dn > 0 then dn else 0 end as pd from c5x where cpos >= 2"""
for _c in ("g", "l", "tr", "pu", "pd"):
    add_smooth(f"c5s_{_c}", "c5gl", "symbol", _c, 14, wilder=True, start=2, pos="cpos")
CTES["c5rsi"] = "select symbol, cpos, g.y * 100 / nullif(g.y + l.y, 0) as v from c5s_g g join c5s_l l using (symbol, cpos)"
CTES["c5di"] = """select symbol, cpos, p.y / a.y * 100 as plus_di, m.y / a.y * 100 as minus_di,
 coalesce(abs(p.y - m.y) / nullif(p.y + m.y, 0) * 100, 0) as dx
 from c5s_tr a join c5s_pu p using (symbol, cpos) join c5s_pd m using (symbol, cpos)"""
add_smooth("c5adxr", "c5di", "symbol", "dx", 14, wilder=True, start=15, pos="cpos")
CTES["c5adx"] = "select symbol, cpos, y as v from c5adxr"
for _n in (12, 26):
    add_smooth(f"c5e{_n}", "c5", "symbol", "close", _n, pos="cpos")
CTES["c5macd"] = "select symbol, cpos, a.y - b.y as m from c5e12 a join c5e26 b using (symbol, cpos)"
add_smooth("c5sig", "c5macd", "symbol", "m", 9, start=26, pos="cpos")
CTES["c5hist"] = "select symbol, cpos, m, y as sig, m - y as v from c5macd join c5sig using (symbol, cpos)"
CTES["c5cci"] = """select symbol, cpos, (tp - m) / nullif(0.015::double * list_avg(list_transform(lst, lambda x: abs(x - m))), 0) as v from (
 select symbol, cpos, tp, count(*) over w as n, avg(tp) over w as m, list(tp) over w as lst from (select *, (high + low + close) / 3 as tp from c5)
 window w as (partition by symbol order by cpos rows between 13 preceding and current row)) where n = 14"""
CTES["c5st"] = """select symbol, cpos, k as v, case when count(k) over w = 3 then avg(k) over w end as d from (
 select symbol, cpos, case when count(fk) over w = 3 then avg(fk) over w end as k from (select symbol, cpos,
  case when count(*) over w = 14 then (close - min(low) over w) * 100 / nullif(max(high) over w - min(low) over w, 0) end as fk from c5
  window w as (partition by symbol order by cpos rows between 13 preceding and current row))
 window w as (partition by symbol order by cpos rows between 2 preceding and current row))
 window w as (partition by symbol order by cpos rows between 2 preceding and current row)"""
CTES["c5bb"] = """select symbol, cpos, m, sd, (close - (m - 2 * sd)) / nullif((m + 2 * sd) - (m - 2 * sd), 0) as v from (select symbol, cpos, close, count(*) over w as n,
 avg(close) over w as m, stddev_pop(close) over w as sd from c5 window w as (partition by symbol order by cpos rows between 19 preceding and current row)) where n = 20"""
_STUDY_SQL = {"ta_macd_hist_cross": ("c5hist", 0), "ta_rsi_cross": ("c5rsi", 50), "ta_stoch_k_cross": ("c5st", 50), "ta_cci_cross": ("c5cci", 100),
              "ta_bb_percent_b_cross": ("c5bb", 0.9), "ta_adx_cross": ("c5adx", 95)}
_STUDY = {"ta_macd_hist_cross": ind.macd, "ta_rsi_cross": ind.rsi, "ta_stoch_k_cross": ind.stoch, "ta_cci_cross": ind.cci,
          "ta_bb_percent_b_cross": ind.bbands, "ta_adx_cross": ind.adx}


def _register_study(name, cte, level):
    src = f"""(select d.*, v, lag(v) over (partition by d.symbol order by d.cpos) as b from (select * exclude (session), done_min as et_min, done_session as session from c5) d
     left join {cte} x on x.symbol = d.symbol and x.cpos = d.cpos)"""
    live = "done_min is not null and session = 'rth'"

    @query(f"trigger_{name}", fires(fire(src, f"{live} and b <= {level} and v > {level}", name, "'up'", "long", "v"),
                                    fire(src, f"{live} and b >= {level} and v < {level}", name, "'down'", "short", "v")))
    def _(t):
        return show(tr.study_cross(_STUDY[name](co.covered(t.candles, 5), co.SERIES, "cpos"), name, float(level)))


for _k, (_cte, _lvl) in _STUDY_SQL.items():
    _register_study(_k, _cte, _lvl)


# ---- folds: rows only here, compared with a plain model in the tests ----------------------------------------------------------------

@query("trigger_failed_swing_high")
def _(t):
    return show(tr.failed_swing(inputs(t), 1, lookback=5).where("direction = 'short'"))


@query("trigger_failed_swing_low")
def _(t):
    return show(tr.failed_swing(inputs(t), 1, lookback=5).where("direction = 'long'"))


@query("trigger_system_setup", fires(
    fire("sb", "session = 'rth' and high > prev_day_high and volume >= 4000", "setup:ext", "''", "long", "null", "1"),
    fire("state", "session = 'rth' and high > prev_day_high", "hod", "'high'", "long", "high", "1"),
    fire("state", "session = 'rth' and low < prev_day_low", "hod", "'low'", "short", "low", "1")))
def _(t):
    i = inputs(t)
    ext = tr.fires(tr.in_sessions(i.bars, "rth"), (F.col("high") > F.col("prev_day_high")) & (F.col("volume") >= 4000),
                   "setup:ext", "", "long", F.lit(None), 1)
    return show(tr.external_fires(ext, [tr.new_extreme(i)]))

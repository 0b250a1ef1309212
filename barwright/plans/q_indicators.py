"""Indicators on daily bars and on completed candles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import segments
from ..operators import candles as co
from ..operators import daily as dl
from ..operators import indicators as ind
from ..operators import relative as rel
from ..operators.catalog import streaks
from ..operators import state as st
from .registry import CTES, add_smooth, out, query, r6

SYM = ["symbol"]
SERIES = co.SERIES

# ---- daily recurrences in SQL -----------------------------------------------------------------------------------------
CTES["dtr"] = """select *, greatest(high - low, abs(high - pc), abs(low - pc)) as tr from
 (select *, lag(close) over (partition by symbol order by pos) as pc from dpos)"""
for _n in (8, 9, 12, 21, 26, 50):
    add_smooth(f"dema{_n}", "dpos", "symbol", "close", _n)
for _n in (5, 14):
    add_smooth(f"datr{_n}", "dtr_valid", "symbol", "tr", _n, wilder=True, start=2)
CTES["dtr_valid"] = "select * from dtr where pos >= 2"


def _day(df):
    return df.withColumn("d", F.col("d").cast("string"))


@query("indicator_sma", """select symbol, d::varchar as d, round(case when count(*) over w >= 50 then avg(close) over w end, 6) as sma
 from dpos window w as (partition by symbol order by pos rows between 49 preceding and current row)""")
def _(t):
    return out(_day(ind.sma(dl.with_pos(t.daily, "d"), SYM, "pos", 50)), "symbol d", "sma")


@query("indicator_ema", """select symbol, d::varchar as d, round(e9.y, 6) as ema9, round(e21.y, 6) as ema21
 from dpos left join dema9 e9 using (symbol, pos) left join dema21 e21 using (symbol, pos)""")
def _(t):
    return out(_day(ind.ema(dl.with_pos(t.daily, "d"), SYM, "pos", {"ema9": 9, "ema21": 21})), "symbol d", "ema9 ema21")


@query("indicator_ema_tracker", """select symbol, pos, round(y, 6) as ema, round(lag(y) over (partition by symbol order by pos), 6)
 as ema_prev from dema9""")
def _(t):
    e = ind.ema(dl.with_pos(t.daily, "d"), SYM, "pos", {"ema": 9})
    from ..functions.ordered import previous
    return out(previous(e, SYM, "pos", {"ema_prev": "ema"}).where("ema is not null"), "symbol pos", "ema ema_prev")


@query("indicator_atr", """select symbol, d::varchar as d, round(a5.y, 6) as atr5, round(a14.y, 6) as atr14
 from dpos left join datr5 a5 using (symbol, pos) left join datr14 a14 using (symbol, pos)""")
def _(t):
    return out(_day(ind.atr(dl.with_pos(t.daily, "d"), SYM, "pos", {"atr5": 5, "atr14": 14})), "symbol d", "atr5 atr14")


CTES["ddm"] = """select symbol, pos, d, tr, case when up > dn and up > 0 then up else 0 end as pu,
 case when dn > up and dn > 0 then dn else 0 end as pd from (
 select *, high - lag(high) over w as up, lag(low) over w - low as dn from dtr window w as (partition by symbol order by pos))
 where pos >= 2"""
for _c in ("tr", "pu", "pd"):
    add_smooth(f"dadx_{_c}", "ddm", "symbol", _c, 14, wilder=True, start=2)
CTES["ddi"] = """select symbol, pos, p.y / a.y * 100 as plus_di, m.y / a.y * 100 as minus_di,
 coalesce(abs(p.y / a.y * 100 - m.y / a.y * 100) / nullif(p.y / a.y * 100 + m.y / a.y * 100, 0) * 100, 0) as dx
 from dadx_tr a join dadx_pu p using (symbol, pos) join dadx_pd m using (symbol, pos)"""
add_smooth("dadx", "ddi", "symbol", "dx", 14, wilder=True, start=15)


@query("indicator_adx", """select symbol, d::varchar as d, round(y, 6) as adx, round(plus_di, 6) as plus_di,
 round(minus_di, 6) as minus_di from dpos left join ddi using (symbol, pos) left join dadx using (symbol, pos)""")
def _(t):
    return out(_day(ind.adx(dl.with_pos(t.daily, "d"), SYM, "pos", 14)), "symbol d", "adx plus_di minus_di")


CTES["dgl"] = """select symbol, pos, greatest(close - pc, 0) as g, greatest(pc - close, 0) as l from dtr where pos >= 2"""
for _c in ("g", "l"):
    add_smooth(f"drsi_{_c}", "dgl", "symbol", _c, 14, wilder=True, start=2)


@query("indicator_rsi", """select symbol, d::varchar as d, round(g.y * 100 / nullif(g.y + l.y, 0), 6) as rsi
 from dpos left join drsi_g g using (symbol, pos) left join drsi_l l using (symbol, pos)""")
def _(t):
    return out(_day(ind.rsi(dl.with_pos(t.daily, "d"), SYM, "pos", 14)), "symbol d", "rsi")


@query("indicator_cci", """select symbol, d::varchar as d, round(case when n = 14 then (tp - m) / nullif(0.015::double * mad, 0) end, 6)
 as cci from (select *, list_avg(list_transform(lst, lambda x: abs(x - m))) as mad from (
  select symbol, d, tp, count(*) over w as n, avg(tp) over w as m, list(tp) over w as lst from
   (select *, (high + low + close) / 3 as tp from dpos)
  window w as (partition by symbol order by pos rows between 13 preceding and current row)))""")
def _(t):
    return out(_day(ind.cci(dl.with_pos(t.daily, "d"), SYM, "pos", 14)), "symbol d", "cci")


@query("indicator_obv", """select symbol, d::varchar as d, sum(case when pc is null then volume else sign(close - pc) * volume end)
 over (partition by symbol order by pos rows unbounded preceding) as obv from dtr""")
def _(t):
    return out(_day(ind.obv(dl.with_pos(t.daily, "d"), SYM, "pos")), "symbol d obv")


CTES["dmacd"] = "select symbol, pos, a.y - b.y as m from dema12 a join dema26 b using (symbol, pos)"
add_smooth("dmacd_sig", "dmacd", "symbol", "m", 9, start=26)


@query("indicator_macd", """select symbol, d::varchar as d, round(m, 6) as macd, round(y, 6) as macd_signal,
 round(m - y, 6) as macd_hist from dpos left join dmacd using (symbol, pos) left join dmacd_sig using (symbol, pos)""")
def _(t):
    return out(_day(ind.macd(dl.with_pos(t.daily, "d"), SYM, "pos")), "symbol d", "macd macd_signal macd_hist")


CTES["dstoch"] = """select symbol, d, pos, k, case when count(k) over w = 3 then avg(k) over w end as dd from (
 select symbol, d, pos, case when count(fk) over w = 3 then avg(fk) over w end as k from (
  select symbol, d, pos, case when count(*) over w = 14 then (close - min(low) over w) * 100
   / nullif(max(high) over w - min(low) over w, 0) end as fk from dpos
  window w as (partition by symbol order by pos rows between 13 preceding and current row))
 window w as (partition by symbol order by pos rows between 2 preceding and current row))
 window w as (partition by symbol order by pos rows between 2 preceding and current row)"""


@query("indicator_stochastic", """select symbol, d::varchar as d, round(k, 6) as stoch_k, round(dd, 6) as stoch_d from dstoch""")
def _(t):
    return out(_day(ind.stoch(dl.with_pos(t.daily, "d"), SYM, "pos")), "symbol d", "stoch_k stoch_d")


CTES["dbb"] = """select symbol, d, pos, close, case when count(*) over w = 20 then avg(close) over w end as m,
 case when count(*) over w = 20 then stddev_pop(close) over w end as sd from dpos
 window w as (partition by symbol order by pos rows between 19 preceding and current row)"""


@query("indicator_bollinger", """select symbol, d::varchar as d, round(m - 2 * sd, 4) as bb_lower, round(m, 4) as bb_middle,
 round(m + 2 * sd, 4) as bb_upper, round(((m + 2 * sd) - (m - 2 * sd)) * 100 / m, 4) as bb_width,
 round((close - (m - 2 * sd)) / nullif((m + 2 * sd) - (m - 2 * sd), 0), 4) as bb_percent_b from dbb""")
def _(t):
    return out(_day(ind.bbands(dl.with_pos(t.daily, "d"), SYM, "pos")), "symbol d",
               "bb_lower bb_middle bb_upper bb_width bb_percent_b", 4)


CTES["dsegin"] = """select *, case when day(d) % 9 <> 0 then high end as h from dpos"""
CTES["dseg"] = """select *, row_number() over (partition by symbol, seg order by d) as sp from (
 select *, sum(case when h is null then 1 else 0 end) over (partition by symbol order by d)::bigint as seg from dsegin) where h is not null"""
CTES["dsegtr"] = """select * from (select symbol, seg, sp as pos, d, greatest(h - low, abs(h - pc), abs(low - pc)) as tr from (
 select *, lag(close) over (partition by symbol, seg order by sp) as pc from dseg)) where pos >= 2"""
add_smooth("dsegatr", "dsegtr", "symbol, seg", "tr", 3, wilder=True, start=2)


@query("indicator_segment_restart", """select a.symbol, a.d::varchar as d, a.seg, a.sp as pos, round(y, 6) as atr from dseg a
 left join dsegatr b on a.symbol = b.symbol and a.seg = b.seg and a.sp = b.pos""")
def _(t):
    holes = t.daily.withColumn("high", F.when(F.dayofmonth("d") % 9 != 0, F.col("high"))).withColumn("y", F.year("d"))
    s = segments(holes, SYM, ["y"], ["d"], ["high", "low", "close"])
    return out(_day(ind.atr(s, ["symbol", "seg"], "pos", {"atr": 3})), "symbol d seg pos", "atr")


# ---- relative strength against the benchmark ----------------------------------------------------------------------------
CTES["rrsin"] = """select a.symbol, a.d, a.high, a.low, a.close, b.high as bh, b.low as bl, b.close as bc,
 row_number() over (partition by a.symbol order by a.d) as pos from daily a join daily b on a.d = b.d and b.symbol = 'S000'
 where a.symbol <> 'S000'"""
CTES["rrstr"] = """select *, greatest(high - low, abs(high - pc), abs(low - pc)) as ts, greatest(bh - bl, abs(bh - pb), abs(bl - pb)) as tb
 from (select *, lag(close) over w as pc, lag(bc) over w as pb, close - lag(close, 5) over w as ms, bc - lag(bc, 5) over w as mb
 from rrsin window w as (partition by symbol order by pos)) where pos >= 2"""
add_smooth("rrs_as", "rrstr", "symbol", "ts", 5, wilder=True, start=2)
add_smooth("rrs_ab", "rrstr", "symbol", "tb", 5, wilder=True, start=2)
CTES["rrs_raw"] = """select i.symbol, i.d, i.pos, (ms - mb / nullif(b.y, 0) * a.y) / nullif(a.y, 0) as raw from rrsin i
 left join rrstr t using (symbol, pos) left join rrs_as a using (symbol, pos) left join rrs_ab b using (symbol, pos)"""


def aligned(daily):
    """Stock rows inner-joined with the benchmark of the same day."""
    b = daily.where("symbol = 'S000'").select("d", *[F.col(c).alias(f"bench_{c}") for c in ("high", "low", "close")])
    return dl.with_pos(daily.where("symbol <> 'S000'").join(b, "d"), "d")


@query("rrs_daily_raw", "select symbol, d::varchar as d, round(raw, 6) as rrs_raw from rrs_raw")
def _(t):
    return out(_day(ind.rrs(aligned(t.daily), SYM, "pos", 5)), "symbol d", "rrs_raw")


@query("rrs_daily_smoothed", """select symbol, d::varchar as d, round(case when count(raw) over w = 5 then avg(raw) over w end, 6)
 as rrs_d1 from rrs_raw window w as (partition by symbol order by pos rows between 4 preceding and current row)""")
def _(t):
    r = ind.rrs(aligned(t.daily), SYM, "pos", 5)
    return out(_day(ind.sma(r, SYM, "pos", 5, "rrs_raw", "rrs_d1")), "symbol d", "rrs_d1")


CTES["m5in"] = """select symbol, day, slot, high, low, close, bh, bl, bc, row_number() over (partition by symbol, day order by slot)
 as pos from (select a.*, b.high as bh, b.low as bl, b.close as bc from candles a join candles b on a.day = b.day and a.tf = b.tf
 and a.slot = b.slot and a.session = b.session where a.tf = 5 and a.session = 'rth' and a.covered and b.covered and b.symbol = 'S00'
 and a.symbol <> 'S00')"""
CTES["m5tr"] = """select *, greatest(high - low, abs(high - pc), abs(low - pc)) as ts, greatest(bh - bl, abs(bh - pb), abs(bl - pb)) as tb
 from (select *, lag(close) over w as pc, lag(bc) over w as pb, close - lag(close, 12) over w as ms, bc - lag(bc, 12) over w as mb
 from m5in window w as (partition by symbol, day order by pos)) where pos >= 2"""
add_smooth("m5_as", "m5tr", "symbol, day", "ts", 12, wilder=True, start=2)
add_smooth("m5_ab", "m5tr", "symbol, day", "tb", 12, wilder=True, start=2)
CTES["m5raw"] = """select i.symbol, i.day, i.slot, i.pos, (ms - mb / nullif(b.y, 0) * a.y) / nullif(a.y, 0) as raw from m5in i
 join m5tr t using (symbol, day, pos) join m5_as a using (symbol, day, pos) join m5_ab b using (symbol, day, pos)"""


def rrs_m5(candles, bench: str):
    """Raw 5-minute RRS(12) inside each session against the candles of one benchmark symbol."""
    return rel.rrs_intraday(candles, bench)


@query("rrs_five_minute", "select symbol, day, slot, round(raw, 6) as rrs_m5 from m5raw")
def _(t):
    return out(rrs_m5(t.candles, "S00").where("rrs_m5 is not null"), "symbol day slot", "rrs_m5")


@query("rrs_five_minute_slope", """select symbol, day, slot, round(raw - lag(raw, 3) over (partition by symbol, day order by pos), 6)
 as rrs_slope from m5raw""")
def _(t):
    from pyspark.sql import Window
    r = rrs_m5(t.candles, "S00").where("rrs_m5 is not null")
    w = Window.partitionBy("symbol", "et_date").orderBy("pos")
    return out(r.withColumn("rrs_slope", F.col("rrs_m5") - F.lag("rrs_m5", 3).over(w)), "symbol day slot", "rrs_slope")


# ---- volume pace ------------------------------------------------------------------------------------------------------
CTES["five"] = """select f.*, s.pos from (select symbol, day, cast(floor(et_min / 5) * 5 - 570 as int) as slot, sum(volume) as v from bars where et_min between 570 and 959 group by all) f
 join sessions s using (symbol, day)"""
CTES["profile"] = """select s.symbol, s.day, g.slot, avg(f.v) as mv from sessions s cross join (select unnest(range(0, 390, 5))::int as slot) g
 left join five f on f.symbol = s.symbol and f.slot = g.slot and f.pos between s.pos - 20 and s.pos - 1 group by all"""
CTES["psum"] = """select symbol, day, slot, coalesce(mv, 0) as mv, coalesce(sum(mv) over (partition by symbol, day order by slot rows between unbounded preceding and 1 preceding), 0) as upto,
 sum(mv) over (partition by symbol, day) as whole from profile"""
CTES["rvol"] = """select s.symbol, s.day, s.et_min, case when e > 0 then cum_volume / e end as rvol from (select s.*, case when et_min >= 959 then whole else upto + mv * ((et_min - 569) % 5) / 5 end as e
  from state s left join psum p on p.symbol = s.symbol and p.day = s.day and p.slot = least(floor((s.et_min - 569) / 5) * 5, 385) where session = 'rth') s"""


@query("rvol_time_of_day", "select symbol, day, et_min, round(rvol, 6) as rvol from rvol")
def _(t):
    return out(st.rvol(t.state, t.profile).where("session = 'rth'"), "symbol day et_min", "rvol")


CTES["opening"] = """select c.symbol, c.day, case when close > open then 1.0 when close < open then -1.0 else 0.0 end::double as dir,
 volume / nullif(mv, 0) as orv from candles c left join profile p on p.symbol = c.symbol and p.day = c.day and p.slot = 0
 where tf = 5 and session = 'rth' and c.slot = 0 and covered"""


def opening_five(t):
    return rel.opening_candle(t.candles, t.profile)


def opening_ranks(t):
    return rel.opening_ranks(t.sessions, opening_five(t))


@query("opening_five_minutes", "select symbol, day, dir as opening_direction, round(orv, 6) as opening_rvol from opening")
def _(t):
    return out(opening_five(t), "symbol day opening_direction", "opening_rvol")


CTES["openrank"] = """select symbol, day, orv, case when orv is not null then rank() over (partition by day order by orv desc nulls last)
 end::double as opening_rank, count(orv) over (partition by day) / count(*) over (partition by day)::double as coverage
 from (select symbol, day from sessions) left join opening using (symbol, day)"""


@query("opening_rvol_rank", """select symbol, day, opening_rank, round(orv, 6) as opening_rvol, round(coverage, 6) as coverage
 from openrank""")
def _(t):
    return out(opening_ranks(t), "symbol day opening_rank", "opening_rvol coverage")


@query("chart_quality", """select symbol, d::varchar as d, chart_quality from dquality""")
def _(t):
    q = dl.daily_indicators(t.daily, "d")
    return _day(q).select("symbol", "d", "chart_quality")


CTES["dquality"] = """select d.symbol, d.d, case when n20 < 20 then 50.0::double else round(least(100.0::double, greatest(0.0::double,
  br * 100 * 0.5::double + greatest(0.0::double, (1 - coalesce(abs(close - e.y) / nullif(a.y, 0), 0) / 4.0::double) * 100) * 0.5::double)), 1) end as chart_quality
 from (select *, avg(abs(close - open) / nullif(high - low, 0)) over w as br, count(*) over w as n20 from dpos
       window w as (partition by symbol order by pos rows between 19 preceding and current row)) d
 left join dema8 e using (symbol, pos) left join datr5 a using (symbol, pos)"""


@query("candle_relative_volume", """select symbol, day, tf, slot, round(volume / nullif(m, 0), 6) as ratio from (
 select *, avg(volume) over (w rows between 10 preceding and 1 preceding) as m, count(*) over (w rows between 10 preceding and current row) as n,
  coalesce(sum(gap) over (w rows between 9 preceding and current row), 0) as g from (
  select *, case when day = lag(day) over w and session = lag(session) over w and slot <> lag(slot) over w + 1 then 1 else 0 end as gap
  from candles where covered and tf in (1, 5) window w as (partition by symbol, tf, series order by cpos))
 window w as (partition by symbol, tf, series order by cpos)) where n = 11 and g = 0""")
def _(t):
    return out(rel.candle_rel_volume(co.covered(t.candles, 1, 5), 10).where("ratio is not null"), "symbol day tf slot", "ratio")


@query("rolling_relative_volume", """select symbol, day, et_min, tf, round(cur / nullif(prior / 10, 0), 6) as ratio from (
 select symbol, day, et_min, 2 as tf, sum(volume) over (w rows between 1 preceding and current row) as cur,
  sum(volume) over (w rows between 21 preceding and 2 preceding) as prior, count(*) over (w rows between 21 preceding and current row) as n
 from bars window w as (partition by symbol, day, session order by et_min)
 union all select symbol, day, et_min, 5 as tf, sum(volume) over (w rows between 4 preceding and current row) as cur,
  sum(volume) over (w rows between 54 preceding and 5 preceding) as prior, count(*) over (w rows between 54 preceding and current row) as n
 from bars window w as (partition by symbol, day, session order by et_min)) where n = tf * 11""")
def _(t):
    both = [rel.rolling_rel_volume(t.bars, tf, 10).where("ratio is not null").withColumn("tf", F.lit(tf)) for tf in (2, 5)]
    return out(both[0].unionByName(both[1]), "symbol day et_min tf", "ratio")


CTES["streak"] = """select * exclude (sg, isl), cast(row_number() over (partition by symbol, day, tf, session, isl order by slot) * sg as int)
 as streak from (select *, sum(case when sg = psg and slot = pslot + 1 then 0 else 1 end) over
 (partition by symbol, day, tf, session order by slot) as isl from (
 select *, sign(close - open) as sg, lag(sign(close - open)) over w as psg, lag(slot) over w as pslot from candles where covered
 window w as (partition by symbol, day, tf, session order by slot)))"""


@query("candle_colour_streak", "select symbol, day, tf, session as key_session, slot, streak from streak")
def _(t):
    return out(streaks(co.covered(t.candles)), "symbol day tf key_session slot streak")


@query("n_day_extremes", """select symbol, d::varchar as d, case when count(*) over a = 60 then max(high) over a end as n_day_high,
 case when count(*) over a = 60 then min(low) over a end as n_day_low, max(high) over b as hi_52w, min(low) over b as lo_52w
 from dpos window a as (partition by symbol order by pos rows between 59 preceding and current row),
 b as (partition by symbol order by pos rows between 251 preceding and current row)""")
def _(t):
    d = dl.n_day_extremes(dl.daily_indicators(t.daily, "d"), 60)
    return _day(d).select("symbol", "d", "n_day_high", "n_day_low", "hi_52w", "lo_52w")


CTES["cg"] = """select *, case when day = lag(day) over w and session = lag(session) over w and slot <> lag(slot) over w + 1 then 1 else 0 end
 as gap from candles where covered window w as (partition by symbol, tf, series order by cpos)"""


def swing_cte(n: int) -> str:
    g = " and g = 0" if n > 1 else ""
    return f"""select *, case when cn = {n}{g} then sh end as swing_high, case when cn = {n}{g} then sl end as swing_low from (
 select *, max(high) over a as sh, min(low) over a as sl, count(*) over a as cn, coalesce(sum(gap) over b, 0) as g from cg
 window a as (partition by symbol, tf, series order by cpos rows between {n - 1} preceding and current row),
 b as (partition by symbol, tf, series order by cpos rows between {max(n - 2, 0)} preceding and current row))"""


CTES["swing5"] = swing_cte(5)


def swings(covered, n: int):
    def cols(w):
        ok, b = co.last_n_ok(w, n), w.rowsBetween(-(n - 1), 0)
        return {"swing_high": F.when(ok, F.max("high").over(b)), "swing_low": F.when(ok, F.min("low").over(b))}
    return co.recent(covered, max(n - 1, 1), cols)


@query("candle_swings", "select symbol, day, tf, slot, swing_high, swing_low from swing5 where swing_high is not null")
def _(t):
    return out(swings(co.covered(t.candles), 5).where("swing_high is not null"), "symbol day tf slot swing_high swing_low")


@query("daily_indicator_set", f"""select symbol, d::varchar as d, {r6('ema8_d ema9_d ema21_d ema50_d sma50_d sma100_d sma200_d atr_d1 atr14_d1 adv20')}
 from (select p.*, e8.y as ema8_d, e9.y as ema9_d, e21.y as ema21_d, e50.y as ema50_d, a5.y as atr_d1, a14.y as atr14_d1 from (
  select *, case when count(*) over w50 = 50 then avg(close) over w50 end as sma50_d,
   case when count(*) over w100 = 100 then avg(close) over w100 end as sma100_d,
   case when count(*) over w200 = 200 then avg(close) over w200 end as sma200_d, avg(volume) over w20 as adv20 from dpos
  window w20 as (partition by symbol order by pos rows between 19 preceding and current row),
   w50 as (partition by symbol order by pos rows between 49 preceding and current row),
   w100 as (partition by symbol order by pos rows between 99 preceding and current row),
   w200 as (partition by symbol order by pos rows between 199 preceding and current row)) p
  left join dema8 e8 using (symbol, pos) left join dema9 e9 using (symbol, pos) left join dema21 e21 using (symbol, pos)
  left join dema50 e50 using (symbol, pos) left join datr5 a5 using (symbol, pos) left join datr14 a14 using (symbol, pos))""")
def _(t):
    return out(_day(dl.daily_indicators(t.daily, "d")), "symbol d",
               "ema8_d ema9_d ema21_d ema50_d sma50_d sma100_d sma200_d atr_d1 atr14_d1 adv20")


@query("average_daily_volume", """select symbol, d::varchar as d, round(avg(volume) over (partition by symbol order by d
 rows between 19 preceding and current row), 6) as adv20 from daily""")
def _(t):
    return out(_day(dl.daily_indicators(t.daily, "d")), "symbol d", "adv20")


CTES["ctx"] = """select symbol, day, lag(open) over w as prior_open, lag(high) over w as prior_high, lag(low) over w as prior_low,
 lag(close) over w as prior_close, lag(adv) over w as adv20, lag(h52) over w as hi_52w, lag(l52) over w as lo_52w,
 lag(nd) over w as days, lag(h3) over w as n_day_high, lag(l3) over w as n_day_low, lag(highs) over w as highs_60, lag(lows) over w as lows_60,
 lag(atr) over w as atr_d1 from (
 select s.*, a.y as atr, avg(volume) over w20 as adv, max(high) over w252 as h52, min(low) over w252 as l52, count(*) over w252 as nd,
  case when count(*) over w3 = 3 then max(high) over w3 end as h3, case when count(*) over w3 = 3 then min(low) over w3 end as l3,
  list(high) over w60 as highs, list(low) over w60 as lows
 from sessions s left join satr a using (symbol, pos)
 window w20 as (partition by symbol order by pos rows between 19 preceding and current row),
  w252 as (partition by symbol order by pos rows between 251 preceding and current row),
  w60 as (partition by symbol order by pos rows between 59 preceding and current row),
  w3 as (partition by symbol order by pos rows between 2 preceding and current row))
 window w as (partition by symbol order by day)"""
CTES["str"] = """select * from (select symbol, pos, greatest(high - low, abs(high - pc), abs(low - pc)) as tr from
 (select *, lag(close) over (partition by symbol order by pos) as pc from sessions)) where pos >= 2"""
add_smooth("satr", "str", "symbol", "tr", 5, wilder=True, start=2)


@query("prior_session_levels", """select symbol, day, prior_open, prior_high, prior_low, prior_close, hi_52w, lo_52w, days, n_day_high,
 n_day_low, round(adv20, 6) as adv20, round(atr_d1, 6) as atr_d1 from ctx""")
def _(t):
    return out(t.context, "symbol day prior_open prior_high prior_low prior_close hi_52w lo_52w days n_day_high n_day_low",
               "adv20 atr_d1")


@query("bar_percent_columns", """select symbol, day, et_min, round((session_open - prior_close) / prior_close * 100, 6) as gap_pct,
 round((prior_close - prior_open) / prior_open * 100, 6) as prior_day_chg_pct,
 round((last_close - session_open) / session_open * 100, 6) as rth_chg_pct, round((close - close_15ago) / close_15ago * 100, 6) as mom_15m_pct,
 round((last_close - vwap) / vwap * 100, 6) as dist_vwap_pct,
 round((last_close - day_low) / nullif(day_high - day_low, 0), 6) as day_range_pos from state left join ctx using (symbol, day)""")
def _(t):
    return out(st.derived(t.state, t.context), "symbol day et_min",
               "gap_pct prior_day_chg_pct rth_chg_pct mom_15m_pct dist_vwap_pct day_range_pos")


@query("candle_studies", """select c.symbol, c.day, c.slot, c.session as key_session, round(e.y, 6) as ema9, round(a.y, 6) as atr14,
 round(case when count(*) over w = 50 then avg(close) over w end, 6) as sma50
 from candles c left join c5ema9 e on e.symbol = c.symbol and e.cpos = c.cpos left join c5atr14 a on a.symbol = c.symbol and a.cpos = c.cpos
 where tf = 5 and covered window w as (partition by c.symbol order by c.cpos rows between 49 preceding and current row)""")
def _(t):
    return out(ind.studies(co.covered(t.candles, 5), SERIES, "cpos"), "symbol day slot key_session", "ema9 atr14 sma50")


CTES["c5"] = "select * from candles where tf = 5 and covered"
add_smooth("c5ema9", "c5", "symbol", "close", 9, pos="cpos")
CTES["c5tr"] = """select * from (select *, greatest(high - low, abs(high - pc), abs(low - pc)) as tr from
 (select *, lag(close) over (partition by symbol order by cpos) as pc from c5)) where cpos >= 2"""
add_smooth("c5atr14", "c5tr", "symbol", "tr", 14, wilder=True, start=2, pos="cpos")
add_smooth("c5atr20", "c5tr", "symbol", "tr", 20, wilder=True, start=2, pos="cpos")

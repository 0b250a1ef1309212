"""State predicates, gates and universe profiles.  Values are evaluated on every regular bar."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.asof import asof
from ..operators import candles as co
from ..operators import conditions as cd
from ..operators import indicators as ind
from ..operators import relative as rel
from ..operators import state as st
from ..operators import triggers as tr
from . import q_indicators as qi
from .registry import CTES, add_smooth, out, query, with_ctes  # noqa: F401
from .tables import BASE_DATE


def base(t):
    """Derived bar table with relative volume and the direction a candidate alert would have (up bar = long)."""
    b = cd.bar_values(st.rvol(st.derived(t.state, t.context), t.profile))
    return b.where("session = 'rth'").withColumn("direction", F.when(F.col("close") >= F.col("open"), "long").otherwise("short"))


for _n, _w, _s in ((8, False, 1), (14, True, 2)):
    if _w:
        add_smooth("satr14", "str", "symbol", "tr", 14, wilder=True, start=2)
    else:
        add_smooth("sema8", "sessions", "symbol", "close", 8)
CTES["ctx2"] = """select symbol, day, lag(e.y) over w as ema8_d, lag(a.y) over w as atr14_d1 from sessions left join sema8 e using (symbol, pos)
 left join satr14 a using (symbol, pos) window w as (partition by symbol order by day)"""
CTES["cb"] = """select b.*, r.rvol, c2.ema8_d, c2.atr14_d1, case when close >= open then 'long' else 'short' end as direction,
 case when close >= open then 1.0 else -1.0 end::double as sgn
 from sb b left join rvol r using (symbol, day, et_min) left join ctx2 c2 using (symbol, day) where session = 'rth'"""


def show(df, value, verdict):
    return out(df.withColumn("value", value).withColumn("passed", verdict), "symbol day et_min passed", "value")


OPSQL = {"gte": ">=", "lte": "<=", "gt": ">", "lt": "<"}


def cond_sql(src, value, op, thr, missing="false"):
    return (f"select symbol, day, et_min, round(v, 6) as value, case when v is null then {missing} else v {OPSQL[op]} {thr} end as passed "
            f"from (select *, cast({value} as double) as v from {src})")


def register(name, value, op, thr, sql_value, src="cb", make=base, missing=False):
    @query(f"condition_{name}", cond_sql(src, sql_value, op, thr, str(missing).lower()))
    def _(t):
        d = make(t)
        return show(d, value(), cd.passed(value(), op, thr, missing))


C = F.col


def D():
    return F.col("direction")


register("price", lambda: C("price"), "gte", 100.0, "close")
register("avg_vol_20d", lambda: C("avg_vol_20d"), "gte", 900_000.0, "adv20")
register("avg_dollar_vol_20d", lambda: C("avg_dollar_vol_20d"), "gte", 4e8, "case when prior_close <> 0 then adv20 * prior_close end")
register("atr_pct", lambda: C("atr_pct"), "gte", 500.0, "atr_d1 / prior_close * 100")
register("session_volume", lambda: C("session_volume"), "gte", 500_000.0, "cum_volume")
register("rvol", lambda: C("rvol"), "gte", 1.0, "rvol")
register("gap_pct_abs", lambda: F.abs(C("gap_pct")), "gte", 1.0, "abs((session_open - prior_close) / prior_close * 100)")
register("gap_pct_signed", lambda: C("gap_pct"), "gte", 1.0, "(session_open - prior_close) / prior_close * 100")
register("dist_vwap_pct_abs", lambda: F.abs(C("dist_vwap_pct")), "gte", 2.0, "abs((last_close - vwap) / vwap * 100)")
register("dist_vwap_pct_trade", lambda: cd.side_value(C("dist_vwap_pct"), "trade", D()), "gte", 2.0, "(last_close - vwap) / vwap * 100 * sgn")
register("atr_extension_d1", lambda: cd.side_value(C("atr_extension_d1"), "trade", D()), "gte", 2.0, "(close - ema8_d) / nullif(atr14_d1, 0) * sgn")
register("day_range_pos", lambda: C("day_range_pos"), "lte", 0.8, "(last_close - day_low) / nullif(day_high - day_low, 0)")
register("rth_chg_pct", lambda: F.abs(C("rth_chg_pct")), "gte", 2.0, "abs((last_close - session_open) / session_open * 100)")
register("mom_15m_pct", lambda: F.abs(C("mom_15m_pct")), "gte", 1.0, "abs((close - close_15ago) / close_15ago * 100)")
register("time_et", lambda: C("time_et"), "gte", 1030.0, "floor((et_min + 1) / 60) * 100 + (et_min + 1) % 60")
register("dist_level_prior_high", lambda: cd.level_distance(C("close"), C("prior_high")), "lte", 0.5,
         "case when prior_high > 0 then abs(close - prior_high) / prior_high * 100 end")
register("dist_level_pm_low_atr", lambda: cd.level_distance(C("close"), C("pm_low"), 1, C("atr_d1")), "lte", 0.5,
         "case when pm_low > 0 then (close - pm_low) / nullif(atr_d1, 0) * 100 end")
register("void_pct", lambda: cd.by_direction(C("void_long"), C("void_short"), D()), "gte", 1.0,
         """case when highs_60 is null then null when direction = 'long' then
 coalesce((list_min(list_filter(highs_60, lambda x: x > close)) - close) / close * 100, 999.0)
 else coalesce((close - list_max(list_filter(lows_60, lambda x: x < close))) / close * 100, 999.0) end""")


# ---- fundamentals as of the bar ---------------------------------------------------------------------------------------------

CTES["fund"] = """select 'S' || lpad(cast(s_suppkey % 20 as varchar), 2, '0') as symbol, cast(s_suppkey // 20 as int) as day, 600 as et_min,
 case when s_suppkey % 7 <> 0 then s_acctbal end as market_cap, abs(s_acctbal) * 3000 as float_shares, (s_suppkey * 7) % 40 / 1.0::double as short_pct_float
 from supplier"""
CTES["fb"] = """select c.symbol, c.day, c.et_min, arg_max(struct_pack(m := market_cap, f := float_shares, s := short_pct_float), f.day * 10000 + f.et_min) as x
 from cb c left join fund f on f.symbol = c.symbol and f.day * 10000 + f.et_min <= c.day * 10000 + c.et_min group by all"""


def fundamentals(t):
    s = t.raw("supplier")
    return s.select(F.concat(F.lit("S"), F.lpad((F.col("s_suppkey") % 20).cast("string"), 2, "0")).alias("symbol"),
                    F.date_add(F.lit(BASE_DATE), F.floor(F.col("s_suppkey") / 20).cast("int")).alias("et_date"), F.lit(600).alias("et_min"),
                    F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("market_cap"),
                    (F.abs("s_acctbal") * 3000).alias("float_shares"),
                    ((F.col("s_suppkey") * 7) % 40 / F.lit(1.0)).alias("short_pct_float"))


def with_fundamentals(t):
    return asof(t.bars.where("session = 'rth'").select("symbol", "et_date", "et_min"), fundamentals(t), ["symbol"], "et_date", "et_min",
                ["market_cap", "float_shares", "short_pct_float"])


register("market_cap", lambda: C("market_cap"), "gte", 3000.0, "x.m", "fb", with_fundamentals, True)
register("float_shares", lambda: C("float_shares"), "lte", 20_000_000.0, "x.f", "fb", with_fundamentals, True)
register("short_pct_float", lambda: C("short_pct_float"), "gte", 10.0, "x.s", "fb", with_fundamentals, True)


# ---- opening candle ------------------------------------------------------------------------------------------------------------

CTES["cbo"] = """select c.*, case when c.et_min >= 575 then o.dir end as dir, case when c.et_min >= 575 then o.orv end as orv,
 case when c.et_min >= 575 and k.coverage >= 0.8 then k.opening_rank end as rnk from cb c left join opening o using (symbol, day) left join openrank k using (symbol, day)"""


def with_opening(t):
    r = qi.opening_ranks(t).select("symbol", "et_date", "opening_rank", "coverage")
    o = qi.opening_five(t).select("symbol", "et_date", "opening_direction", "opening_rvol")
    seen = F.col("et_min") >= 575
    b = base(t).join(r, ["symbol", "et_date"], "left").join(o, ["symbol", "et_date"], "left")
    return b.withColumns({"opening_direction": F.when(seen, F.col("opening_direction")), "opening_rvol": F.when(seen, F.col("opening_rvol")),
                          "opening_rank": F.when(seen & (F.col("coverage") >= 0.8), F.col("opening_rank"))})


register("opening_direction_m5", lambda: cd.side_value(C("opening_direction"), "trade", D()), "gte", 1.0, "dir * sgn", "cbo", with_opening)
register("opening_rvol_m5", lambda: C("opening_rvol"), "gte", 1.0, "orv", "cbo", with_opening)
register("opening_rvol_rank", lambda: C("opening_rank"), "lte", 10.0, "rnk", "cbo", with_opening)


# ---- completed-candle values -------------------------------------------------------------------------------------------------

def candle_register(name, value, op, thr, cte, sql_value, values, cols, tf, key="cpos", before="cbefore"):
    """``values(t)``: candle rows with ``cols``; the SQL twin is ``cte`` with the same candle number."""
    series = " and x.series = b.series" if tf < 5 else ""
    src = (f"(select b.*, case when close >= open then 'long' else 'short' end as direction, case when close >= open then 1.0 else -1.0 end::double as sgn, "
           f"x.* exclude (symbol{', series' if tf < 5 else ''}) from bc b left join {cte} x on x.symbol = b.symbol{series} and x.{key} = b.{before} "
           f"where b.tf = {tf} and b.session = 'rth')")

    def make(t):
        b = t.bars.where("session = 'rth'").withColumn("direction", F.when(F.col("close") >= F.col("open"), "long").otherwise("short"))
        return cd.on_bars(b, t.candles, values(t), cols, tf, key, before)
    register(name, value, op, thr, sql_value, src, make)


CTES["vh5"] = """select symbol, cpos, case when n = 5 and nv = 5 and g = 0 then a end::double as ha, case when n = 5 and nv = 5 and g = 0 then bl end::double as hb from (
 select *, count(*) over w as n, count(vwap) over w as nv, sum(case when close > vwap then 1 else 0 end) over w as a,
  sum(case when close < vwap then 1 else 0 end) over w as bl, sum(gap) over (partition by symbol order by cpos rows between 3 preceding and current row) as g
 from cg where tf = 5 window w as (partition by symbol order by cpos rows between 4 preceding and current row))"""
candle_register("vwap_hold", lambda: cd.by_direction(C("hold_above"), C("hold_below"), D()), "gte", 4.0, "vh5", "case when direction = 'long' then ha else hb end",
                lambda t: cd.vwap_hold(t.candles), ["hold_above", "hold_below"], 5)
CTES["eh5"] = """select symbol, cpos, case when cpos >= 9 then sum(case when close > y then 1.0 else 0.0 end) over w end::double as ha,
 case when cpos >= 9 then sum(case when close < y then 1.0 else 0.0 end) over w end::double as hb from c5 join ehema using (symbol, cpos)
 window w as (partition by symbol order by cpos rows between 2 preceding and current row)"""
CTES["ehema"] = """select symbol, cpos, close as y from c5 where cpos = 1 union all
 select s.symbol, s.cpos, 0.2::double * s.close + 0.8::double * r.y from ehema r join c5 s on s.symbol = r.symbol and s.cpos = r.cpos + 1"""
candle_register("ema_hold", lambda: cd.by_direction(C("hold_above"), C("hold_below"), D()), "gte", 3.0, "eh5", "case when direction = 'long' then ha else hb end",
                lambda t: cd.ema_hold(t.candles), ["hold_above", "hold_below"], 5)
for _p in (8, 21):
    add_smooth(f"re1x{_p}", "rc1", "symbol, series", "close", _p, pos="rpos")
CTES["es1"] = """select f.symbol, f.series, f.rpos, (f.y - s.y) / nullif(s.y, 0) * 100 as sep from re1x8 f join re1x21 s
 on s.symbol = f.symbol and s.series = f.series and s.rpos = f.rpos"""
candle_register("ema_stack", lambda: cd.side_value(C("stack"), "trade", D()), "gte", 0.0, "es1", "sep * sgn", lambda t: cd.ema_stack(t.candles), ["stack"], 1, "rpos", "rbefore")
CTES["e15"] = "select symbol, rpos, y as ema9 from re15x9"
candle_register("dist_ema9_pct", lambda: F.abs((C("close") - C("ema9")) / C("ema9") * 100), "gte", 2.0, "e15", "abs((close - ema9) / ema9 * 100)",
                lambda t: cd.dist_ema9(t.candles, 15), ["ema9"], 15, "rpos", "rbefore")

_ser = co.SERIES
_STUDIES = {   # check id -> (study, column, op, threshold, sql table, sql value)
    "adx": (ind.adx, "adx", "gte", 15.0, "c5adx", "v"),
    "ta_sma": (lambda c, k, p: ind.sma(c, k, p, 50), "sma", "gte", 0.0, "c5sma", "v"),
    "ta_ema": (lambda c, k, p: ind.ema(c, k, p, {"ema": 9}), "ema", "gte", 0.0, "c5ema9", "y"),
    "ta_atr": (lambda c, k, p: ind.atr(c, k, p, {"atr": 14}), "atr", "gte", 1.0, "c5atr14", "y"),
    "ta_rsi": (ind.rsi, "rsi", "gte", 50.0, "c5rsi", "v"),
    "ta_cci": (ind.cci, "cci", "gte", 100.0, "c5cci", "v"),
    "ta_macd": (ind.macd, "macd", "gte", 0.0, "c5macd", "m"),
    "ta_macd_signal": (ind.macd, "macd_signal", "gte", 0.0, "c5hist", "sig"),
    "ta_macd_hist": (ind.macd, "macd_hist", "gte", 0.0, "c5hist", "v"),
    "ta_stoch_k": (ind.stoch, "stoch_k", "gte", 40.0, "c5st", "v"),
    "ta_stoch_d": (ind.stoch, "stoch_d", "gte", 40.0, "c5st", "d"),
    "ta_bb_lower": (ind.bbands, "bb_lower", "gte", 0.0, "c5bb", "m - 2 * sd"),
    "ta_bb_middle": (ind.bbands, "bb_middle", "gte", 0.0, "c5bb", "m"),
    "ta_bb_upper": (ind.bbands, "bb_upper", "gte", 0.0, "c5bb", "m + 2 * sd"),
    "ta_bb_width": (ind.bbands, "bb_width", "gte", 5.0, "c5bb", "((m + 2 * sd) - (m - 2 * sd)) * 100 / m"),
    "ta_bb_percent_b": (ind.bbands, "bb_percent_b", "gte", 0.8, "c5bb", "v"),
    "ta_obv": (ind.obv, "obv", "gte", 0.0, "c5obv", "v"),
    "ta_adx_plus_di": (ind.adx, "plus_di", "gte", 20.0, "c5di", "plus_di"),
    "ta_adx_minus_di": (ind.adx, "minus_di", "gte", 20.0, "c5di", "minus_di"),
}
CTES["c5sma"] = """select symbol, cpos, case when count(*) over w = 50 then avg(close) over w end as v from c5
 window w as (partition by symbol order by cpos rows between 49 preceding and current row)"""
CTES["c5obv"] = """select symbol, cpos, sum(case when pc is null then volume else sign(close - pc) * volume end) over (partition by symbol order by cpos) as v from c5x"""
for _id, (_fn, _col, _op, _thr, _cte, _val) in _STUDIES.items():
    _only = f"xs_{_id}"
    CTES[_only] = f"select symbol, cpos, {_val} as xv from {_cte}"
    candle_register(_id, lambda col=_col: C(col), _op, _thr, _only, "xv", lambda t, fn=_fn: fn(co.covered(t.candles, 5), _ser, "cpos"), [_col], 5)


# ---- values inside the date ------------------------------------------------------------------------------------------------------

def day_register(name, value, op, thr, cte, sql_value, values, cols, tf, warming=None, missing_sql="false"):
    """``values(t)``: candle rows (key_session, slot); bars see the newest earlier candle of the date that has a value."""
    src = (f"(select b.*, case when b.close >= b.open then 'long' else 'short' end as direction, case when b.close >= b.open then 1.0 else -1.0 end::double as sgn, "
           f"x.* exclude (symbol, day, slot) from bc b asof left join {cte} x on x.symbol = b.symbol and x.day = b.day and x.slot < b.slot "
           f"where b.tf = {tf} and b.session = 'rth')")

    @query(f"condition_{name}", cond_sql(src, sql_value, op, thr, missing_sql))
    def _(t):
        b = t.bars.where("session = 'rth'").withColumn("direction", F.when(F.col("close") >= F.col("open"), "long").otherwise("short"))
        d = co.bars_with_candle(b, cd.day_asof(t.candles, tf, values(t), cols), tf)
        return show(d, value(), cd.passed(value(), op, thr, False, warming() if warming else None))


CTES["vdp"] = """select symbol, day, slot, sum(case when close > vwap then 1 else 0 end) over w * 100.0::double / count(*) over w as pa,
 sum(case when close < vwap then 1 else 0 end) over w * 100.0::double / count(*) over w as pb from candles where covered and tf = 5 and session = 'rth'
 window w as (partition by symbol, day order by slot rows unbounded preceding)"""
day_register("vwap_day_pct", lambda: cd.by_direction(C("pct_above"), C("pct_below"), D()), "gte", 50.0, "vdp", "case when direction = 'long' then pa else pb end",
             lambda t: cd.vwap_day_pct(t.candles), ["pct_above", "pct_below"], 5)
CTES["stk5"] = "select symbol, day, slot, streak from streak where tf = 5 and session = 'rth'"
day_register("consec_candles", lambda: F.abs(C("streak")).cast("double"), "lte", 3.0, "stk5", "abs(streak)",
             lambda t: qi.streaks(co.covered(t.candles, 5)).where("key_session = 'rth'"), ["streak"], 5)
CTES["n5"] = "select symbol, day, slot, row_number() over (partition by symbol, day order by slot) as n5 from candles where tf = 5 and covered and session = 'rth'"
CTES["m5x"] = "select symbol, day, slot, n5, raw from n5 left join m5raw using (symbol, day, slot)"


def rrs_values(t, bench="S00"):
    from pyspark.sql import Window
    c = co.covered(t.candles, 5).where("key_session = 'rth'")
    c = c.withColumn("n5", F.row_number().over(Window.partitionBy("symbol", "et_date").orderBy("slot")))
    r = qi.rrs_m5(t.candles, bench).select("symbol", "et_date", "slot", "rrs_m5")
    return c.select("symbol", "et_date", "key_session", "slot", "n5").join(r, ["symbol", "et_date", "slot"], "left")


day_register("rrs_m5", lambda: cd.side_value(C("rrs_m5"), "trade", D()), "gt", 0.0, "m5x", "raw * sgn", rrs_values, ["n5", "rrs_m5"], 5,
             lambda: F.coalesce(C("n5"), F.lit(0)) < 12, "coalesce(n5, 0) < 12")


def rrs_slopes(t):
    from pyspark.sql import Window
    r = qi.rrs_m5(t.candles, "S00").where("rrs_m5 is not null")
    w = Window.partitionBy("symbol", "et_date").orderBy("pos")
    return r.withColumn("slope", F.col("rrs_m5") - F.lag("rrs_m5", 3).over(w)).where("slope is not null").select("symbol", "et_date", "key_session", "slot", "slope")


CTES["m5s"] = "select * from (select symbol, day, slot, raw - lag(raw, 3) over (partition by symbol, day order by pos) as slope from m5raw) where slope is not null"
day_register("rrs_slope", lambda: cd.side_value(C("slope"), "trade", D()), "gte", 0.3, "m5s", "slope * sgn", rrs_slopes, ["slope"], 5)
CTES["s5in"] = CTES["m5in"].replace("'S00'", "'S01'")
CTES["s5tr"] = CTES["m5tr"].replace("m5in", "s5in")
add_smooth("s5_as", "s5tr", "symbol, day", "ts", 12, wilder=True, start=2)
add_smooth("s5_ab", "s5tr", "symbol, day", "tb", 12, wilder=True, start=2)
CTES["s5raw"] = CTES["m5raw"].replace("m5in", "s5in").replace("m5tr", "s5tr").replace("m5_as", "s5_as").replace("m5_ab", "s5_ab")
CTES["s5x"] = "select symbol, day, slot, raw from s5raw"
day_register("rrs_sector_m5", lambda: cd.side_value(C("rrs_m5"), "trade", D()), "gt", 0.0, "s5x", "raw * sgn",
             lambda t: qi.rrs_m5(t.candles, "S01").where("rrs_m5 is not null"), ["rrs_m5"], 5)

# rel_vol: the every-bar ratio, with the completed-candle ratio as fallback from 5 minutes up
CTES["relv"] = """select c.*, coalesce(r.ratio, k.ratio) * 100 as pct from cb c left join (
 select symbol, day, et_min, sum(volume) over (w rows between 4 preceding and current row) / nullif(sum(volume) over (w rows between 54 preceding and 5 preceding) / 10, 0) as ratio,
  count(*) over (w rows between 54 preceding and current row) as n from bars window w as (partition by symbol, day, session order by et_min)) r
 on r.symbol = c.symbol and r.day = c.day and r.et_min = c.et_min and r.n = 55
 left join bc b on b.symbol = c.symbol and b.day = c.day and b.et_min = c.et_min and b.tf = 5
 left join (select symbol, cpos, volume / nullif(m, 0) as ratio from (select *, avg(volume) over (w rows between 10 preceding and 1 preceding) as m,
   count(*) over (w rows between 10 preceding and current row) as n, sum(gap) over (w rows between 9 preceding and current row) as g from cg where tf = 5
   window w as (partition by symbol order by cpos)) where n = 11 and g = 0) k on k.symbol = c.symbol and k.cpos = b.cbefore"""


def with_rel_vol(t):
    r = rel.rolling_rel_volume(t.bars, 5, 10, "rolling").where("session = 'rth'")
    k = rel.candle_rel_volume(co.covered(t.candles, 5), 10, "by_candle")
    return cd.on_bars(r, t.candles, k, ["by_candle"], 5).withColumn("rel_vol", F.coalesce("rolling", "by_candle") * 100)


register("rel_vol", lambda: C("rel_vol"), "gte", 200.0, "pct", "relv", with_rel_vol)

CTES["regime"] = """select day, et_min, case when vwap is null or vwap <= 0 then 'neutral' when (close - vwap) / vwap > 0.001 then 'bullish'
 when (close - vwap) / vwap < -0.001 then 'bearish' else 'neutral' end as regime, coalesce(lead(et_min) over (partition by day order by et_min) - 1, 1200) as upto
 from state where symbol = 'S00' and session = 'rth'"""
CTES["cbr"] = "select c.*, r.regime from cb c left join regime r on r.day = c.day and c.et_min between r.et_min and r.upto"


def with_regime(t):
    b = base(t)
    s = t.state.where("symbol = 'S00' and session = 'rth'").withColumn("regime", st.market_regime(F.col("close"), F.col("vwap")))
    return b.join(tr.per_minute(s, ["regime"]).withColumnRenamed("bench_regime", "regime"), ["et_date", "et_min"], "left")


register("market_align", lambda: cd.market_align(C("regime"), D(), C("et_min")), "gte", 1.0,
         "case when et_min < 600 then 1 when regime is null then null when direction = 'long' and regime = 'bearish' then 0 when direction = 'short' and regime = 'bullish' then 0 else 1 end",
         "cbr", with_regime)

CTES["srrsin"] = """select a.symbol, a.day, a.high, a.low, a.close, b.high as bh, b.low as bl, b.close as bc, row_number() over (partition by a.symbol order by a.day) as pos
 from sessions a join sessions b on a.day = b.day and b.symbol = 'S00' where a.symbol <> 'S00'"""


@query("condition_rrs_d1", """select symbol, d::varchar as d, round(v, 6) as value, case when v is null then false else v >= 1 end as passed from (
 select symbol, d, case when count(raw) over w = 5 then avg(raw) over w end as v from rrs_raw window w as (partition by symbol order by pos rows between 4 preceding and current row))""")
def _(t):
    r = ind.sma(ind.rrs(qi.aligned(t.daily), ["symbol"], "pos", 5), ["symbol"], "pos", 5, "rrs_raw", "value")
    return out(r.withColumn("passed", cd.passed(F.col("value"), "gte", 1.0)).withColumn("d", F.col("d").cast("string")), "symbol d passed", "value")


@query("condition_generic_check", """select symbol, day, et_min, name, passed, value, reason from (
 select symbol, day, et_min, 'gap_pct' as name, case when g is null then false else g >= 1 end as passed, floor(g * 1e4 + 0.5::double) / 1e4 as value,
  case when g is null then 'unavailable' else 'available' end as reason from (select *, (session_open - prior_close) / prior_close * 100 as g from cb)
 union all select symbol, day, et_min, 'market_cap', case when x.m is null then true else x.m >= 3000 end, floor(x.m * 1e4 + 0.5::double) / 1e4,
  case when x.m is null then 'unavailable (pass)' else 'available' end from fb)""")
def _(t):
    g = base(t).withColumn("c", cd.check("gap_pct", F.col("gap_pct"), "gte", 1.0))
    m = with_fundamentals(t).withColumn("c", cd.check("market_cap", F.col("market_cap"), "gte", 3000.0, True))
    cols = ["symbol", "et_date", "et_min", "c"]
    raw = {"gap_pct": g.withColumn("raw", F.col("gap_pct")), "market_cap": m.withColumn("raw", F.col("market_cap"))}
    u = raw["gap_pct"].select(*cols, "raw").unionByName(raw["market_cap"].select(*cols, "raw"))
    u = u.select("symbol", "et_date", "et_min", F.col("c.name").alias("name"), F.col("c.passed").alias("passed"),
                 (F.floor(F.col("raw") * 1e4 + F.lit(0.5)) / F.lit(1e4)).alias("value"),
                 F.when(F.col("raw").isNotNull(), "available").otherwise(F.col("c.reason")).alias("reason"))
    return out(u, "symbol day et_min name passed value reason")


@query("threshold_gates", """select symbol, day, et_min, case when raw is null then case when coalesce(n5, 0) >= 12 then false end when direction = 'long' then raw > 0 else raw < 0 end as gate_rrs,
 rvol >= 1 as gate_rvol, v >= 1 as gate_void, ma >= 1 as gate_market from (select c.*, x.raw, x.n5, case when c.highs_60 is null then null when c.direction = 'long' then
  coalesce((list_min(list_filter(c.highs_60, lambda y: y > c.close)) - c.close) / c.close * 100, 999.0)
  else coalesce((c.close - list_max(list_filter(c.lows_60, lambda y: y < c.close))) / c.close * 100, 999.0) end as v,
  case when c.et_min < 600 then 1 when c.regime is null then null when c.direction = 'long' and c.regime = 'bearish' then 0 when c.direction = 'short' and c.regime = 'bullish' then 0 else 1 end as ma
  from (select *, cast(floor((et_min - 570) / 5) as int) as slot5 from cbr) c asof left join m5x x on x.symbol = c.symbol and x.day = c.day and x.slot < c.slot5)""")
def _(t):
    b = with_regime(t)
    v = cd.day_asof(t.candles, 5, rrs_values(t), ["n5", "rrs_m5"])
    d = co.bars_with_candle(b, v, 5).withColumn("bars_5m", F.coalesce("n5", F.lit(0)))
    return out(cd.gates(d, F.col("direction")), "symbol day et_min gate_rrs gate_rvol gate_void gate_market")


# ---- profiles over the daily universe ---------------------------------------------------------------------------------------------

# Thresholds of the default profiles scaled to the test universe (same conditions and operators).
TEST_PROFILES = {"up_all": [], "up_liquid_movers": [("price", "gte", 15.0), ("avg_vol_20d", "gte", 2_500.0), ("avg_dollar_vol_20d", "gte", 500_000.0), ("atr_pct", "gte", 1.0)],
                 "up_small_cap_runners": [("price", "gte", 1.0), ("atr_pct", "gte", 4.0), ("float_shares", "lte", 20_000_000.0), ("market_cap", "lte", 5000.0)]}


def static_values(t):
    from ..operators import daily as dl
    s = t.raw("supplier").select(F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 3, "0")).alias("symbol"),
                                 F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("market_cap"),
                                 (F.abs("s_acctbal") * 3000).alias("float_shares"), F.lit(None).cast("double").alias("short_pct_float"))
    m = dl.bar_metrics(t.daily).select("symbol", F.col("last_price").alias("price"), F.col("avg_volume").alias("avg_vol_20d"),
                                       F.col("avg_dollar_volume").alias("avg_dollar_vol_20d"), "atr_pct")
    return m.join(s, "symbol", "left")


CTES["metrics"] = """select symbol, n, avg_volume, avg_volume * last_price as avg_dollar_volume, rng / last_price * 100 as atr_pct, last_price from (
 select symbol, count(*) as n, avg(volume) as avg_volume, avg(high - low) as rng, max_by(close, d) as last_price from (
  select *, row_number() over (partition by symbol order by d desc) as rn from daily) where rn <= 20 group by symbol) where n >= 10 and last_price > 0"""
CTES["sv"] = """select symbol, last_price as price, avg_volume as avg_vol_20d, avg_dollar_volume as avg_dollar_vol_20d, atr_pct,
 case when s_suppkey % 7 <> 0 then s_acctbal end as market_cap, abs(s_acctbal) * 3000 as float_shares from metrics
 left join supplier on symbol = 'S' || lpad(cast(s_suppkey as varchar), 3, '0')"""
CTES["pchecks"] = """select 'up_liquid_movers' as profile_id, symbol, unnest([struct_pack(id := 'price', ok := price >= 15), struct_pack(id := 'avg_vol_20d', ok := avg_vol_20d >= 2500),
  struct_pack(id := 'avg_dollar_vol_20d', ok := avg_dollar_vol_20d >= 500000), struct_pack(id := 'atr_pct', ok := atr_pct >= 1)]) as c from sv
 union all select 'up_small_cap_runners', symbol, unnest([struct_pack(id := 'price', ok := price >= 1), struct_pack(id := 'atr_pct', ok := atr_pct >= 4),
  struct_pack(id := 'float_shares', ok := coalesce(float_shares <= 20000000, true)), struct_pack(id := 'market_cap', ok := coalesce(market_cap <= 5000, true))]) from sv"""
CTES["memb"] = """select p as profile_id, symbol from sv cross join (select unnest(['up_all', 'up_liquid_movers', 'up_small_cap_runners']) as p)
 where not exists (select 1 from pchecks k where k.profile_id = p and k.symbol = sv.symbol and not k.c.ok)"""


@query("profile_members", "select profile_id, symbol from memb")
def _(t):
    return cd.members(static_values(t), cd.profiles_table(t.spark, TEST_PROFILES)).select("profile_id", "symbol")


@query("profile_checks", "select profile_id, symbol, c.id as id, coalesce(c.ok, false) as passed from pchecks")
def _(t):
    c = cd.profile_checks(static_values(t), cd.profiles_table(t.spark, TEST_PROFILES))
    return c.select("profile_id", "symbol", "id", F.coalesce("passed", F.lit(False)).alias("passed"))


@query("profile_membership_update", "select profile_id, symbol from memb")
def _(t):
    """Members recomputed for the symbols of one nation and merged over the earlier membership."""
    v = static_values(t)
    p = cd.profiles_table(t.spark, TEST_PROFILES)
    changed = t.raw("supplier").where("s_nationkey % 2 = 0").select(F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 3, "0")).alias("symbol"))
    old = cd.members(v, p).join(changed, "symbol", "left_anti")
    new = cd.members(v.join(changed, "symbol", "left_semi"), p)
    return old.select("profile_id", "symbol").unionByName(new.select("profile_id", "symbol"))


@query("profile_member_filter", "select d.symbol, d.d::varchar as d, d.close from daily d where d.symbol in (select symbol from memb where profile_id = 'up_liquid_movers')")
def _(t):
    m = cd.members(static_values(t), cd.profiles_table(t.spark, TEST_PROFILES)).where("profile_id = 'up_liquid_movers'")
    return t.daily.join(m, "symbol", "left_semi").select("symbol", F.col("d").cast("string").alias("d"), "close")


@query("profile_blocked_symbols", """select profile_id, symbol, string_agg(c.id, ',' order by c.id) as failing from pchecks where not c.ok group by 1, 2""")
def _(t):
    """Symbols outside a profile with the checks that failed."""
    v, p = static_values(t), cd.profiles_table(t.spark, TEST_PROFILES)
    checks = cd.profile_checks(v, p)
    blocked = checks.select("profile_id", "symbol").distinct().join(cd.members(v, p), ["profile_id", "symbol"], "left_anti")
    return (checks.where(~F.col("passed")).join(blocked, ["profile_id", "symbol"]).groupBy("profile_id", "symbol")
                  .agg(F.concat_ws(",", F.sort_array(F.collect_list("id"))).alias("failing")))


@query("profile_preview", """select profile_id, (select count(*) from sv) as universe, count(*) as members,
 array_to_string(list_slice(list(symbol order by symbol), 1, 5), ',') as first_symbols, count(*) > 5 as truncated from memb group by profile_id""")
def _(t):
    v, p = static_values(t), cd.profiles_table(t.spark, TEST_PROFILES)
    m = cd.members(v, p)
    from pyspark.sql import Window
    first = (m.withColumn("rn", F.row_number().over(Window.partitionBy("profile_id").orderBy("symbol"))).where("rn <= 5")
              .groupBy("profile_id").agg(F.concat_ws(",", F.sort_array(F.collect_list("symbol"))).alias("first_symbols")))
    n = v.agg(F.count(F.lit(1)).alias("universe")).withColumn("k", F.lit(1))
    c = m.groupBy("profile_id").agg(F.count(F.lit(1)).alias("members")).withColumn("k", F.lit(1))
    return (c.join(n, "k").join(first, "profile_id")
             .select("profile_id", "universe", "members", "first_symbols", (F.col("members") > 5).alias("truncated")))

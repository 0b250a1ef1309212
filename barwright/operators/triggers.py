"""Event detectors: DataFrames of fires (symbol, et_date, et_min, session, trigger, option, tf, direction, value).

``Inputs`` holds the per-bar table (session columns, prior-session context) and the candles.  A detector is a projection over
one of three shapes: a minute bar, a bar with the newest completed candle, or a completed candle seen by the next bar.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clock
from ..functions.folds import fold_sorted
from ..functions.ordered import rolling
from . import candles as co
from . import daily as da
from . import indicators as ind

W = Window
DAY = ["symbol", "et_date"]
SERIES = co.SERIES
FIRE = ["symbol", "et_date", "et_min", "session", "trigger", "option", "tf", "direction", "value"]


@dataclass
class Inputs:
    bars: DataFrame         # bar_state joined with the daily context
    candles: DataFrame
    sessions: DataFrame | None = None   # regular-session daily bars; folded from the minute bars where not given
    external: DataFrame | None = None   # fires of other producers (``setup:<code>``)
    trades: DataFrame | None = None     # trusted trades, for crosses of the opening range
    sectors: DataFrame | None = None    # (symbol, sector): the benchmark of a symbol's sector

    @property
    def daily(self) -> DataFrame:
        return self.sessions if self.sessions is not None else co.session_bars(self.bars)

    @property
    def day_bars(self) -> DataFrame:
        """Bars of the sessions a detector accepts by default."""
        return self.bars.where(F.col("session").isin("pre", "rth"))

    def covered(self, *tfs: int) -> DataFrame:
        return co.covered(self.candles, *tfs)


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def event(cond: Column, trigger: str, option, direction, value, tf=None) -> Column:
    """The fire a row produces when ``cond`` holds, else NULL."""
    return F.when(cond, F.struct(
        F.lit(trigger).alias("trigger"), _lit(option).cast("string").alias("option"), (F.col("tf") if tf is None else _lit(tf)).cast("int").alias("tf"),
        _lit(direction).alias("direction"), _lit(value).cast("double").alias("value")))


def emit(df: DataFrame, *events: Column) -> DataFrame:
    """All fires of a row in one pass: both sides of a detector share one evaluation of their input."""
    return df.select(*DAY, "et_min", "session", F.inline(F.array_compact(F.array(*events))))


def fires(df: DataFrame, cond: Column, trigger: str, option, direction, value, tf=None) -> DataFrame:
    return emit(df, event(cond, trigger, option, direction, value, tf))


def both(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def cross(level: Column, up: bool, prev: Column | None = None, cur: Column | None = None) -> Column:
    """Equality belongs to the earlier side."""
    prev = F.col("prev_close") if prev is None else prev
    cur = F.col("close") if cur is None else cur
    return (prev <= level) & (cur > level) if up else (prev >= level) & (cur < level)


def edges(df: DataFrame, conds: dict[str, Column], keys=("tf",), order="et_min") -> DataFrame:
    """Flags of the rows on which a condition turns true; NULL leaves its latch untouched.  A latch lives one (symbol, date)."""
    w = W.partitionBy(*DAY, *[k for k in keys if k in df.columns]).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    d = df.withColumns({f"_c_{n}": c for n, c in conds.items()})
    latched = lambda n: F.coalesce(F.last(f"_c_{n}", ignorenulls=True).over(w), F.lit(False))
    return d.withColumns({n: F.coalesce(F.col(f"_c_{n}") & ~latched(n), F.lit(False)) for n in conds}).drop(*[f"_c_{n}" for n in conds])


def edge(df: DataFrame, cond: Column, keys=("tf",), order="et_min") -> DataFrame:
    return edges(df, {"_on": cond}, keys, order).where("_on").drop("_on")


def firsts(df: DataFrame, conds: dict[str, Column], *keys: str, order="et_min") -> DataFrame:
    """Flags of the first qualifying row per (symbol, date, keys), one flag per condition."""
    w = W.partitionBy(*DAY, *keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    d = df.withColumns({f"_c_{n}": F.coalesce(c, F.lit(False)) for n, c in conds.items()})
    seen = lambda n: F.coalesce(F.max(f"_c_{n}").over(w), F.lit(False))
    return d.withColumns({n: F.col(f"_c_{n}") & ~seen(n) for n in conds}).drop(*[f"_c_{n}" for n in conds])


def once(df: DataFrame, *keys: str, order="et_min") -> DataFrame:
    """First row per (symbol, date, keys)."""
    return firsts(df, {"_on": F.lit(True)}, *keys, order=order).where("_on").drop("_on")


def in_sessions(df: DataFrame, *sessions: str) -> DataFrame:
    return df.where(F.col("session").isin(*sessions))


# ---- minute-bar detectors ------------------------------------------------------------------------------------------------

def new_extreme(i: Inputs, trigger: str = "hod") -> DataFrame:
    """New high/low of the day (regular session) or of the whole day including premarket."""
    hi, lo = ("prev_day_high", "prev_day_low") if trigger == "hod" else ("prev_ext_high", "prev_ext_low")
    b = in_sessions(i.bars, "rth") if trigger == "hod" else i.day_bars
    return emit(b, event(F.col("high") > F.col(hi), trigger, "high", "long", F.col("high"), 1),
                event(F.col("low") < F.col(lo), trigger, "low", "short", F.col("low"), 1))


def hod_breakout(i: Inputs) -> DataFrame:
    """Plain breakout: the value is the distance beyond the earlier extreme."""
    b = in_sessions(i.bars, "rth")
    return emit(b, event(F.col("high") > F.col("prev_day_high"), "hod_breakout", "long", "long",
                      F.col("high") - F.col("prev_day_high"), 1),
                event(F.col("low") < F.col("prev_day_low"), "hod_breakout", "short", "short",
                      F.col("prev_day_low") - F.col("low"), 1))


def first_breach(i: Inputs, trigger: str, hi_level: str, lo_level: str, extended: bool = False) -> DataFrame:
    """First trade of the day beyond a level; silent when earlier bars already went through it."""
    b = i.day_bars if extended else in_sessions(i.bars, "rth")
    p = "prev_ext" if extended else "prev_day"
    up = (F.col("high") > F.col(hi_level)) & F.coalesce(F.col(f"{p}_high") <= F.col(hi_level), F.lit(True))
    dn = (F.col("low") < F.col(lo_level)) & F.coalesce(F.col(f"{p}_low") >= F.col(lo_level), F.lit(True))
    return emit(b, event(up, trigger, "high", "long", F.col(hi_level), 1),
                event(dn, trigger, "low", "short", F.col(lo_level), 1))


def n_day_breach(i: Inputs, days: int = 60) -> DataFrame:
    """First trade of the day beyond the high or low of the last ``days`` sessions."""
    levels = da.n_day_levels(i.daily, days)
    bars = i.bars.drop("n_day_high", "n_day_low").join(levels, DAY, "left")
    return first_breach(Inputs(bars, i.candles), "hi_lo_60d", "n_day_high", "n_day_low")


def candle_atr(i: Inputs, tf: int, n: int = 20) -> DataFrame:
    return ind.atr(i.covered(tf), SERIES, "cpos", {"atr": n})


def with_asof(i: Inputs, values: DataFrame, cols: list[str], tf: int, pos: str = "cpos", before: str = "cbefore") -> DataFrame:
    """Bars with ``cols`` of the newest completed ``tf`` candle and the key of the candle being formed."""
    cur = co.asof_candle(i.candles.where(F.col("tf") == tf), values, cols, pos, before)
    return co.bars_with_candle(i.day_bars, cur, tf)


def _near(b: DataFrame, hi: str, lo: str, names: tuple[str, str], option, tf: int) -> DataFrame:
    """Closing within one ATR inside a level without touching it."""
    up, dn, atr = F.col(hi) - F.col("close"), F.col("close") - F.col(lo), F.col("atr")
    e = edges(b, {"_up": F.when((atr > 0) & F.col(hi).isNotNull(), (up > 0) & (up < atr) & (F.col("high") <= F.col(hi))),
                  "_dn": F.when((atr > 0) & F.col(lo).isNotNull(), (dn > 0) & (dn < atr) & (F.col("low") >= F.col(lo)))})
    opts = ("high", "low") if option is None else (option, option)
    return emit(e, event(F.col("_up"), names[0], opts[0], "long", up, tf), event(F.col("_dn"), names[1], opts[1], "short", dn, tf))


def near_hod(i: Inputs) -> DataFrame:
    b = in_sessions(with_asof(i, candle_atr(i, 1), ["atr"], 1), "rth")
    return _near(b, "prev_day_high", "prev_day_low", ("near_hod", "near_hod"), None, 1)


def pct_change(i: Inputs, pct: float = 5.0) -> DataFrame:
    ref = F.col("prior_close")
    cur, prev = (F.col("close") / ref - 1) * 100.0, (F.col("prev_close") / ref - 1) * 100.0
    ok = (ref != 0) & F.col("prev_close").isNotNull()
    return emit(i.day_bars, event(ok & (prev < pct) & (cur >= pct), "pct_change", "up", "long", cur, 1),
                event(ok & (prev > -pct) & (cur <= -pct), "pct_change", "down", "short", cur, 1))


def gap(i: Inputs, min_pct: float = 2.0) -> DataFrame:
    g = F.try_divide(F.col("session_open"), F.col("prior_close"))
    b = once(in_sessions(i.bars, "rth")).withColumn("g", (g - 1) * 100.0)
    return emit(b, event(F.col("g") >= min_pct, "gap", "up", "long", F.col("g"), 1),
                event(F.col("g") <= -min_pct, "gap", "down", "short", F.col("g"), 1))


def rvol_cross(bars_rvol: DataFrame, threshold: float = 2.0) -> DataFrame:
    b = in_sessions(bars_rvol, "rth")
    return fires(edge(b, F.col("rvol") >= threshold), F.lit(True), "rvol_cross", "", "neutral", F.col("rvol"), 1)


def per_minute(bench: DataFrame, cols: list[str]) -> DataFrame:
    """Benchmark columns on every minute until its next bar, so 'latest at this bar' is an equi-join on (date, minute)."""
    w = W.partitionBy("et_date").orderBy("et_min")
    until = F.coalesce(F.lead("et_min").over(w) - 1, F.lit(clock.POST_CLOSE))
    return (bench.select("et_date", "et_min", until.alias("_to"), *[F.col(c).alias(f"bench_{c}") for c in cols])
                 .withColumn("et_min", F.explode(F.sequence("et_min", "_to"))).drop("_to"))


def rs_benchmark(i: Inputs, benchmark: str, pct: float = 0.5) -> DataFrame:
    b = in_sessions(i.bars, "rth")
    bench = per_minute(b.where(F.col("symbol") == benchmark), ["mom_15m_pct"])
    j = b.join(bench, ["et_date", "et_min"], "left").withColumn("rs", F.col("mom_15m_pct") - F.col("bench_mom_15m_pct"))
    e = edges(j, {"_up": F.col("rs") >= pct, "_dn": F.col("rs") <= -pct})
    return emit(e, event(F.col("_up"), "rs_spy", "strong", "long", F.col("rs"), 1), event(F.col("_dn"), "rs_spy", "weak", "short", F.col("rs"), 1))


def momentum_burst(i: Inputs, mult: float = 0.25, close_pct: float = 70.0) -> DataFrame:
    b = in_sessions(i.bars, "rth").withColumn("rng", F.col("high") - F.col("low"))
    big = (F.col("rng") > 0) & (F.col("atr_d1") != 0) & (F.col("rng") >= F.col("atr_d1") * mult)
    pos = F.try_divide(F.col("close") - F.col("low"), F.col("rng"))
    v = F.try_divide(F.col("rng"), F.col("atr_d1"))
    return emit(b, event(big & (F.col("close") >= F.col("open")) & (pos >= close_pct / 100), "momentum_burst", "up", "long", v, 1),
                event(big & (F.col("close") <= F.col("open")) & (1 - pos >= close_pct / 100), "momentum_burst", "down", "short", v, 1))


def running(i: Inputs, min_pct: float = 0.5, unit: str = "pct") -> DataFrame:
    """One-minute move in percent, in daily ATRs, or in average ranges of the last 20 one-minute candles."""
    move = F.col("close") - F.col("prev_close")
    if unit == "pct":
        b = i.day_bars.withColumn("chg", F.try_divide(move, F.col("prev_close")) * 100.0)
    elif unit == "atr":
        b = i.day_bars.withColumn("chg", F.when(F.col("atr_d1") > 0, F.try_divide(move, F.col("atr_d1"))))
    else:
        def cols(w):
            last20, ring = w.rowsBetween(-19, 0), w.rowsBetween(-127, 0)
            rng = F.col("high") - F.col("low")
            return {"base": F.when(co.last_n_ok(w, 20), F.avg(rng).over(last20))
                             .when(F.count(F.lit(1)).over(ring) >= 10, F.avg(rng).over(ring))}
        base = co.recent(i.covered(1), 127, cols)
        b = with_asof(i, base, ["base"], 1).withColumn("chg", F.when(F.col("base") > 0, move / F.col("base")))
    b = b.where(F.col("prev_close") != 0)
    name = "running"
    return emit(b, event(F.col("chg") >= min_pct, name, "up", "long", F.col("chg"), 1),
                event(F.col("chg") <= -min_pct, name, "down", "short", F.col("chg"), 1))


def through_vwap(i: Inputs, mult: float = 3.0) -> DataFrame:
    w = W.partitionBy(*DAY, "session").orderBy("et_min")
    rng = F.col("high") - F.col("low")
    prior = w.rowsBetween(-10, -1)
    b = i.bars.withColumn("avg_rng", F.when(F.count(F.lit(1)).over(prior) == 10, F.avg(rng).over(prior))).where("session = 'rth'")
    big = (F.col("avg_rng") > 0) & (rng >= F.col("avg_rng") * mult)
    v = F.try_divide(rng, F.col("avg_rng"))
    return emit(b, event(cross(F.col("vwap"), True) & big, "through_vwap", "above", "long", v, 1),
                event(cross(F.col("vwap"), False) & big, "through_vwap", "below", "short", v, 1))


# ---- bars against the newest completed candle ----------------------------------------------------------------------------

def swing_levels(i: Inputs, tf: int, n: int) -> DataFrame:
    def cols(w):
        ok, b = co.last_n_ok(w, n), w.rowsBetween(-(n - 1), 0)
        return {"swing_high": F.when(ok, F.max("high").over(b)), "swing_low": F.when(ok, F.min("low").over(b))}
    return co.recent(i.covered(tf), max(n - 1, 1), cols)


def new_candle_extreme(i: Inputs, tf: int, since: int = 1) -> DataFrame:
    hi, lo = F.col("swing_high"), F.col("swing_low")
    b = with_asof(i, swing_levels(i, tf, since), ["swing_high", "swing_low"], tf)
    b = firsts(b, {"_up": F.col("high") > hi, "_dn": F.col("low") < lo}, "key_session", "slot")
    return emit(b, event(F.col("_up"), "new_candle_high", str(tf), "long", hi, tf), event(F.col("_dn"), "new_candle_low", str(tf), "short", lo, tf))


def break_recent(i: Inputs, tf: int, lookback: int = 5) -> DataFrame:
    hi, lo = F.col("swing_high"), F.col("swing_low")
    b = with_asof(i, swing_levels(i, tf, lookback), ["swing_high", "swing_low"], tf)
    b = firsts(b, {"_up": cross(hi, True), "_dn": cross(lo, False)}, "key_session", "slot")
    return emit(b, event(F.col("_up"), "break_recent_high", str(tf), "long", hi, tf), event(F.col("_dn"), "break_recent_low", str(tf), "short", lo, tf))


def near_last(i: Inputs, tf: int, lookback: int = 5) -> DataFrame:
    lv = ind.atr(swing_levels(i, tf, lookback), SERIES, "cpos", {"atr": 20})
    b = with_asof(i, lv, ["swing_high", "swing_low", "atr"], tf)
    return _near(b, "swing_high", "swing_low", ("near_last_high", "near_last_low"), str(tf), tf)


def opening_range_break(i: Inputs, tf: int) -> DataFrame:
    first = (i.covered(tf).where("key_session = 'rth' and slot = 0")
              .select(*DAY, F.col("high").alias("or_high"), F.col("low").alias("or_low")))
    b = in_sessions(i.bars, "rth").where(F.col("et_min") >= clock.RTH_OPEN + tf).join(first, DAY)
    b = firsts(b, {"_up": cross(F.col("or_high"), True), "_dn": cross(F.col("or_low"), False)})
    return emit(b, event(F.col("_up"), "orb_breakout", str(tf), "long", F.col("or_high"), tf), event(F.col("_dn"), "orb_breakdown", str(tf), "short", F.col("or_low"), tf))


def candle_emas(i: Inputs, tf: int, periods: list[int]) -> DataFrame:
    """Tracked EMAs: covered candles that started in the regular session."""
    r = i.covered(tf).where("rpos is not null")
    return ind.ema(r, SERIES, "rpos", {f"ema{p}": p for p in periods})


def back_to_ema(i: Inputs, tf: int, period: int, away_pct: float = 0.5, n: int = 5) -> DataFrame:
    e, a = F.col(f"ema{period}"), away_pct / 100.0

    def cols(w):
        b = w.rowsBetween(-(n - 1), 0)
        ok = F.count(f"ema{period}").over(b) == n
        return {"above": ok & (F.min((F.col("low") > e * (1 + a)).cast("int")).over(b) == 1),
                "below": ok & (F.min((F.col("high") < e * (1 - a)).cast("int")).over(b) == 1)}
    c = rolling(candle_emas(i, tf, [period]), SERIES, "rpos", max(n - 1, 1), cols)
    b = with_asof(i, c, [f"ema{period}", "above", "below"], tf, "rpos", "rbefore")
    b = firsts(b, {"_up": F.col("above") & (F.col("low") <= e) & (e <= F.col("close")),
                   "_dn": F.col("below") & (F.col("high") >= e) & (e >= F.col("close"))}, "key_session", "slot")
    opt = f"ema{period}_{tf}"
    return emit(b, event(F.col("_up"), "back_to_ema", opt, "long", e, tf), event(F.col("_dn"), "back_to_ema", opt, "short", e, tf))


def ema_cross_ema(i: Inputs, tf: int = 1, fast: int = 3, slow: int = 9) -> DataFrame:
    """Crosses of a fast EMA through a slower one; a pair that is not fast and slow never fires."""
    if fast >= slow:
        return fires(i.bars.limit(0), F.lit(False), "ema_cross_ema", "up", "long", F.lit(None), tf)
    b = with_asof(i, candle_emas(i, tf, [fast, slow]), [f"ema{fast}", f"ema{slow}"], tf, "rpos", "rbefore")
    f, s = F.col(f"ema{fast}"), F.col(f"ema{slow}")
    b = edges(b, {"_up": f > s, "_dn": f < s})
    return emit(b, event(F.col("_up"), "ema_cross_ema", "up", "long", f, tf), event(F.col("_dn"), "ema_cross_ema", "down", "short", f, tf))


def range_break(i: Inputs, tf: int = 5, n: int = 5, width: float = 1.5, unit: str = "pct", vol_mult: float = 1.5) -> DataFrame:
    """Close outside a tight range of the last ``n`` session candles on volume; re-arms when price is back inside."""
    keys = [*DAY, "tf", "key_session"]
    w = W.partitionBy(*keys).orderBy("slot")
    b = w.rowsBetween(-(n - 1), 0)
    base = w.rowsBetween(-(n + 19), -n)
    rng = F.avg(F.col("high") - F.col("low")).over(base)
    c = i.covered(tf).withColumns({
        "r_hi": F.max("high").over(b), "r_lo": F.min("low").over(b), "r_n": F.count(F.lit(1)).over(b),
        "r_vol": F.avg("volume").over(b) / tf, "r_base": F.when(F.count(F.lit(1)).over(base) >= 10, rng)})
    rows = i.candles.where(F.col("tf") == tf).select(*keys, "slot")
    st = c.where(F.col("r_n") == n).select(*keys, "slot", F.struct("r_hi", "r_lo", "r_vol", "r_base").alias("r"))
    before = w.rowsBetween(W.unboundedPreceding, -1)
    cur = rows.join(st, [*keys, "slot"], "left").withColumn("r", F.last("r", ignorenulls=True).over(before))
    x = co.bars_with_candle(i.bars, cur, tf).where("session = key_session").select("*", "r.*")
    hi, lo = F.col("r_hi"), F.col("r_lo")
    limit = {"pct": (hi + lo) / 2 * (width / 100.0), "atr": F.when(F.col("atr_d1") > 0, F.col("atr_d1") * width),
             "candle": F.when(F.col("r_base") > 0, F.col("r_base") * width)}[unit]
    tight = (hi + lo > 0) & (hi - lo <= limit)
    strong = (F.col("r_vol") > 0) & (F.col("volume") >= F.col("r_vol") * vol_mult)

    def turned(outside):
        return F.when(tight & ~outside, False).when(tight & outside & strong, True)
    x = edges(x, {"_up": turned(F.col("close") > hi), "_dn": turned(F.col("close") < lo)})
    return emit(x, event(F.col("_up"), "range_break", "up", "long", hi, tf), event(F.col("_dn"), "range_break", "down", "short", lo, tf))


# ---- completed candles, seen by the next bar of the date ------------------------------------------------------------------

def completed(df: DataFrame, *sessions: str) -> DataFrame:
    """Candle rows stamped with the bar that closes them; the session gate is that bar's session."""
    d = df.where("done_min is not null").withColumn("et_min", F.col("done_min")).withColumn("session", F.col("done_session"))
    return d.where(F.col("session").isin(*(sessions or ("pre", "rth"))))


def candle_close(i: Inputs, *tfs: int) -> DataFrame:
    d = completed(i.covered(*tfs))
    opt = F.col("tf")
    return emit(d, event(F.col("close") > F.col("open"), "bull_candle_close", opt, "long", F.col("close")),
                event(F.col("close") < F.col("open"), "bear_candle_close", opt, "short", F.col("close")))


def session_lags(df: DataFrame, back: int, cols=("open", "high", "low", "close")) -> DataFrame:
    w = W.partitionBy(*DAY, "tf", "key_session").orderBy("slot")
    return df.withColumns({f"{c}{k}": F.lag(c, k).over(w) for k in range(1, back + 1) for c in cols})


def pair_patterns(i: Inputs, *tfs: int) -> DataFrame:
    """Engulfing, harami and inside patterns of two or three candles of one date and session."""
    c = completed(session_lags(i.covered(*tfs), 2)).where("session = key_session")
    o, h, l, x = (F.col(k) for k in ("open", "high", "low", "close"))
    po, ph, pl, px = (F.col(k) for k in ("open1", "high1", "low1", "close1"))
    body, pbody = F.abs(x - o), F.abs(px - po)
    red_green, green_red = (px < po) & (x > o), (px > po) & (x < o)
    inside, pinside = (h < ph) & (l > pl), (ph < F.col("high2")) & (pl > F.col("low2"))
    opt, wide = F.col("tf"), F.col("tf").isin(5, 15, 30, 60)
    return emit(c, event(red_green & (o <= px) & (x >= po) & (body > pbody), "bull_engulfing", opt, "long", x),
                event(green_red & (o >= px) & (x <= po) & (body > pbody), "bear_engulfing", opt, "short", x),
                event(red_green & (o >= px) & (x <= po) & (body < pbody), "bull_harami", opt, "long", x),
                event(green_red & (o <= px) & (x >= po) & (body < pbody), "bear_harami", opt, "short", x),
                event(wide & inside, "inside_bar", opt, "neutral", h - l),
                event(wide & inside & pinside, "double_inside_bar", opt, "neutral", h - l))


def single_patterns(i: Inputs, *tfs: int, body_pct: float = 10.0, ratio: float = 2.0) -> DataFrame:
    c = completed(i.covered(*tfs))
    o, h, l, x = (F.col(k) for k in ("open", "high", "low", "close"))
    body, rng = F.abs(x - o), h - l
    up, dn = h - F.greatest(o, x), F.least(o, x) - l
    opt, b = F.col("tf"), F.greatest(body, F.lit(1e-9))
    return emit(c, event((rng > 0) & (F.try_divide(body, rng) * 100 <= body_pct), "doji", opt, "neutral", F.try_divide(body, rng) * 100),
                event((up > 0) & (up / b >= ratio), "upper_shadow", opt, "short", up / b),
                event((dn > 0) & (dn / b >= ratio), "lower_shadow", opt, "long", dn / b))


def reject_last(i: Inputs, *tfs: int, lookback: int = 5) -> DataFrame:
    def cols(w):
        ok, prior = co.last_n_ok(w, lookback + 1), w.rowsBetween(-lookback, -1)
        return {"lvl_hi": F.when(ok, F.max("high").over(prior)), "lvl_lo": F.when(ok, F.min("low").over(prior))}
    c = completed(co.recent(i.covered(*tfs), lookback, cols), "rth")
    hi, lo, x, o = F.col("lvl_hi"), F.col("lvl_lo"), F.col("close"), F.col("open")
    return emit(c, event((F.col("high") >= hi) & (x < hi) & (x < o), "reject_last_high", F.col("tf"), "short", hi),
                event((F.col("low") <= lo) & (x > lo) & (x > o), "reject_last_low", F.col("tf"), "long", lo))


def volume_spike(i: Inputs, *tfs: int, ratio: float = 2.0, lookback: int = 10) -> DataFrame:
    def cols(w):
        avg = F.avg("volume").over(w.rowsBetween(-lookback, -1))
        return {"ratio": F.when(co.last_n_ok(w, lookback + 1) & (avg > 0), F.col("volume") / avg)}
    c = completed(co.recent(i.covered(*tfs), lookback, cols))
    return fires(c, F.col("ratio") >= ratio, "volume_spike", F.col("tf"), "neutral", F.col("ratio"))


def consec_candles(streaks: DataFrame, count: int = 3) -> DataFrame:
    """``streaks``: completed candles with a signed ``streak`` (see the indicator)."""
    d = completed(streaks)
    run = F.when(F.col("session") == F.col("key_session"), F.col("streak")).otherwise(0)
    d = edges(d, {"_up": run >= count, "_dn": run <= -count})
    return emit(d, event(F.col("_up"), "consec_candles", "green", "long", float(count)), event(F.col("_dn"), "consec_candles", "red", "short", float(count)))


def candle_level_cross(i: Inputs, tf: int, level: str = "vwap", name: str | None = None) -> DataFrame:
    """Two consecutive completed candles of one day on either side of a level (VWAP: each candle's own)."""
    c = co.recent(i.covered(tf), 1, lambda w: {
        "ok2": co.last_n_ok(w, 2), "pdate": F.lag("et_date").over(w), "pc": F.lag("close").over(w), "pv": F.lag("vwap").over(w)})
    c = completed(c).where("ok2 and pdate = et_date")
    if level == "vwap":
        lp, lc = F.col("pv"), F.col("vwap")
    else:
        now = i.bars.select(*DAY, "et_min", F.col(level).alias("_lvl"))
        c = c.join(now, [*DAY, "et_min"])
        lp = lc = F.col("_lvl")
    x = F.col("close")
    return emit(c, event((F.col("pc") <= lp) & (x > lc), "cross_above", name or level, "long", lc),
                event((F.col("pc") >= lp) & (x < lc), "cross_below", name or level, "short", lc))


# level option -> column of the bar table
BAR_LEVELS = {"open": "session_open", "prior_close": "prior_close", "vwap": "vwap", "ema9_d": "ema9_d", "ema21_d": "ema21_d",
              "ema50_d": "ema50_d", "sma50_d": "sma50_d", "sma100_d": "sma100_d", "sma200_d": "sma200_d", "pm_high": "pm_high",
              "pm_low": "pm_low", "prior_high": "prior_high", "prior_low": "prior_low"}
EMA_LEVELS = {"ema20_2": (2, 20), "ema9_5": (5, 9), "ema21_5": (5, 21), "ema9_15": (15, 9), "ema21_15": (15, 21),
              "ema9_60": (60, 9), "ema21_60": (60, 21)}


def with_ema_levels(i: Inputs, names=tuple(EMA_LEVELS)) -> DataFrame:
    """Bars with the value each intraday EMA level had at that bar: one recurrence for all timeframes, pivoted back per bar."""
    tfs = sorted({EMA_LEVELS[n][0] for n in names})
    cols = {f"ema{EMA_LEVELS[n][1]}": EMA_LEVELS[n][1] for n in names}
    e = ind.ema(i.covered(*tfs).where("rpos is not null"), SERIES, "rpos", cols)
    cur = co.asof_candle(i.candles.where(F.col("tf").isin(*tfs)), e, list(cols), "rpos", "rbefore")
    m = F.col("et_min")
    keyed = (i.day_bars.select(*DAY, "et_min", F.explode(F.array(*[F.lit(t) for t in tfs])).alias("tf"))
                       .withColumn("key_session", clock.key_session(m)).withColumn("slot", clock.candle_slot(m, F.col("tf"))))
    per_bar = keyed.join(cur, [*DAY, "tf", "key_session", "slot"]).groupBy(*DAY, "et_min").agg(*[
        F.max(F.when(F.col("tf") == EMA_LEVELS[n][0], F.col(f"ema{EMA_LEVELS[n][1]}"))).alias(n) for n in names])
    return i.day_bars.join(per_bar, [*DAY, "et_min"], "left")


def level_long(bars_with_levels: DataFrame) -> DataFrame:
    """Long form (level, price): one row per bar and level that has a price."""
    names = [*BAR_LEVELS, *EMA_LEVELS]
    pairs = ", ".join(f"'{n}', {BAR_LEVELS.get(n, n)}" for n in names)
    return bars_with_levels.select(*DAY, "et_min", "session", "close", "prev_close", F.expr(
        f"stack({len(names)}, {pairs}) as (level, price)")).where("price is not null")


def level_cross(bars_with_levels: DataFrame, levels=(*BAR_LEVELS, *EMA_LEVELS)) -> DataFrame:
    """Every level is tested on its own column; only the crossed ones become rows."""
    events = []
    for name in levels:
        c = F.col(BAR_LEVELS.get(name, name))
        events += [event(cross(c, True), "cross_above", name, "long", c, 1), event(cross(c, False), "cross_below", name, "short", c, 1)]
    return emit(bars_with_levels, *events)


def vwap_cross_confirmed(i: Inputs, *tfs: int) -> DataFrame:
    w = W.partitionBy(*DAY, "tf", "key_session").orderBy("slot")
    d = F.col("close") - F.col("vwap")
    c = i.covered(*tfs).withColumns({"d0": d, "d1": F.lag(d, 1).over(w), "d2": F.lag(d, 2).over(w), "s2": F.lag("slot", 2).over(w)})
    c = completed(c, "rth").where("session = key_session and s2 = slot - 2")
    d0, d1, d2 = F.col("d0"), F.col("d1"), F.col("d2")
    return emit(c, event((d2 <= 0) & (d1 > 0) & (d0 > 0), "vwap_cross_confirmed", "above", "long", F.col("vwap")),
                event((d2 >= 0) & (d1 < 0) & (d0 < 0), "vwap_cross_confirmed", "below", "short", F.col("vwap")))


def vwap_hold_touch(i: Inputs, *tfs: int, tol: float = 3.0, atr_unit: bool = True) -> DataFrame:
    """Support / resistance: the candle before closed beyond its VWAP, this one touches VWAP and closes back in colour."""
    c = co.recent(i.covered(*tfs), 1, lambda w: {"ok2": co.last_n_ok(w, 2), "pc": F.lag("close").over(w), "pv": F.lag("vwap").over(w)})
    c = completed(c, "rth").where("ok2")
    v, x = F.col("vwap"), F.col("close")
    if atr_unit:
        c = c.join(i.bars.select(*DAY, "et_min", "atr_d1"), [*DAY, "et_min"]).where("atr_d1 > 0")
        t = F.col("atr_d1") * tol / 100.0
    else:
        t = v * tol / 100.0
    return emit(c, event((F.col("pc") > F.col("pv")) & F.col("low").between(v - t, v + t) & (x > v) & (x > F.col("open")),
              "vwap_support", F.col("tf"), "long", v),
                event((F.col("pc") < F.col("pv")) & F.col("high").between(v - t, v + t) & (x < v) & (x < F.col("open")),
              "vwap_resistance", F.col("tf"), "short", v))


def vwap_v(i: Inputs, tf: int = 5, n: int = 6, away: float = 0.3, band: float = 0.1, dwell: int = 1) -> DataFrame:
    w = W.partitionBy(*DAY, "tf", "key_session").orderBy("slot")
    c = i.covered(tf).join(i.bars.select(*DAY, F.col("et_min").alias("done_min"), "atr_d1"), [*DAY, "done_min"])
    prior, full = w.rowsBetween(-(n - 1), -1), w.rowsBetween(-(n - 1), 0)
    off, a = F.col("close") - F.col("vwap"), F.col("atr_d1")
    c = c.withColumns({
        "far_up": F.max(off).over(prior), "far_dn": F.max(-off).over(prior),
        "near": F.sum((F.abs(off) <= a * band).cast("int")).over(prior), "n": F.count("vwap").over(full)})
    c = completed(c).where(f"session = key_session and n = {n} and atr_d1 > 0 and near <= {dwell} and high > low")
    v, x, rng = F.col("vwap"), F.col("close"), F.col("high") - F.col("low")
    b = a * band
    return emit(c, event((F.col("far_up") >= a * away) & (F.col("low") <= v + b) & (x >= v + b) & (x > F.col("open"))
              & (x - F.col("low") >= rng * 0.6), "vwap_v", "support", "long", v),
                event((F.col("far_dn") >= a * away) & (F.col("high") >= v - b) & (x <= v - b) & (x < F.col("open"))
              & (F.col("high") - x >= rng * 0.6), "vwap_v", "resistance", "short", v))


# Study trigger -> (study column, default crossing level).
STUDY_CROSSES = {"ta_macd_hist_cross": ("macd_hist", 0.0), "ta_rsi_cross": ("rsi", 50.0), "ta_stoch_k_cross": ("stoch_k", 80.0),
                 "ta_cci_cross": ("cci", 100.0), "ta_bb_percent_b_cross": ("bb_percent_b", 1.0), "ta_adx_cross": ("adx", 25.0)}


def study_cross(study_candles: DataFrame, trigger: str, level: float | None = None) -> DataFrame:
    """A study value of the completed candle crosses a level (``study_candles`` carries the study columns)."""
    col, default = STUDY_CROSSES[trigger]
    level = default if level is None else level
    c = rolling(study_candles, SERIES, "cpos", 1, lambda w: {"before": F.lag(col).over(w)})
    c = completed(c, "rth")
    b, a = F.col("before"), F.col(col)
    return emit(c, event((b <= level) & (a > level), trigger, "up", "long", a),
                event((b >= level) & (a < level), trigger, "down", "short", a))


def failed_swing(i: Inputs, tf: int, lookback: int = 20, max_wait: int = 3, min_break_pct: float = 0.1) -> DataFrame:
    """A close beyond a frozen swing that returns within ``max_wait`` candles; a gap or session change cancels.

    The pending break depends on earlier outcomes, so the candles of a (symbol, date) are folded in order, streaming over sorted
    partitions.
    """
    w = W.partitionBy(*DAY, "tf", "key_session").orderBy("slot")
    b = w.rowsBetween(-lookback, -1)
    allw = W.partitionBy(*DAY, "tf").orderBy("start_min").rowsBetween(W.unboundedPreceding, 0)
    c = i.candles.where((F.col("tf") == tf) & F.col("done_min").isNotNull())
    c = c.withColumn("gaps", F.sum((~F.col("covered")).cast("int")).over(allw)).where("covered")
    prev_ok = (F.count(F.lit(1)).over(b) == lookback) & (F.col("slot") - F.min("slot").over(b) == lookback)
    c = c.withColumns({"lvl_hi": F.when(prev_ok, F.max("high").over(b)), "lvl_lo": F.when(prev_ok, F.min("low").over(b))})
    c = completed(c, "rth")

    def step(pending, r):
        out = []
        for side, sign, level in (("high", 1.0, r["lvl_hi"]), ("low", -1.0, r["lvl_lo"])):
            frozen = pending.get(side)
            if frozen is not None:
                expired = r["key_session"] != frozen["sess"] or r["slot"] - frozen["slot"] > max_wait or r["gaps"] != frozen["gaps"]
                if not expired:
                    if sign * (r["close"] - frozen["level"]) < 0:
                        out.append((r["symbol"], r["et_date"], r["et_min"], side, frozen["level"]))
                        pending[side] = None
                    continue
                pending[side] = None
            if level is not None and level == level and sign * (r["close"] - (level + sign * level * min_break_pct / 100)) > 0:
                pending[side] = {"level": level, "slot": r["slot"], "sess": r["key_session"], "gaps": r["gaps"]}
        return out
    f = fold_sorted(c.select(*DAY, "et_min", "key_session", "slot", "gaps", "close", "lvl_hi", "lvl_lo"), DAY, ["et_min"], dict, step, lambda st, key: [],
                    "symbol string, et_date date, et_min int, side string, level double")
    f = f.withColumn("session", F.lit("rth"))
    return emit(f, event(F.col("side") == "high", "failed_swing_high", str(tf), "short", F.col("level"), tf),
                event(F.col("side") == "low", "failed_swing_low", str(tf), "long", F.col("level"), tf))


def extreme_events(i: Inputs, benchmark: str) -> DataFrame:
    """HOD/LOD event stream: strictly new regular-session extremes after the first bar, numbered per date."""
    b = in_sessions(i.bars, "rth").where(F.col("symbol") != benchmark)
    kind = lambda cond, name, price: F.when(cond, F.struct(F.lit(name).alias("type"), F.col(price).alias("price")))
    e = b.select(*DAY, "et_min", F.inline(F.array_compact(F.array(kind(F.col("high") > F.col("prev_day_high"), "HOD", "high"),
                                                                  kind(F.col("low") < F.col("prev_day_low"), "LOD", "low")))))
    # numbered minute by minute: the counts of the earlier minutes of a date are at most 960 rows
    n = e.groupBy("et_date", "et_min").count()
    off = n.select("et_date", "et_min", F.coalesce(F.sum("count").over(
        W.partitionBy("et_date").orderBy("et_min").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    inside = F.row_number().over(W.partitionBy("et_date", "et_min").orderBy("symbol", "type"))
    return e.withColumn("_i", inside).join(off, ["et_date", "et_min"]).withColumn("seq", F.col("_off") + F.col("_i")).drop("_i", "_off")


def external_fires(external: DataFrame, detectors: list[DataFrame]) -> DataFrame:
    """System fires of another producer, passed through next to the native ones."""
    return both(external.select(*FIRE), *detectors)


def members_only(events: DataFrame, members: DataFrame | None) -> DataFrame:
    """Rows of listed symbols; an unresolved list (None) lets everything pass."""
    return events if members is None else events.join(members, "symbol", "left_semi")

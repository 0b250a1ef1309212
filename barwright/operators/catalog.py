"""Detectors and condition values by id, so that rule documents can be run as they are written.

``trigger`` and ``condition`` register further ones: a trigger is ``fn(inputs, option, params) -> fires``, a condition is
``fn(inputs, bars, option, params) -> bars with a column v``.
"""
from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from . import candles as co
from . import conditions as cd
from . import indicators as ind
from . import quotes as qt
from . import relative as rel
from . import state as st
from . import triggers as tr

TRIGGERS: dict[str, Callable] = {}
CONDITIONS: dict[str, Callable] = {}


def trigger(*ids: str):
    def deco(fn):
        TRIGGERS.update(dict.fromkeys(ids, fn))
        return fn
    return deco


def condition(*ids: str):
    def deco(fn):
        CONDITIONS.update(dict.fromkeys(ids, fn))
        return fn
    return deco


def _i(p, key, default):
    return int(p.get(key, default))


def _f(p, key, default):
    return float(p.get(key, default))


_UNITS = {0: "pct", 1: "atr", 2: "candle"}
trigger("hod")(lambda i, o, p: tr.new_extreme(i, "hod"))
trigger("hod_ext")(lambda i, o, p: tr.new_extreme(i, "hod_ext"))
trigger("near_hod")(lambda i, o, p: tr.near_hod(i))
trigger("hi_lo_60d")(lambda i, o, p: tr.n_day_breach(i, _i(p, "days", 60)))
trigger("hi_lo_52w")(lambda i, o, p: tr.first_breach(i, "hi_lo_52w", "hi_52w", "lo_52w"))
trigger("prior_day_break")(lambda i, o, p: tr.first_breach(i, "prior_day_break", "prior_high", "prior_low", extended=True))
trigger("pm_break")(lambda i, o, p: tr.first_breach(i, "pm_break", "pm_high", "pm_low"))
trigger("new_candle_high", "new_candle_low")(lambda i, o, p: tr.new_candle_extreme(i, int(o), _i(p, "since", 1)))
trigger("break_recent_high", "break_recent_low")(lambda i, o, p: tr.break_recent(i, int(o), _i(p, "lookback", 5)))
trigger("near_last_high", "near_last_low")(lambda i, o, p: tr.near_last(i, int(o), _i(p, "lookback", 5)))
trigger("reject_last_high", "reject_last_low")(lambda i, o, p: tr.reject_last(i, int(o), lookback=_i(p, "lookback", 5)))
trigger("failed_swing_high", "failed_swing_low")(lambda i, o, p: tr.failed_swing(i, int(o), _i(p, "lookback", 20), _i(p, "max_wait", 3), _f(p, "min_break_pct", 0.1)))
trigger("orb_breakout", "orb_breakdown")(lambda i, o, p: tr.opening_range_break(i, int(o)))
trigger("bull_candle_close", "bear_candle_close")(lambda i, o, p: tr.candle_close(i, int(o)))
trigger("bull_engulfing", "bear_engulfing", "bull_harami", "bear_harami", "inside_bar", "double_inside_bar")(lambda i, o, p: tr.pair_patterns(i, int(o)))
trigger("doji", "upper_shadow", "lower_shadow")(lambda i, o, p: tr.single_patterns(i, int(o), body_pct=_f(p, "body_pct", 10), ratio=_f(p, "ratio", 2)))
trigger("volume_spike")(lambda i, o, p: tr.volume_spike(i, int(o), ratio=_f(p, "ratio", 2), lookback=_i(p, "lookback", 10)))
trigger("vwap_cross_confirmed")(lambda i, o, p: tr.vwap_cross_confirmed(i, _i(p, "tf", 1)))
trigger("through_vwap")(lambda i, o, p: tr.through_vwap(i, _f(p, "mult", 3)))
trigger("vwap_support", "vwap_resistance")(lambda i, o, p: tr.vwap_hold_touch(i, int(o), tol=_f(p, "tol_pct", 3), atr_unit=_i(p, "tol_unit", 1) == 1))
trigger("vwap_v")(lambda i, o, p: tr.vwap_v(i, _i(p, "tf", 5), _i(p, "lookback", 6), _f(p, "away_atr", 0.3), _f(p, "band_atr", 0.1), _i(p, "max_dwell", 1)))
trigger("range_break")(lambda i, o, p: tr.range_break(i, _i(p, "tf", 5), _i(p, "bars", 5), _f(p, "max_range_pct", 1.5), _UNITS[_i(p, "width_unit", 0)], _f(p, "vol_mult", 1.5)))
trigger("ema_cross_ema")(lambda i, o, p: tr.ema_cross_ema(i, _i(p, "tf", 1), _i(p, "fast", 3), _i(p, "slow", 9)))
trigger("running")(lambda i, o, p: tr.running(i, _f(p, "min_pct", 0.5), _UNITS[_i(p, "width_unit", 0)]))
trigger("pct_change")(lambda i, o, p: tr.pct_change(i, _f(p, "pct", 5)))
trigger("gap")(lambda i, o, p: tr.gap(i, _f(p, "min_pct", 2)))
trigger("rvol_cross")(lambda i, o, p: tr.rvol_cross(i.bars, _f(p, "threshold", 2)))
trigger("rs_spy")(lambda i, o, p: tr.rs_benchmark(i, p.get("benchmark", "SPY"), _f(p, "pct", 0.5)))
trigger("momentum_burst")(lambda i, o, p: tr.momentum_burst(i, _f(p, "range_mult", 0.25), _f(p, "close_pct", 70)))


@trigger("consec_candles")
def _(i, o, p):
    return tr.consec_candles(streaks(i.covered(_i(p, "tf", 5))), _i(p, "count", 3))


@trigger("back_to_ema")
def _(i, o, p):
    period, tf = o[3:].split("_")
    return tr.back_to_ema(i, int(tf), int(period), _f(p, "away_pct", 0.5), _i(p, "away_candles", 5))


@trigger("cross_above", "cross_below")
def _(i, o, p):
    tf = _i(p, "tf", 1)
    levels = tr.Inputs(tr.with_ema_levels(i, (o,)), i.candles) if o in tr.EMA_LEVELS else i
    if tf == 1:
        return tr.level_cross(levels.day_bars, (o,))
    return tr.candle_level_cross(levels, tf, tr.BAR_LEVELS.get(o, o), o)


_STUDIES = {"ta_macd_hist_cross": ind.macd, "ta_rsi_cross": ind.rsi, "ta_stoch_k_cross": ind.stoch, "ta_cci_cross": ind.cci,
            "ta_bb_percent_b_cross": ind.bbands, "ta_adx_cross": ind.adx}
for _id, _fn in _STUDIES.items():
    trigger(_id)(lambda i, o, p, name=_id, fn=_fn: tr.study_cross(fn(i.covered(_i(p, "tf", 5)), co.SERIES, "cpos"), name,
                                                                  float(p["level"]) if "level" in p else None))


def streaks(covered: DataFrame) -> DataFrame:
    """Signed colour run of consecutive-slot candles inside one session (0 on a doji)."""
    w = Window.partitionBy("symbol", "et_date", "tf", "key_session").orderBy("slot")
    c = covered.withColumn("_s", F.signum(F.col("close") - F.col("open")).cast("int"))
    new = F.coalesce((F.col("_s") != F.lag("_s").over(w)) | (F.col("slot") != F.lag("slot").over(w) + 1), F.lit(True))
    c = c.withColumn("_n", new.cast("int"))
    c = c.withColumn("_isl", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("symbol", "et_date", "tf", "key_session", "_isl").orderBy("slot")
    return c.withColumn("streak", (F.row_number().over(run) * F.col("_s")).cast("int")).drop("_s", "_n", "_isl")


def signature(params: dict) -> str:
    """Parameters in one spelling, part of the identity of a detector instance."""
    return json.dumps({k: float(v) if isinstance(v, (int, float)) else v for k, v in params.items()}, sort_keys=True) if params else ""


@trigger("orb_trade_cross")
def _(i, o, p):
    """First trusted trade above the opening range of ``o`` minutes; none where the inputs hold no trades."""
    if i.trades is None:
        return tr.fires(i.bars.limit(0), F.lit(False), "orb_trade_cross", o, "long", F.lit(None), 1)
    crosses = qt.trade_cross(i.trades, co.opening_range(i.bars, int(o), ["stream", "history", "quotes"]))
    return tr.fires(crosses.withColumn("session", F.lit("rth")), F.lit(True), "orb_trade_cross", o, "long", F.col("price"), 1)


def detect(i: tr.Inputs, tid: str, option: str = "", params: dict | None = None) -> DataFrame:
    """Fires of one configured detector instance; ``setup:<code>`` are those of another producer, passed through."""
    if tid.startswith("setup:"):
        none = tr.fires(i.bars.limit(0), F.lit(False), tid, option, "long", F.lit(None), 1)
        return none if i.external is None else i.external.select(*tr.FIRE).where((F.col("trigger") == tid) & (F.col("option") == option))
    f = TRIGGERS[tid](i, option, params or {}).where(F.col("trigger") == tid)
    return f.where(F.col("option") == option) if option else f


# ---- condition values ---------------------------------------------------------------------------------------------------------

_COLUMN = {"price": "price", "avg_vol_20d": "avg_vol_20d", "avg_dollar_vol_20d": "avg_dollar_vol_20d", "atr_pct": "atr_pct", "session_volume": "session_volume", "rvol": "rvol",
           "time_et": "time_et", "day_range_pos": "day_range_pos", "market_cap": "market_cap", "float_shares": "float_shares", "short_pct_float": "short_pct_float"}
for _id, _c in _COLUMN.items():
    condition(_id)(lambda i, b, o, p, c=_c: b.withColumn("v", F.col(c)))
for _id, _default in {"gap_pct": "abs", "rth_chg_pct": "abs", "mom_15m_pct": "abs", "dist_vwap_pct": "abs", "atr_extension_d1": "trade"}.items():
    condition(_id)(lambda i, b, o, p, c=_id, d=_default: b.withColumn("v", cd.side_value(F.col(c), o or d, F.col("direction"))))


@condition("dist_level")
def _(i, b, o, p):
    name = o or "prior_high"
    if name in tr.EMA_LEVELS:
        levels = tr.with_ema_levels(i, (name,)).select("symbol", "et_date", "et_min", name)
        b = b.join(levels, ["symbol", "et_date", "et_min"], "left")
    return b.withColumn("v", cd.level_distance(F.col("close"), F.col(tr.BAR_LEVELS.get(name, name)), _i(p, "side", 0), F.col("atr_d1") if _i(p, "unit", 0) == 1 else None))


@condition("void_pct")
def _(i, b, o, p):
    return b.withColumn("v", cd.by_direction(F.col("void_long"), F.col("void_short"), F.col("direction")))


def _on(i, b, values, cols, tf, value, pos="cpos", before="cbefore"):
    cur = co.asof_candle(i.candles.where(F.col("tf") == tf), values, cols, pos, before)
    return co.bars_with_candle(b, cur, tf).withColumn("v", value()).drop("tf", "key_session", "slot", *cols)


def _sided(o, above, below):
    if o in ("above", "below"):
        return lambda: F.col(above if o == "above" else below)
    first, second = (below, above) if o == "opposite" else (above, below)
    return lambda: cd.by_direction(F.col(first), F.col(second), F.col("direction"))


@condition("vwap_hold")
def _(i, b, o, p):
    tf = _i(p, "tf", 5)
    margin = _f(p, "margin", 0)
    atr = i.bars.groupBy("symbol", "et_date").agg(F.max("atr_d1").alias("atr_d1")) if margin > 0 else None
    return _on(i, b, cd.vwap_hold(i.candles, tf, _i(p, "lookback", 5), margin, atr), ["hold_above", "hold_below"], tf, _sided(o, "hold_above", "hold_below"))


@condition("ema_hold")
def _(i, b, o, p):
    tf = _i(p, "tf", 5)
    return _on(i, b, cd.ema_hold(i.candles, tf, _i(p, "period", 9), _i(p, "lookback", 3)), ["hold_above", "hold_below"], tf, _sided(o, "hold_above", "hold_below"))


@condition("ema_stack")
def _(i, b, o, p):
    tf = _i(p, "tf", 1)
    return _on(i, b, cd.ema_stack(i.candles, tf, _i(p, "fast", 8), _i(p, "slow", 21)), ["stack"], tf, lambda: cd.side_value(F.col("stack"), o or "trade", F.col("direction")), "rpos", "rbefore")


@condition("dist_ema9_pct")
def _(i, b, o, p):
    tf = int(o or 5)
    return _on(i, b, cd.dist_ema9(i.candles, tf), ["ema9"], tf, lambda: F.abs((F.col("close") - F.col("ema9")) / F.col("ema9") * 100), "rpos", "rbefore")


def _in_day(i, b, values, cols, tf, value):
    """Bars with the newest earlier candle of the date that has ``cols``."""
    cur = cd.day_asof(i.candles, tf, values, cols)
    return co.bars_with_candle(b, cur, tf).withColumn("v", value()).drop("tf", "key_session", "slot", *cols)


@condition("consec_candles")
def _(i, b, o, p):
    which, _, tf = (o or "abs").partition(":")
    tf = int(tf) if tf else _i(p, "tf", 2)
    run = F.col("streak").cast("double")
    value = {"green": F.greatest(run, F.lit(0.0)), "red": F.greatest(-run, F.lit(0.0))}.get(which, F.abs(run))
    return _in_day(i, b, streaks(i.covered(tf)).where("key_session = 'rth'"), ["streak"], tf, lambda: value)


@condition("vwap_day_pct")
def _(i, b, o, p):
    return _in_day(i, b, cd.vwap_day_pct(i.candles), ["pct_above", "pct_below"], 5, _sided(o, "pct_above", "pct_below"))


@condition("rel_vol")
def _(i, b, o, p):
    tf, n = _i(p, "tf", 5), _i(p, "lookback", 10)
    now = rel.rolling_rel_volume(i.bars, tf, n, "_rolling").select("symbol", "et_date", "et_min", "_rolling")
    b = b.join(now, ["symbol", "et_date", "et_min"], "left")
    if tf < 5:
        return b.withColumn("v", F.col("_rolling") * 100).drop("_rolling")
    by_candle = rel.candle_rel_volume(i.covered(tf), n, "_candle")
    return _on(i, b, by_candle, ["_candle"], tf, lambda: F.coalesce("_rolling", "_candle") * 100).drop("_rolling")


def _strength(i, b, o, p, bench):
    """During the first 12 candles of a session the strength is not yet known; the value is then NaN, which passes every operator."""
    r = rel.rrs_against(i.candles, i.sectors) if bench is None else rel.rrs_intraday(i.candles, bench)
    w = Window.partitionBy("symbol", "et_date").orderBy("slot")
    own = i.covered(5).where("key_session = 'rth'").withColumn("nc", F.row_number().over(w)).select("symbol", "et_date", "key_session", "slot", "nc")
    r = own.join(r.select("symbol", "et_date", "slot", "rrs_m5"), ["symbol", "et_date", "slot"], "left")
    signed = lambda: F.when(F.coalesce("nc", F.lit(0)) < 12, F.lit(float("nan"))).otherwise(cd.side_value(F.col("rrs_m5"), o or "trade", F.col("direction")))
    return _in_day(i, b, r, ["nc", "rrs_m5"], 5, signed)


condition("rrs_m5")(lambda i, b, o, p: _strength(i, b, o, p, p.get("benchmark", "SPY")))


# the symbol's own sector where the inputs hold the map, else the sector named by the rule
condition("rrs_sector_m5")(lambda i, b, o, p: _strength(i, b, o, p, None if i.sectors is not None else p.get("sector", "XLK")))


@condition("rrs_slope")
def _(i, b, o, p):
    r = rel.rrs_intraday(i.candles, p.get("benchmark", "SPY")).where("rrs_m5 is not null")
    w = Window.partitionBy("symbol", "et_date").orderBy("pos")
    r = r.withColumn("_slope", F.col("rrs_m5") - F.lag("rrs_m5", _i(p, "lookback", 3)).over(w)).where("_slope is not null")
    return _in_day(i, b, r, ["_slope"], 5, lambda: cd.side_value(F.col("_slope"), o or "trade", F.col("direction")))


@condition("rrs_d1")
def _(i, b, o, p):
    r = rel.rrs_daily(i.daily, p.get("benchmark", "SPY"))
    return b.join(r, ["symbol", "et_date"], "left").withColumn("v", cd.side_value(F.col("rrs_d1"), o or "trade", F.col("direction"))).drop("rrs_d1")


def _opening(name):
    def value(i, b, o, p):
        opened = rel.opening_candle(i.candles, co.volume_profile(i.bars))
        ranks = rel.opening_ranks(i.daily, opened).select("symbol", "et_date", "opening_rank", "coverage")
        j = b.join(opened.select("symbol", "et_date", "opening_direction", "opening_rvol"), ["symbol", "et_date"], "left").join(ranks, ["symbol", "et_date"], "left")
        v = {"opening_direction_m5": cd.side_value(F.col("opening_direction"), o or "trade", F.col("direction")), "opening_rvol_m5": F.col("opening_rvol"),
             "opening_rvol_rank": F.when(F.col("coverage") >= 0.8, F.col("opening_rank"))}[name]
        return j.withColumn("v", F.when(F.col("et_min") >= 575, v)).drop("opening_direction", "opening_rvol", "opening_rank", "coverage")
    return value


for _id in ("opening_direction_m5", "opening_rvol_m5", "opening_rvol_rank"):
    condition(_id)(_opening(_id))


@condition("market_align")
def _(i, b, o, p):
    s = i.bars.where((F.col("symbol") == p.get("benchmark", "SPY")) & (F.col("session") == "rth")).withColumn("regime", st.market_regime(F.col("close"), F.col("vwap")))
    j = b.join(tr.per_minute(s, ["regime"]), ["et_date", "et_min"], "left")
    return j.withColumn("v", cd.market_align(F.col("bench_regime"), F.col("direction"), F.col("et_min"))).drop("bench_regime")


@condition("spread_bps")
def _(i, b, o, p):
    """Needs bars that carry ``spread_bps`` of the quote at their close (an as-of join of the quotes)."""
    return b.withColumn("v", F.col("spread_bps"))


# check id -> (study with the requested length, value column)
_CHECKS = {"adx": (ind.adx, "adx"), "ta_rsi": (ind.rsi, "rsi"), "ta_cci": (ind.cci, "cci"), "ta_adx_plus_di": (ind.adx, "plus_di"), "ta_adx_minus_di": (ind.adx, "minus_di"),
           "ta_sma": (lambda c, k, q, n=50: ind.sma(c, k, q, n), "sma"), "ta_ema": (lambda c, k, q, n=9: ind.ema(c, k, q, {"ema": n}), "ema"),
           "ta_atr": (lambda c, k, q, n=14: ind.atr(c, k, q, {"atr": n}), "atr")}
_FIXED = {"ta_macd": (ind.macd, "macd"), "ta_macd_signal": (ind.macd, "macd_signal"), "ta_macd_hist": (ind.macd, "macd_hist"), "ta_stoch_k": (ind.stoch, "stoch_k"),
          "ta_stoch_d": (ind.stoch, "stoch_d"), "ta_obv": (ind.obv, "obv"), **{f"ta_bb_{x}": (ind.bbands, f"bb_{x}") for x in ("lower", "middle", "upper", "width", "percent_b")}}
for _id, (_fn, _c) in {**_CHECKS, **_FIXED}.items():
    def _value(i, b, o, p, fn=_fn, col=_c, has_length=_id in _CHECKS):
        tf = _i(p, "tf", 5)
        args = (int(p["period"]),) if has_length and "period" in p else ()
        return _on(i, b, fn(i.covered(tf), co.SERIES, "cpos", *args), [col], tf, lambda: F.col(col))
    condition(_id)(_value)


# ---- whole documents ------------------------------------------------------------------------------------------------------------

def run_documents(i: tr.Inputs, documents: list[dict], profiles: dict[str, list[tuple]] | None = None, shared: dict[str, list[dict]] | None = None) -> DataFrame:
    """Outcomes (sent / blocked / repeat / waiting) of rule documents over the bars of ``i``.

    A document that is switched off is passed over.  The conditions (id, op, value) of its universe profile are checked like its own;
    ``profiles`` adds to or replaces the default ones, and a profile that nobody knows lets everything pass.  A document may name a set of
    ``shared`` conditions (``param_set``); profile, shared set and own conditions all have to hold, so the tighter threshold wins.

    Every distinct detector instance is evaluated once and every distinct condition becomes one column; a document without a
    fixed direction is screened as a long candidate in its direction-signed conditions.
    """
    from . import rules as ru
    rows, instances, values, names = [], {}, {}, {}
    known = {**cd.DEFAULT_PROFILES, **(profiles or {})}
    for d in documents:
        if d.get("enabled", True) is False:
            continue
        side = {"long": "long", "short": "short"}.get(d.get("alert_direction") or d.get("direction"), "long")
        triggers = []
        for t in d["triggers"]:
            for option in t.get("options") or [""]:
                sig = signature(t.get("params") or {})
                instances[t["id"], option, sig] = t.get("params") or {}
                triggers.append((t["id"], f"{option}{sig}", 0, int(t.get("repeat_sec") or 0)))
        params = []
        screen = known.get(d.get("universe_profile"), [])
        for c in [*(shared or {}).get(d.get("param_set"), []), *(d.get("parameters") or []), *({"id": x, "op": op, "value": v} for x, op, v in screen)]:
            key = (c["id"], c.get("option", ""), signature(c.get("params") or {}), side)
            name = names.setdefault(key, f"cond_{len(names)}")
            values[name] = (c, side)
            params.append((name, c["op"], float(c["value"])))
        rows.append((d["id"], d.get("mode", "or"), d.get("direction", "all"), d.get("alert_direction"), d.get("sessions") or ["rth"], int(d.get("repeat_sec") or 0),
                     int(d.get("and_window_min", 5)), int(d.get("min_triggers", 2)), triggers, params, d.get("universe_profile")))
    spark = i.bars.sparkSession
    setups = ru.setups_table(spark, rows)
    fires = tr.both(*[detect(i, tid, option, params).withColumn("option", F.lit(f"{option}{sig}")).withColumn("tf", F.lit(0))
                      for (tid, option, sig), params in instances.items()])
    evaluation = ru.evaluation_rows(ru.match(fires, setups))
    bars = cd.bar_values(i.bars)
    for name, (c, side) in values.items():
        bars = CONDITIONS[c["id"]](i, bars.withColumn("direction", F.lit(side)), c.get("option", ""), c.get("params") or {})
        bars = bars.withColumnRenamed("v", name).drop("direction")
    lenient = [n for n, (c, _) in values.items() if c["id"] in cd.PASS_ON_MISSING]
    return ru.fold_setups(ru.with_verdict(evaluation, bars, setups, list(values), lenient))


def load_documents(path: str) -> list[dict]:
    """Rule documents of a JSON file (a configuration file, not data)."""
    with open(path, encoding="utf-8") as f:
        docs = json.load(f)
    return docs if isinstance(docs, list) else docs["setups"]

"""State predicates: values at a bar (no memory) and the generic check on a value."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ordered import Smooth, recurrence, rolling
from ..session import small_table
from . import candles as co
from . import indicators as ind
from . import state as st

W = Window
DAY = ["symbol", "et_date"]
SERIES = co.SERIES
OPS = {"gte": lambda a, b: a >= b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "lt": lambda a, b: a < b}
OP_TEXT = {"gte": ">=", "lte": "<=", "gt": ">", "lt": "<"}


def passed(value: Column, op: str, threshold: float, missing_passes: bool = False, warming: Column | None = None) -> Column:
    """The verdict alone: a missing value blocks unless the check lets it pass or its input is still warming up."""
    when_missing = F.lit(missing_passes) if warming is None else warming | F.lit(missing_passes)
    return F.when(value.isNull(), when_missing).otherwise(OPS[op](value, F.lit(float(threshold))))


def check(name: str, value: Column, op: str, threshold: float, missing_passes: bool = False, warming: Column | None = None) -> Column:
    """struct(name, passed, value, reason)."""
    warm = F.lit(False) if warming is None else warming
    shown = F.concat(F.format_number(value, 2), F.lit(f" {OP_TEXT[op]} {float(threshold):,.2f}"))
    reason = (F.when(value.isNull() & warm, "warming up (pass)")
               .when(value.isNull() & F.lit(missing_passes), "unavailable (pass)")
               .when(value.isNull(), "unavailable").otherwise(shown))
    return F.struct(F.lit(name).alias("name"), passed(value, op, threshold, missing_passes, warming).alias("passed"),
                    F.round(value, 4).alias("value"), reason.alias("reason"))


def side_value(value: Column, option: str, direction: Column) -> Column:
    """Option of a signed value: raw/above, below, abs, or signed by the trade direction."""
    sign = F.when(direction == "short", -1.0).otherwise(1.0)
    return {"raw": value, "signed": value, "above": value, "below": -value, "abs": F.abs(value), "trade": value * sign}[option]


def by_direction(long_value: Column, short_value: Column, direction: Column) -> Column:
    return F.when(direction == "short", short_value).otherwise(long_value)


def bar_values(bars: DataFrame) -> DataFrame:
    """Condition values that are arithmetic on the bar table (``bars`` = derived state with context and rvol)."""
    price = F.coalesce("last_close", "prior_close")
    close_minute = F.col("et_min") + 1
    above = F.array_min(F.filter("highs_60", lambda x: x > F.col("close")))
    below = F.array_max(F.filter("lows_60", lambda x: x < F.col("close")))
    return bars.withColumns({
        "price": F.coalesce(F.col("close"), price), "avg_vol_20d": F.col("adv20"),
        "avg_dollar_vol_20d": F.when(F.col("prior_close") != 0, F.col("adv20") * F.col("prior_close")),
        "atr_pct": F.try_divide(F.col("atr_d1"), F.col("prior_close")) * 100, "session_volume": F.col("cum_volume"),
        "time_et": (F.floor(close_minute / 60) * 100 + close_minute % 60).cast("double"),
        "atr_extension_d1": F.when(F.col("atr14_d1") > 0, F.try_divide(F.col("close") - F.col("ema8_d"), F.col("atr14_d1"))),
        "void_long": F.when(F.col("highs_60").isNotNull(), F.coalesce((above - F.col("close")) / F.col("close") * 100, F.lit(999.0))),
        "void_short": F.when(F.col("lows_60").isNotNull(), F.coalesce((F.col("close") - below) / F.col("close") * 100, F.lit(999.0))),
    })


def market_align(regime: Column, direction: Column, minute: Column, start: int = 600) -> Column:
    """0 only when the regime opposes the direction after the cutoff minute."""
    against = F.when(direction == "short", regime == "bullish").otherwise(regime == "bearish")
    return F.when(minute < start, 1.0).when(regime.isNull(), F.lit(None).cast("double")).otherwise(F.when(against, 0.0).otherwise(1.0))


def level_distance(price: Column, level: Column, side: int = 0, atr: Column | None = None) -> Column:
    """Distance to a level in percent of the level, or of the daily ATR; ``side`` 0 = either, 1 = above, -1 = below."""
    d = price - level
    d = F.abs(d) if side == 0 else d * float(side)
    return F.when(level > 0, F.try_divide(d, level if atr is None else atr) * 100)


# ---- values of the newest completed candle, attached to the bars of the next ones ------------------------------------------

def on_bars(bars: DataFrame, candles: DataFrame, values: DataFrame, cols: list[str], tf: int, pos="cpos", before="cbefore") -> DataFrame:
    cur = co.asof_candle(candles.where(F.col("tf") == tf), values, cols, pos, before)
    return co.bars_with_candle(bars, cur, tf)


def vwap_hold(candles: DataFrame, tf: int = 5, n: int = 5, margin: float = 0.0, atr: DataFrame | None = None) -> DataFrame:
    """Closes beyond their own VWAP by ``margin`` percent of the daily ATR among the last ``n`` candles, NULL while one of them has no VWAP.

    ``atr``: symbol, et_date, atr_d1; needed with a margin, and without an ATR above zero the value is NULL.
    """
    c = co.covered(candles, tf)
    off = F.lit(0.0)
    if margin > 0:
        c = c.join(atr.select("symbol", "et_date", F.when(F.col("atr_d1") > 0, F.col("atr_d1") * margin / 100).alias("_off")), DAY, "left")
        off = F.col("_off")

    def cols(w):
        b = w.rowsBetween(-(n - 1), 0)
        ok = co.last_n_ok(w, n) & (F.count("vwap").over(b) == n) & off.isNotNull()
        return {"hold_above": F.when(ok, F.sum((F.col("close") > F.col("vwap") + off).cast("double")).over(b)),
                "hold_below": F.when(ok, F.sum((F.col("close") < F.col("vwap") - off).cast("double")).over(b))}
    return co.recent(c, n - 1, cols)


def day_asof(candles: DataFrame, tf: int, values: DataFrame, cols: list[str], keys=("key_session", "slot")) -> DataFrame:
    """Candle rows with ``cols`` of the newest earlier candle of the same date that has them (a window inside the date)."""
    rows = candles.where(F.col("tf") == tf).select(*DAY, "tf", "key_session", "slot", "start_min")
    v = values.select(*DAY, *keys, F.struct(*cols).alias("_v"))
    w = W.partitionBy(*DAY, "tf").orderBy("start_min").rowsBetween(W.unboundedPreceding, -1)
    return (rows.join(v, [*DAY, *keys], "left").withColumn("_v", F.last("_v", ignorenulls=True).over(w))
                .select(*DAY, "tf", "key_session", "slot", *[F.col("_v")[c].alias(c) for c in cols]))


def vwap_day_pct(candles: DataFrame, tf: int = 5) -> DataFrame:
    """Percent of today's regular candles on each side of their VWAP so far."""
    w = W.partitionBy(*DAY).orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    c = co.covered(candles, tf).where("key_session = 'rth' and vwap is not null")
    n = F.count(F.lit(1)).over(w)
    return c.withColumns({"pct_above": F.sum((F.col("close") > F.col("vwap")).cast("int")).over(w) * 100.0 / n,
                          "pct_below": F.sum((F.col("close") < F.col("vwap")).cast("int")).over(w) * 100.0 / n})


def ema_hold(candles: DataFrame, tf: int = 5, period: int = 9, n: int = 3) -> DataFrame:
    """Closes beyond the EMA (seeded with the first close) among the last ``n`` candles."""
    e = recurrence(co.covered(candles, tf), SERIES, "cpos", [Smooth("_e", "close", period, seed_first=True)])

    def cols(w):
        b = w.rowsBetween(-(n - 1), 0)
        ok = (F.col("cpos") >= max(n, period))
        return {"hold_above": F.when(ok, F.sum((F.col("close") > F.col("_e")).cast("double")).over(b)),
                "hold_below": F.when(ok, F.sum((F.col("close") < F.col("_e")).cast("double")).over(b))}
    return rolling(e, SERIES, "cpos", max(n - 1, 1), cols)


def ema_stack(candles: DataFrame, tf: int = 1, fast: int = 8, slow: int = 21) -> DataFrame:
    """Distance of a fast EMA from a slower one in percent; NULL for a pair that is not fast and slow."""
    r = co.covered(candles, tf).where("rpos is not null")
    e = ind.ema(r, SERIES, "rpos", {"_f": fast, "_s": slow})
    return e.withColumn("stack", F.when(F.lit(fast < slow), F.try_divide(F.col("_f") - F.col("_s"), F.col("_s")) * 100))


def dist_ema9(candles: DataFrame, tf: int) -> DataFrame:
    return ind.ema(co.covered(candles, tf).where("rpos is not null"), SERIES, "rpos", {"ema9": 9})


# ---- threshold gates --------------------------------------------------------------------------------------------------------

def gates(df: DataFrame, direction: Column, rvol_min=1.0, void_min=1.0, warm_bars=12) -> DataFrame:
    """Relative strength, pace, clear-air and market gates; NULL = no data yet (the strength gate blocks after warm-up)."""
    r = F.col("rrs_m5")
    strength = F.when(r.isNull(), F.when(F.col("bars_5m") >= warm_bars, False)).when(direction == "short", r < 0).otherwise(r > 0)
    void = by_direction(F.col("void_long"), F.col("void_short"), direction)
    return df.withColumns({"gate_rrs": strength, "gate_rvol": F.col("rvol") >= rvol_min, "gate_void": void >= void_min,
                           "gate_market": market_align(F.col("regime"), direction, F.col("et_min")) >= 1.0})


# ---- universe profiles ---------------------------------------------------------------------------------------------------------

# The default profiles (condition, operator, threshold).
DEFAULT_PROFILES = {
    "up_all": [],
    "up_liquid_movers": [("price", "gte", 15.0), ("avg_vol_20d", "gte", 5_000_000.0), ("avg_dollar_vol_20d", "gte", 50_000_000.0),
                         ("atr_pct", "gte", 1.0)],
    "up_small_cap_runners": [("price", "gte", 1.0), ("atr_pct", "gte", 4.0), ("float_shares", "lte", 20_000_000.0),
                             ("rvol", "gte", 3.0), ("session_volume", "gte", 500_000.0)],
}
STATIC = ("price", "avg_vol_20d", "avg_dollar_vol_20d", "atr_pct", "market_cap", "float_shares", "short_pct_float")
PASS_ON_MISSING = ("market_cap", "float_shares", "short_pct_float")


def profiles_table(spark, profiles=None) -> DataFrame:
    """Profiles as rows (profile_id, conditions array); a profile without conditions admits every symbol."""
    rows = [(k, [(c, o, float(v)) for c, o, v in conds]) for k, conds in (profiles or DEFAULT_PROFILES).items()]
    return small_table(spark, rows, "profile_id string, conditions array<struct<id:string,op:string,value:double>>")


def values_long(values: DataFrame, ids=STATIC, keys=("symbol",)) -> DataFrame:
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in ids)
    return values.select(*keys, F.expr(f"stack({len(ids)}, {pairs}) as (id, v)"))


def compare(v: Column, op: Column, threshold: Column) -> Column:
    """The verdict of a value; NaN stands for a value whose input is still warming up and passes every operator."""
    return (F.when(F.isnan(v), True).when(op == "gte", v >= threshold).when(op == "lte", v <= threshold)
             .when(op == "gt", v > threshold).when(op == "lt", v < threshold))


def profile_checks(values: DataFrame, profiles: DataFrame, ids=STATIC, keys=("symbol",)) -> DataFrame:
    """One row per (profile, row of values, condition of ``ids``): an equi-join on the condition id."""
    conds = (profiles.select("profile_id", F.explode("conditions").alias("c"))
                     .select("profile_id", F.col("c.id").alias("id"), F.col("c.op").alias("op"), F.col("c.value").alias("threshold")))
    j = values_long(values, ids, keys).join(conds, "id")
    verdict = F.when(F.col("v").isNull(), F.col("id").isin(*PASS_ON_MISSING)).otherwise(compare(F.col("v"), F.col("op"), F.col("threshold")))
    return j.withColumn("passed", verdict)


def members(values: DataFrame, profiles: DataFrame, ids=STATIC) -> DataFrame:
    """(profile_id, symbol) pairs whose static conditions all pass."""
    failed = profile_checks(values, profiles, ids).where(~F.col("passed")).select("profile_id", "symbol").distinct()
    # the configured rules are a handful of rows on the driver: every symbol is a candidate of every profile
    ids_ = [F.lit(r.profile_id) for r in profiles.select("profile_id").toLocalIterator()]
    pairs = values.select("symbol", F.explode(F.array(*ids_)).alias("profile_id"))
    return pairs.join(failed, ["profile_id", "symbol"], "left_anti")

"""Classic studies on completed candles.  ``keys`` + gap-free ``pos`` name the series; other columns pass through."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import Smooth, previous, recurrence, rolling, running_sum


def _full(w, n: int, col: str | None = None) -> Column:
    return F.count(F.lit(1) if col is None else F.col(col)).over(w.rowsBetween(-(n - 1), 0)) == n


def sma(df, keys, pos, n: int, value: str = "close", out: str = "sma") -> DataFrame:
    return rolling(df, keys, pos, n - 1, lambda w: {
        out: F.when(_full(w, n, value), F.avg(value).over(w.rowsBetween(-(n - 1), 0)))})


def ema(df, keys, pos, lengths: dict[str, int], value: str = "close") -> DataFrame:
    """Several EMAs at once; ``lengths`` maps the output name to the length."""
    return recurrence(df, keys, pos, [Smooth(o, value, n) for o, n in lengths.items()])


def true_range(df, keys, pos, out: str = "tr") -> DataFrame:
    """True range, NULL on the first row of a series."""
    p = previous(df, keys, pos, {"_pc": "close"})
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc")))
    return p.withColumn(out, F.when(F.col("_pc").isNotNull(), tr)).drop("_pc")


def atr(df, keys, pos, lengths: dict[str, int]) -> DataFrame:
    t = true_range(df, keys, pos, "_tr")
    return recurrence(t, keys, pos, [Smooth(o, "_tr", n, wilder=True, start=2) for o, n in lengths.items()]).drop("_tr")


def adx(df, keys, pos, n: int = 14, prefix: str = "") -> DataFrame:
    """Wilder's ADX with both directional indicators; the first ADX is on row 2n."""
    p = previous(df, keys, pos, {"_ph": "high", "_pl": "low", "_pc": "close"})
    up, dn = F.col("high") - F.col("_ph"), F.col("_pl") - F.col("low")
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc")))
    p = p.withColumns({"_tr": tr, "_up": F.when((up > dn) & (up > 0), up).otherwise(0.0),
                       "_dn": F.when((dn > up) & (dn > 0), dn).otherwise(0.0)})
    s = recurrence(p, keys, pos, [Smooth(o, v, n, wilder=True, start=2) for o, v in
                                  (("_atr", "_tr"), ("_pu", "_up"), ("_pd", "_dn"))])
    plus, minus = F.try_divide(F.col("_pu"), F.col("_atr")) * 100, F.try_divide(F.col("_pd"), F.col("_atr")) * 100
    s = s.withColumns({f"{prefix}plus_di": plus, f"{prefix}minus_di": minus})
    a, b = F.col(f"{prefix}plus_di"), F.col(f"{prefix}minus_di")
    s = s.withColumn("_dx", F.when(a.isNotNull(), F.coalesce(F.try_divide(F.abs(a - b), a + b) * 100, F.lit(0.0))))
    return recurrence(s, keys, pos, [Smooth(f"{prefix}adx", "_dx", n, wilder=True, start=n + 1)]) \
        .drop("_ph", "_pl", "_pc", "_tr", "_up", "_dn", "_atr", "_pu", "_pd", "_dx")


def rsi(df, keys, pos, n: int = 14, out: str = "rsi") -> DataFrame:
    p = previous(df, keys, pos, {"_pc": "close"})
    d = F.col("close") - F.col("_pc")
    p = p.withColumns({"_g": F.greatest(d, F.lit(0.0)), "_l": F.greatest(-d, F.lit(0.0))})
    s = recurrence(p, keys, pos, [Smooth("_ag", "_g", n, wilder=True, start=2), Smooth("_al", "_l", n, wilder=True, start=2)])
    return s.withColumn(out, F.try_divide(F.col("_ag") * 100, F.col("_ag") + F.col("_al"))).drop("_pc", "_g", "_l", "_ag", "_al")


def cci(df, keys, pos, n: int = 14, out: str = "cci") -> DataFrame:
    t = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    s = rolling(t, keys, pos, n - 1, lambda w: {
        "_w": F.when(_full(w, n), F.collect_list("_tp").over(w.rowsBetween(-(n - 1), 0))),
        "_m": F.avg("_tp").over(w.rowsBetween(-(n - 1), 0))})
    mad = F.aggregate("_w", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_m"))) / n
    return s.withColumn(out, F.try_divide(F.col("_tp") - F.col("_m"), mad * 0.015)).drop("_tp", "_w", "_m")


def obv(df, keys, pos, out: str = "obv") -> DataFrame:
    """Signed cumulative volume; the first row adds its own volume."""
    p = previous(df, keys, pos, {"_pc": "close"})
    sign = F.when(F.col("_pc").isNull(), 1.0).otherwise(F.signum(F.col("close") - F.col("_pc")))
    return running_sum(p.withColumn("_sv", sign * F.col("volume")), keys, pos, "_sv", out).drop("_pc", "_sv")


def macd(df, keys, pos) -> DataFrame:
    """12/26/9 line, signal and histogram."""
    e = recurrence(df, keys, pos, [Smooth("_f", "close", 12), Smooth("_s", "close", 26)])
    e = e.withColumn("macd", F.col("_f") - F.col("_s"))
    s = recurrence(e, keys, pos, [Smooth("macd_signal", "macd", 9, start=26)])
    return s.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_f", "_s")


def stoch(df, keys, pos) -> DataFrame:
    """14/3/3 stochastic."""
    n = 14
    s = rolling(df, keys, pos, n - 1, lambda w: {
        "_lo": F.min("low").over(w.rowsBetween(-(n - 1), 0)), "_hi": F.max("high").over(w.rowsBetween(-(n - 1), 0)),
        "_ok": _full(w, n)})
    s = s.withColumn("_fk", F.when(F.col("_ok"), F.try_divide((F.col("close") - F.col("_lo")) * 100, F.col("_hi") - F.col("_lo"))))
    s = sma(s, keys, pos, 3, "_fk", "stoch_k")
    return sma(s, keys, pos, 3, "stoch_k", "stoch_d").drop("_lo", "_hi", "_ok", "_fk")


def bbands(df, keys, pos) -> DataFrame:
    """20/2 Bollinger bands with the population deviation."""
    n = 20
    s = rolling(df, keys, pos, n - 1, lambda w: {
        "bb_middle": F.when(_full(w, n), F.avg("close").over(w.rowsBetween(-(n - 1), 0))),
        "_sd": F.when(_full(w, n), F.stddev_pop("close").over(w.rowsBetween(-(n - 1), 0)))})
    lo, hi = F.col("bb_middle") - 2 * F.col("_sd"), F.col("bb_middle") + 2 * F.col("_sd")
    return s.withColumns({
        "bb_lower": lo, "bb_upper": hi, "bb_width": F.try_divide((hi - lo) * 100, F.col("bb_middle")),
        "bb_percent_b": F.try_divide(F.col("close") - lo, hi - lo)}).drop("_sd")


def rrs(df, keys, pos, n: int, out: str = "rrs_raw") -> DataFrame:
    """Relative strength against the benchmark columns bench_high/low/close of the same (inner-joined) rows."""
    p = previous(df, keys, pos, {"_pc": "close", "_pb": "bench_close"})

    def tr(h, l, prev):
        return F.greatest(F.col(h) - F.col(l), F.abs(F.col(h) - F.col(prev)), F.abs(F.col(l) - F.col(prev)))
    p = p.withColumns({"_ts": tr("high", "low", "_pc"), "_tb": tr("bench_high", "bench_low", "_pb")})
    p = previous(p, keys, pos, {"_cn": "close", "_bn": "bench_close"}, n)
    s = recurrence(p, keys, pos, [Smooth("_as", "_ts", n, wilder=True, start=2), Smooth("_ab", "_tb", n, wilder=True, start=2)])
    expected = F.try_divide(F.col("bench_close") - F.col("_bn"), F.col("_ab")) * F.col("_as")
    return s.withColumn(out, F.try_divide(F.col("close") - F.col("_cn") - expected, F.col("_as"))) \
        .drop("_pc", "_pb", "_ts", "_tb", "_cn", "_bn", "_as", "_ab")


STUDY_COLUMNS = ("rsi", "cci", "obv", "macd", "macd_signal", "macd_hist", "stoch_k", "stoch_d", "bb_lower", "bb_middle",
                 "bb_upper", "bb_width", "bb_percent_b", "adx", "plus_di", "minus_di", "atr14", "sma50", "ema9")


def studies(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Every study with its default length: one look-back pass, one recurrence pass, and one for the two second-level averages."""
    o, h, l, x = (F.col(c) for c in ("open", "high", "low", "close"))
    tp = (h + l + x) / 3

    def first(w):
        b = lambda n: w.rowsBetween(-(n - 1), 0)
        full = lambda n, c: F.when(F.count(F.lit(1)).over(b(n)) == n, c)
        lo, hi = F.min("low").over(b(14)), F.max("high").over(b(14))
        return {"_ph": F.lag("high").over(w), "_pl": F.lag("low").over(w), "_pc": F.lag("close").over(w),
                "sma50": full(50, F.avg("close").over(b(50))), "bb_middle": full(20, F.avg("close").over(b(20))),
                "_sd": full(20, F.stddev_pop("close").over(b(20))), "_tpm": F.avg(tp).over(b(14)),
                "_tps": full(14, F.collect_list(tp).over(b(14))),
                "_fk": full(14, F.try_divide((x - lo) * 100, hi - lo))}

    def smooth3(col, name):
        return lambda w: {name: F.when(F.count(col).over(w.rowsBetween(-2, 0)) == 3, F.avg(col).over(w.rowsBetween(-2, 0)))}
    s = rolling(df, keys, pos, 49, first)
    s = rolling(s, keys, pos, 2, smooth3("_fk", "stoch_k"))
    s = rolling(s, keys, pos, 2, smooth3("stoch_k", "stoch_d"))
    up, dn, d = h - F.col("_ph"), F.col("_pl") - l, x - F.col("_pc")
    mad = F.aggregate("_tps", F.lit(0.0), lambda a, v: a + F.abs(v - F.col("_tpm"))) / 14
    lo, hi = F.col("bb_middle") - 2 * F.col("_sd"), F.col("bb_middle") + 2 * F.col("_sd")
    s = s.withColumns({
        "_tr": F.when(F.col("_pc").isNotNull(), F.greatest(h - l, F.abs(h - F.col("_pc")), F.abs(l - F.col("_pc")))),
        "_up": F.when((up > dn) & (up > 0), up).otherwise(0.0), "_dn": F.when((dn > up) & (dn > 0), dn).otherwise(0.0),
        "_g": F.greatest(d, F.lit(0.0)), "_l": F.greatest(-d, F.lit(0.0)),
        "_sv": F.when(F.col("_pc").isNull(), 1.0).otherwise(F.signum(d)) * F.col("volume"),
        "cci": F.try_divide(tp - F.col("_tpm"), mad * 0.015), "bb_lower": lo, "bb_upper": hi,
        "bb_width": F.try_divide((hi - lo) * 100, F.col("bb_middle")), "bb_percent_b": F.try_divide(x - lo, hi - lo)})
    s = running_sum(s, keys, pos, "_sv", "obv")
    s = recurrence(s, keys, pos, [
        Smooth("ema9", "close", 9), Smooth("_f", "close", 12), Smooth("_s", "close", 26),
        *[Smooth(name, v, 14, wilder=True, start=2) for name, v in
          (("atr14", "_tr"), ("_pu", "_up"), ("_pd", "_dn"), ("_ag", "_g"), ("_al", "_l"))]])
    plus, minus = F.try_divide(F.col("_pu"), F.col("atr14")) * 100, F.try_divide(F.col("_pd"), F.col("atr14")) * 100
    s = s.withColumns({"rsi": F.try_divide(F.col("_ag") * 100, F.col("_ag") + F.col("_al")), "macd": F.col("_f") - F.col("_s"),
                       "plus_di": plus, "minus_di": minus})
    a, b = F.col("plus_di"), F.col("minus_di")
    s = s.withColumn("_dx", F.when(a.isNotNull(), F.coalesce(F.try_divide(F.abs(a - b), a + b) * 100, F.lit(0.0))))
    s = recurrence(s, keys, pos, [Smooth("macd_signal", "macd", 9, start=26), Smooth("adx", "_dx", 14, wilder=True, start=15)])
    s = s.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    return s.drop(*[c for c in s.columns if c.startswith("_")])

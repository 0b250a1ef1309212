"""Relative measures of bars and candles: strength against a benchmark, volume against earlier volume, the opening candle."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import candles as co
from . import daily as da
from . import indicators as ind


def rrs_intraday(candles: DataFrame, bench: str, tf: int = 5, n: int = 12, name: str = "rrs_m5") -> DataFrame:
    """Raw relative strength inside each regular session against the candles of one benchmark symbol."""
    w = Window.partitionBy("symbol", "et_date").orderBy("slot")
    c = co.covered(candles, tf).where("key_session = 'rth'")
    b = c.where(F.col("symbol") == bench).select("et_date", "slot", *[F.col(x).alias(f"bench_{x}") for x in ("high", "low", "close")])
    j = c.where(F.col("symbol") != bench).join(b, ["et_date", "slot"]).withColumn("pos", F.row_number().over(w).cast("long"))
    return ind.rrs(j, ["symbol", "et_date"], "pos", n, name)


def rrs_against(candles: DataFrame, benchmarks: DataFrame, tf: int = 5, n: int = 12, name: str = "rrs_m5") -> DataFrame:
    """``rrs_intraday`` with a benchmark for each symbol: ``benchmarks`` holds (symbol, sector), one row per symbol."""
    w = Window.partitionBy("symbol", "et_date").orderBy("slot")
    c = co.covered(candles, tf).where("key_session = 'rth'")
    wanted = benchmarks.select(F.col("sector").alias("symbol")).distinct()
    b = c.join(wanted, "symbol", "left_semi").select(F.col("symbol").alias("sector"), "et_date", "slot", *[F.col(x).alias(f"bench_{x}") for x in ("high", "low", "close")])
    j = c.join(benchmarks, "symbol").where("symbol <> sector").join(b, ["sector", "et_date", "slot"]).drop("sector").withColumn("pos", F.row_number().over(w).cast("long"))
    return ind.rrs(j, ["symbol", "et_date"], "pos", n, name)


def rrs_daily(sessions: DataFrame, bench: str, n: int = 5) -> DataFrame:
    """``rrs_d1`` known before each session: the mean of the last ``n`` daily strengths of the sessions before."""
    b = sessions.where(F.col("symbol") == bench).select("et_date", *[F.col(x).alias(f"bench_{x}") for x in ("high", "low", "close")])
    j = da.with_pos(sessions.where(F.col("symbol") != bench).join(b, "et_date"), "et_date")
    r = ind.sma(ind.rrs(j, ["symbol"], "pos", n), ["symbol"], "pos", n, "rrs_raw", "_now")
    return co.rolling(r, ["symbol"], "pos", 1, lambda w: {"rrs_d1": F.lag("_now").over(w)}).select("symbol", "et_date", "rrs_d1")


def candle_rel_volume(covered: DataFrame, n: int, name: str = "ratio") -> DataFrame:
    """Volume of a candle over the mean of the ``n`` before."""
    def cols(w):
        avg = F.avg("volume").over(w.rowsBetween(-n, -1))
        return {name: F.when(co.last_n_ok(w, n + 1) & (avg > 0), F.col("volume") / avg)}
    return co.recent(covered, n, cols)


def rolling_rel_volume(bars: DataFrame, tf: int, n: int, name: str = "ratio") -> DataFrame:
    """Volume of the trailing ``tf`` bars over the mean of the ``n`` blocks before, inside one session."""
    w = Window.partitionBy("symbol", "et_date", "session").orderBy("et_min")
    cur = F.sum("volume").over(w.rowsBetween(-(tf - 1), 0))
    prior = F.sum("volume").over(w.rowsBetween(-(tf * (n + 1) - 1), -tf)) / n
    full = F.count(F.lit(1)).over(w.rowsBetween(-(tf * (n + 1) - 1), 0)) == tf * (n + 1)
    return bars.withColumn(name, F.when(full & (prior > 0), cur / prior))


def opening_candle(candles: DataFrame, profile: DataFrame) -> DataFrame:
    """Direction and relative volume of the covered 09:30 five-minute candle."""
    p = profile.where("slot = 0").select("symbol", "et_date", "mean_volume")
    c = co.covered(candles, 5).where("key_session = 'rth' and slot = 0").join(p, ["symbol", "et_date"], "left")
    return c.withColumn("opening_direction", F.signum(F.col("close") - F.col("open"))) \
            .withColumn("opening_rvol", F.when(F.col("mean_volume") > 0, F.col("volume") / F.col("mean_volume")))


def opening_ranks(sessions: DataFrame, opening: DataFrame) -> DataFrame:
    """Competition rank of the opening relative volume over the symbols of a session, with the share that has a value."""
    base = sessions.select("symbol", "et_date").join(opening.select("symbol", "et_date", "opening_rvol"), ["symbol", "et_date"], "left")
    w = Window.partitionBy("et_date")       # one row per symbol: bounded by the universe, never by the bars
    return base.withColumns({
        "opening_rank": F.when(F.col("opening_rvol").isNotNull(), F.rank().over(w.orderBy(F.col("opening_rvol").desc_nulls_last())).cast("double")),
        "coverage": F.count("opening_rvol").over(w) / F.count(F.lit(1)).over(w)})

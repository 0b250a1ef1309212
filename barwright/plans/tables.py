"""Bar tables derived from the given parquet tables, written once per session and bucketed on (symbol, et_date)."""
from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import clock
from ..operators import candles as candle_ops
from ..operators import daily as daily_ops
from ..operators import state as state_ops
from ..session import bucket_count, shuffle_partitions, write_bucketed

BASE_DATE = "2000-01-03"          # session 0 of the derived bars
KEYS_PER_BLOCK = 1 << 30          # order keys per block when a ship date is cut for the numbering
ALERT_STATE = """symbol et_date et_min ts session open high low close volume day_high day_low prev_day_high prev_day_low session_open cum_volume vwap last_close close_15ago
stop_low stop_high""".split()    # what the alerts and their five-minute candles read of the state
W = Window


def build_bars(lineitem: DataFrame) -> DataFrame:
    """Minute bars from line items: 20 symbols, 30 premarket and 390 regular minutes per synthetic session.

    Numbering the rows of a symbol is done in (symbol, ship date, order-key block) chunks; the chunk sizes and last prices
    carry the row number and the previous price over, so no task sees a whole symbol.
    """
    px = F.col("l_extendedprice") / F.col("l_quantity") / 10.0
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"]
    t = lineitem.select(
        F.concat(F.lit("S"), F.lpad((F.col("l_suppkey") % 20).cast("string"), 2, "0")).alias("symbol"),
        "l_shipdate", *order, "l_discount", "l_tax", "l_quantity", px.alias("px"),
        F.floor(F.col("l_orderkey") / KEYS_PER_BLOCK).cast("int").alias("blk"))
    chunk = ["symbol", "l_shipdate", "blk"]
    sizes = t.groupBy(*chunk).agg(F.count(F.lit(1)).alias("n"), F.max_by("px", F.struct(*order)).alias("last_px"))
    cw = W.partitionBy("symbol").orderBy("l_shipdate", "blk")
    carry = sizes.select(*chunk, F.coalesce(F.sum("n").over(cw.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("off"),
                         F.lag("last_px").over(cw).alias("carry_px"))
    rw = W.partitionBy(*chunk).orderBy(*order)
    u = (t.withColumn("rn", F.row_number().over(rw)).withColumn("ppx", F.lag("px").over(rw))
          .join(carry, chunk)
          .withColumn("r", F.col("off") + F.col("rn") - 1)
          .withColumn("ppx", F.when(F.col("rn") == 1, F.col("carry_px")).otherwise(F.col("ppx"))))
    o = F.coalesce("ppx", "px")
    day = F.floor(F.col("r") / 420).cast("int")
    minute = (F.lit(540) + F.col("r") % 420).cast("int")
    bars = (u.where(F.col("l_orderkey") % 97 != 0)
             .select("symbol", F.date_add(F.lit(BASE_DATE), day).alias("et_date"), minute.alias("et_min"),
                     o.alias("open"),
                     (F.greatest(o, F.col("px")) * (1 + F.col("l_discount") / 100)).alias("high"),
                     (F.least(o, F.col("px")) * (1 - F.col("l_tax") / 100)).alias("low"),
                     F.col("px").alias("close"), (F.col("l_quantity") * 100).alias("volume")))
    wall = F.timestamp_add("MINUTE", F.col("et_min"), F.col("et_date").cast("timestamp"))
    return (bars.withColumn("ts", F.to_utc_timestamp(wall, clock.ZONE))
                .withColumn("session", clock.session_of("et_min"))
                .withColumn("source", F.when(F.col("et_min") % 2 == 0, "stream").otherwise("history")))


def build_daily(lineitem: DataFrame) -> DataFrame:
    """Daily bars: supplier as symbol, ship date as day."""
    px = F.col("l_extendedprice") / F.col("l_quantity") / 10.0
    rank = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")
    x = lineitem.select(F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 3, "0")).alias("symbol"),
                        F.col("l_shipdate").cast("date").alias("d"), px.alias("px"), rank.alias("ord"), "l_quantity")
    return x.groupBy("symbol", "d").agg(
        F.min_by("px", "ord").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", "ord").alias("close"), (F.sum("l_quantity") * 100).alias("volume"))


class Tables:
    """Lazily derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")      # stamps are UTC; New York time is always derived
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")   # packed; sorted and exploded rows take many times that
        self.tag = hashlib.sha1(f"{spark.sparkContext.applicationId}:{sf_dir}".encode()).hexdigest()[:10]

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return df.select([F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c)
                          for c, t in df.dtypes])

    def _stored(self, name: str, make, keys: list[str], order: list[str]) -> DataFrame:
        table = f"bw_{name}_{self.tag}"
        if not self.spark.catalog.tableExists(table):
            with shuffle_partitions(self.spark, self.buckets):
                write_bucketed(make(), table, keys, order, self.buckets)
        # queries over the stored tables exchange rows in parts that are no larger than a bucket
        parts = "spark.sql.shuffle.partitions"
        self.spark.conf.set(parts, str(max(int(self.spark.conf.get(parts)), self.buckets)))
        return self.spark.table(table)

    @cached_property
    def buckets(self) -> int:
        return bucket_count(self.raw("lineitem"))

    @cached_property
    def bars(self) -> DataFrame:
        return self._stored("bars", lambda: build_bars(self.raw("lineitem")), ["symbol", "et_date"], ["et_min"])

    @cached_property
    def daily(self) -> DataFrame:
        return self._stored("daily", lambda: build_daily(self.raw("lineitem")), ["symbol"], ["d"])

    @cached_property
    def sessions(self) -> DataFrame:
        """Regular-session daily bars folded from the minute bars."""
        return self._stored("sessions", lambda: candle_ops.session_bars(self.bars), ["symbol"], ["et_date"])

    @cached_property
    def context(self) -> DataFrame:
        """Per (symbol, session): levels and indicators known before the session opens."""
        return self._stored("context", lambda: daily_ops.daily_context(self.sessions), ["symbol", "et_date"], [])

    @cached_property
    def state(self) -> DataFrame:
        """Per-bar running session columns."""
        return self._stored("state", lambda: state_ops.bar_state(self.bars), ["symbol", "et_date"], ["et_min"])

    @cached_property
    def alert_state(self) -> DataFrame:
        """The state as alerts read it, for queries that read no other: all of it has twice the columns."""
        if "state" in self.__dict__:
            return self.state
        return self._stored("state_alerts", lambda: state_ops.bar_state(self.bars).select(*ALERT_STATE), ["symbol", "et_date"], ["et_min"])

    @cached_property
    def candles(self) -> DataFrame:
        return self._stored("candles", lambda: candle_ops.candles(self.state), ["symbol", "et_date"], ["tf", "start_min"])

    def candles_of(self, tf: int) -> DataFrame:
        """The candles of one timeframe, for queries that read no other: all of them are seven times the rows."""
        if "candles" in self.__dict__:
            return self.candles.where(F.col("tf") == tf)
        return self._stored(f"candles{tf}", lambda: candle_ops.candles(self.alert_state, (tf,)), ["symbol", "et_date"], ["start_min"])

    @cached_property
    def profile(self) -> DataFrame:
        """Per (symbol, session): mean slot volumes of the sessions before."""
        return self._stored("profile", lambda: candle_ops.volume_profile(self.bars), ["symbol", "et_date"], ["slot"])


_CACHE: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _CACHE:
        _CACHE[key] = Tables(spark, key[1])
    return _CACHE[key]

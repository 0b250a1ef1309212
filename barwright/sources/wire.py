"""Decoding of feed messages held as JSON text, one message per row.  Malformed parts become NULL and are filtered."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import schemas

# Services, field codes and the market-list key catalog.
BAR_SERVICE, QUOTE_SERVICE, LIST_SERVICE = "CHART_EQUITY", "LEVELONE_EQUITIES", "SCREENER_EQUITY"
BAR_FIELDS = {"open": "2", "high": "3", "low": "4", "close": "5", "volume": "6"}
QUOTE_FIELDS = {"bid": "1", "ask": "2", "last": "3", "bid_size": "4", "ask_size": "5", "total_volume": "8", "last_size": "9",
                "day_high": "10", "day_low": "11"}
QUOTE_TIMES = {"bid_ms": "37", "ask_ms": "38", "last_ms": "35"}
LIST_MARKETS = ["EQUITY_ALL", "NYSE", "NASDAQ", "OTCBB", "INDEX_AL", "$COMPX", "$DJI", "$SPX.X"]
LIST_MEASURES = ["PERCENT_CHANGE_UP", "PERCENT_CHANGE_DOWN", "VOLUME", "TRADES", "AVERAGE_PERCENT_VOLUME"]
LIST_PERIODS = [0, 1, 5, 10, 30, 60]


def _contents(messages: DataFrame, schema: str, service: str, text: str, keep: list[str]) -> DataFrame:
    m = messages.select(*keep, F.from_json(text, schema).alias("m"))
    blocks = m.select(*keep, F.explode("m.data").alias("b")).where(F.col("b.service") == service)
    return blocks.select(*keep, F.col("b.timestamp").alias("block_ms") if "timestamp" in schema else F.lit(None).alias("block_ms"),
                         F.explode("b.content").alias("c"))


def number(c: Column) -> Column:
    return c.try_cast("double")


def bars(messages: DataFrame, text: str = "raw") -> DataFrame:
    """Minute bars; a bar needs its symbol, time and all five numbers."""
    c = _contents(messages, schemas.CHART_MESSAGE, BAR_SERVICE, text, [])
    ms = F.col("c")["7"].try_cast("bigint")
    b = c.select(F.col("c")["key"].alias("symbol"), F.timestamp_millis(ms).alias("ts"),
                 *[number(F.col("c")[code]).alias(name) for name, code in BAR_FIELDS.items()], F.lit(schemas.BAR_SOURCE).alias("source"))
    return b.dropna(subset=["symbol", "ts", *BAR_FIELDS])


def quotes(messages: DataFrame, text: str = "raw", keep=("receipt_ms",)) -> DataFrame:
    """Sparse quote rows: a field is NULL when the update did not carry it."""
    c = _contents(messages, schemas.CHART_MESSAGE, QUOTE_SERVICE, text, list(keep))
    return c.where(F.col("c")["key"].isNotNull()).select(
        F.col("c")["key"].alias("symbol"), *keep, *[number(F.col("c")[code]).alias(n) for n, code in QUOTE_FIELDS.items()],
        *[F.col("c")[code].try_cast("bigint").alias(n) for n, code in QUOTE_TIMES.items()], F.col("c")["delayed"].try_cast("boolean").alias("delayed"))


def trades(quote_rows: DataFrame) -> DataFrame:
    """A trade is an update that carries both a price and its own plausible trade time."""
    return (quote_rows.where(F.col("last").isNotNull() & (F.col("last_ms") > 1_000_000_000_000))
                      .select("symbol", F.col("last_ms").alias("trade_market_ms"), "receipt_ms", F.col("last").alias("price"), "delayed"))


def list_keys(spark) -> DataFrame:
    """The valid market-list keys, built from their three parts."""
    parts = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in LIST_MARKETS])).alias("m"))
    parts = parts.select("m", F.explode(F.array(*[F.lit(x) for x in LIST_MEASURES])).alias("x"))
    parts = parts.select("m", "x", F.explode(F.array(*[F.lit(p) for p in LIST_PERIODS])).alias("p"))
    return parts.select(F.concat_ws("_", "m", "x", F.col("p").cast("string")).alias("list_key"))


def market_lists(messages: DataFrame, text: str = "raw", keep=("received_ms",)) -> DataFrame:
    """Ranked rows of the valid lists; the rank is the place in the message."""
    c = _contents(messages, schemas.LIST_MESSAGE, LIST_SERVICE, text, list(keep))
    rows = c.select(*keep, F.upper(F.trim("c.key")).alias("list_key"), F.col("c.1").alias("provider_epoch"), F.posexplode("c.4").alias("at", "i"))
    r = rows.select(*keep, "list_key", "provider_epoch", (F.col("at") + 1).alias("rank"), F.upper(F.trim("i.symbol")).alias("symbol"),
                    F.col("i.lastPrice").alias("price"), F.col("i.netChange").alias("net_change"), F.col("i.netPercentChange").alias("percent_change"),
                    F.col("i.volume").alias("volume"), F.col("i.totalVolume").alias("total_volume"), F.col("i.trades").alias("trades"),
                    F.col("i.marketShare").alias("market_share"))
    return r.where("symbol <> ''").join(list_keys(messages.sparkSession), "list_key", "left_semi")


def candles(messages: DataFrame, text: str = "raw") -> DataFrame:
    """Candle documents as bars; vwap and trade_count do not exist in them."""
    m = messages.select(F.from_json(text, schemas.CANDLES_MESSAGE).alias("m")).select("m.symbol", F.explode("m.candles").alias("c"))
    return m.select("symbol", F.timestamp_millis("c.datetime").alias("ts"), "c.open", "c.high", "c.low", "c.close", "c.volume",
                    F.lit(None).cast("double").alias("vwap"), F.lit(None).cast("bigint").alias("trade_count"))

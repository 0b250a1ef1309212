"""Explicit schemas; nothing is inferred from data."""

BARS_1M = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, source string"
BARS_HISTORY = "symbol string, et_date date, et_min int, open double, high double, low double, close double, volume double, vwap double, trade_count bigint"
ALERTS = ("event_id string, session_id string, seq bigint, mode string, source string, symbol string, setup string, direction string, trigger string, "
          "ts timestamp, price double, score double, session_date date, "
          "trigger_evidence array<struct<instance_key:string,trigger:string,direction:string,value:double>>")

# wire messages: numeric field codes are the keys of the content objects
CHART_MESSAGE = "data array<struct<service:string, timestamp:bigint, content:array<map<string,string>>>>"
LIST_ITEM = ("struct<symbol:string, description:string, lastPrice:double, netChange:double, netPercentChange:double, volume:double, "
             "totalVolume:double, trades:double, marketShare:double>")
LIST_MESSAGE = f"data array<struct<service:string, content:array<struct<key:string, `1`:bigint, `4`:array<{LIST_ITEM}>>>>>"
CANDLES_MESSAGE = "symbol string, candles array<struct<datetime:bigint, open:double, high:double, low:double, close:double, volume:double>>"
RSS_ITEM = "title string, link string, guid string, pubDate string, description string, tickers string"

#: Fixed value: the label that the feed's own one-minute bars carry.
BAR_SOURCE = "schwab_chart_equity"

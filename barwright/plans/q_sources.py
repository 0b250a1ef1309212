"""Sources and sinks: stored history, feed messages, directories, archives."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candles as co
from ..session import shared_dir
from ..sources import archive, history, reference_data, schemas, wire
from . import q_market as qm
from . import q_rules as qr
from .registry import CTES, out, query
from .tables import BASE_DATE

DAY = ["symbol", "et_date"]


def folder(t, name):
    return f"{shared_dir(t.spark)}/{t.spark.sparkContext.applicationId}/io-{t.tag}/{name}"


def day_of(n):
    """Date literal of session ``n``."""
    return F.date_add(F.lit(BASE_DATE), n)


def stored_history(t):
    b = t.state.select(*DAY, "et_min", "open", "high", "low", "close", "volume", "vwap", F.lit(1).cast("bigint").alias("trade_count"))
    path = folder(t, "history")
    history.write_bars(b, path)
    return path


@query("source_history_roundtrip", "select symbol, day, et_min, open, high, low, close, volume from state where symbol in ('S03', 'S04') and day between 1 and 3")
def _(t):
    """Write the bar history by date, then read two symbols and three dates back (partition pruning and pushed filters)."""
    return out(history.read_bars(t.spark, stored_history(t), ["S03", "S04"], "2000-01-04", "2000-01-06"), "symbol day et_min open high low close volume")


@query("source_history_replace_dates", "select symbol, day, et_min, case when day = 2 then close + 1 else close end as close from bars")
def _(t):
    """Rewriting one date leaves the others untouched."""
    path = stored_history(t)
    fixed = history.read_bars(t.spark, path, start="2000-01-05", end="2000-01-05").withColumn("close", F.col("close") + 1)
    kept = f"{path}-fix"
    history.write_bars(fixed, kept)
    history.write_bars(t.spark.read.schema(schemas.BARS_HISTORY).parquet(kept), path)
    return out(history.read_bars(t.spark, path), "symbol day et_min close")


@query("history_freshness", "select symbol, max(day) as day, max(day) >= 7 as fresh from bars group by symbol")
def _(t):
    return out(history.freshness(t.bars, "2000-01-10").withColumn("et_date", F.col("last_date")), "symbol day fresh")


CTES["dirty"] = """select symbol, day, et_min, case when symbol = 'S05' and et_min = 600 then 'nan'::double else close end as close, case when symbol = 'S06' and et_min = 700 then -1 else volume end as volume from bars
 union all select symbol, day, et_min, close, volume from bars where symbol = 'S07' and et_min = 650"""


def dirty(t):
    b = t.bars
    d = b.withColumn("close", F.when((F.col("symbol") == "S05") & (F.col("et_min") == 600), float("nan")).otherwise(F.col("close")))
    d = d.withColumn("volume", F.when((F.col("symbol") == "S06") & (F.col("et_min") == 700), -1.0).otherwise(F.col("volume")))
    return d.unionByName(b.where("symbol = 'S07' and et_min = 650"))


CTES["bounds"] = """select symbol, min(day) as first_day, max(day) as last_day, sum(n)::bigint as rows, sum(n - 1)::bigint as duplicates, sum(bad)::bigint as bad_rows, sum(n - 1) = 0 and sum(bad) = 0 as ok from (
 select symbol, day, et_min, count(*) as n, count(*) filter (isnan(close) or volume < 0) as bad from dirty group by all) group by symbol"""


@query("history_integrity", "select symbol, first_day, last_day, rows, duplicates, bad_rows, ok from bounds")
def _(t):
    i = history.integrity(dirty(t))
    d = lambda c: F.datediff(c, F.lit(BASE_DATE))
    return i.select("symbol", d("first_date").alias("first_day"), d("last_date").alias("last_day"), "rows", "duplicates", "bad_rows", "ok")


def calendar(t):
    return t.sessions.select(F.col("et_date").alias("session_date")).distinct()


def plan(t):
    d = lambda n: day_of(n)
    req = t.bars.select("symbol").distinct().select("symbol", F.date_sub(d(0), 0).alias("start"), d(9).alias("end"))
    late = history.integrity(dirty(t).where("not (symbol = 'S08' and et_date < date_add(date'2000-01-03', 3))"))
    cov = t.bars.where("symbol in ('S09', 'S10')").select("symbol").distinct().select("symbol", d(0).alias("start"), F.when(F.col("symbol") == "S09", d(9)).otherwise(d(6)).alias("end"))
    return history.plan(req, late, cov, calendar(t))


CTES["lastday"] = "select least(9, max(day)) as need_last, min(day) as need_first from sessions where day between 0 and 9"
CTES["spans"] = """select symbol, mode, s.a as span_start, s.b as span_end from (select b.symbol, case when ok then 'incremental' else 'full' end as mode,
 unnest(list_filter([case when not ok then struct_pack(a := 0, b := 9) when f > need_first and b.symbol not in ('S09', 'S10') then struct_pack(a := 0, b := f) end,
  case when ok and last_day < need_last and not (b.symbol = 'S09') then struct_pack(a := case when b.symbol = 'S10' then greatest(last_day, 6) else last_day end, b := 9) end], lambda x: x is not null)) as s
 from (select *, case when symbol = 'S08' then greatest(first_day, 3) else first_day end as f from bounds) b cross join lastday)"""


def _span_days(df):
    d = lambda c: F.datediff(c, F.lit(BASE_DATE))
    return df.withColumn("span_start", d("span_start")).withColumn("span_end", d("span_end"))


@query("history_gap_plan", "select symbol, mode, span_start, span_end from spans")
def _(t):
    return _span_days(plan(t)).select("symbol", "mode", "span_start", "span_end")


@query("history_request_batches", "select span_start, span_end, count(*) as symbols, min(symbol) as first_symbol, max(symbol) as last_symbol from spans group by 1, 2")
def _(t):
    b = history.request_batches(plan(t).select("symbol", "span_start", "span_end"))
    g = b.groupBy("span_start", "span_end").agg(F.sum(F.size("symbols")).alias("symbols"), F.min(F.array_min("symbols")).alias("first_symbol"), F.max(F.array_max("symbols")).alias("last_symbol"))
    return _span_days(g)


@query("history_coverage_ledger", "select symbol, 0 as start_day, case when symbol < 'S10' then 9 else 5 end as end_day from (select distinct symbol from bars)")
def _(t):
    s = t.bars.select("symbol").distinct()
    old = s.select("symbol", day_of(2).alias("start"), day_of(5).alias("end"))
    new = s.select("symbol", day_of(0).alias("start"), F.when(F.col("symbol") < "S10", day_of(9)).otherwise(day_of(4)).alias("end"))
    c = history.note_coverage(old, new)
    d = lambda x: F.datediff(x, F.lit(BASE_DATE))
    return c.select("symbol", d("start").alias("start_day"), d("end").alias("end_day"))


@query("history_prior_and_session_split", "select case when day < 3 then 'prior' else 'session' end as part, symbol, day, count(*) as n from bars where day <= 3 group by all")
def _(t):
    p = history.prior(t.bars, "2000-01-06").withColumn("part", F.lit("prior")).unionByName(history.session(t.bars, "2000-01-06").withColumn("part", F.lit("session")))
    return out(p.groupBy("part", "symbol", "et_date").agg(F.count(F.lit(1)).alias("n")), "part symbol day n")


@query("market_calendar_closed_sessions", "select distinct day, day % 3 = 0 as early_close from sessions where day <= 4")
def _(t):
    c = calendar(t).withColumn("close_et", F.timestamp_add("MINUTE", F.when(F.datediff("session_date", F.lit(BASE_DATE)) % 3 == 0, 780).otherwise(960), F.col("session_date").cast("timestamp")))
    c = history.closed_sessions(c, F.lit("2000-01-07 17:00:00").cast("timestamp"))
    return out(c.withColumn("et_date", F.col("session_date")), "day early_close")


@query("market_calendar_lookup", """select s.symbol, s.day, max(c.day) filter (c.day <= s.day) as last_day, min(c.day) filter (c.day >= s.day) as first_day
 from sessions s left join (select distinct day from sessions where day % 4 <> 1) c on abs(c.day - s.day) <= 14 group by 1, 2""")
def _(t):
    """The sessions around every day when a quarter of the dates are closed."""
    number = lambda c: F.datediff(c, F.lit(BASE_DATE))
    open_days = calendar(t).where(number("session_date") % 4 != 1)
    j = t.sessions.select(*DAY).join(history.session_lookup(open_days).withColumnRenamed("day", "_d"), F.col("et_date") == F.col("_d"), "left")
    return out(j.withColumns({"last_day": number("last_session"), "first_day": number("first_session")}), "symbol day last_day first_day")


@query("market_calendar_past_close", """select symbol, day, et_min, day % 4 = 1 or et_min * 60 >= (case when day % 3 = 0 then 780 else 960 end) * 60 + 90 as past_close from bars""")
def _(t):
    """Whether the session of a bar's day had closed, with a grace of 90 seconds, early closes and closed dates."""
    number = F.datediff("session_date", F.lit(BASE_DATE))
    c = calendar(t).where(number % 4 != 1).withColumn("close_et", F.timestamp_add("MINUTE", F.when(number % 3 == 0, 780).otherwise(960), F.col("session_date").cast("timestamp")))
    b = t.bars.select(*DAY, "et_min", F.timestamp_add("MINUTE", F.col("et_min"), F.col("et_date").cast("timestamp")).alias("at"))
    return out(history.past_close(b, "at", "et_date", c, 90), "symbol day et_min past_close")


# ---- feed messages -----------------------------------------------------------------------------------------------------------------------

def _text(c):
    return F.col(c).cast("string")


def bar_messages(t):
    """The minute bars as feed messages of one session minute, with a malformed entry in every message."""
    ms = F.unix_millis("ts")
    entry = F.create_map(*[x for kv in {"key": F.col("symbol"), "2": _text("open"), "3": _text("high"), "4": _text("low"), "5": _text("close"), "6": _text("volume"), "7": ms.cast("string")}.items()
                           for x in (F.lit(kv[0]), kv[1])])
    bad = F.array(F.create_map(F.lit("key"), F.lit("BAD"), F.lit("2"), F.lit("x")))
    part = F.pmod(F.xxhash64("symbol"), F.lit(4))
    m = t.bars.groupBy("et_date", "et_min", part.alias("part")).agg(F.collect_list(entry).alias("e"))
    block = F.struct(F.lit(wire.BAR_SERVICE).alias("service"), F.concat("e", bad).alias("content"))
    other = F.struct(F.lit("OTHER").alias("service"), bad.alias("content"))
    return m.select(F.to_json(F.struct(F.array(block, other).alias("data"))).alias("raw")).unionByName(t.spark.range(1).select(F.lit("{broken").alias("raw")))


@query("wire_minute_bars", "select symbol, day, et_min, open, high, low, close, volume from bars")
def _(t):
    from ..functions.clock import add_clock
    return out(add_clock(wire.bars(bar_messages(t))), "symbol day et_min open high low close volume")


def quote_messages(t):
    q = qm.quotes(t)
    e = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in ("key", "1", "2", "3", "37", "38", "35", "9", "delayed")]),
                                       F.array(F.col("symbol"), _text("bid"), _text("ask"), F.when(F.col("seq") % 3 != 0, _text("last")), _text("bid_ms"), _text("ask_ms"),
                                               F.when(F.col("seq") % 4 != 0, _text("last_ms")), _text("last_size"), _text("delayed"))), lambda k, v: v.isNotNull())
    return q.select("receipt_ms", F.to_json(F.struct(F.array(F.struct(F.lit(wire.QUOTE_SERVICE).alias("service"), F.array(e).alias("content"))).alias("data"))).alias("raw"))


@query("wire_quotes", "select symbol, receipt_ms, bid, ask, case when seq % 3 <> 0 then last end as last, last_size from quotes")
def _(t):
    return wire.quotes(quote_messages(t)).select("symbol", "receipt_ms", "bid", "ask", "last", "last_size")


@query("wire_trades", "select symbol, ms as trade_market_ms, receipt_ms, last as price from quotes where seq % 3 <> 0 and seq % 4 <> 0")
def _(t):
    return wire.trades(wire.quotes(quote_messages(t))).select("symbol", "trade_market_ms", "receipt_ms", "price")


@query("wire_market_lists", """select list_key, received_ms, row_number() over (partition by list_key, received_ms order by rank, symbol) as rank, symbol, rank * 1.5::double as price from snaps where list_key = 'EQUITY_ALL_VOLUME_5'""")
def _(t):
    s = qm.snapshots(t).withColumn("key", F.when(F.col("list_key").like("%TRADES%"), "EQUITY_ALL_WRONG_5").otherwise(F.lower("list_key")))
    item = F.struct("symbol", (F.col("rank") * 1.5).alias("lastPrice"))
    m = s.groupBy("key", "received_ms").agg(F.sort_array(F.collect_list(F.struct("rank", "symbol", item.alias("i")))).alias("r"))
    content = F.struct("key", F.col("received_ms").alias("1"), F.transform("r", lambda x: x["i"]).alias("4"))
    raw = m.select("received_ms", F.to_json(F.struct(F.array(F.struct(F.lit(wire.LIST_SERVICE).alias("service"), F.array(content).alias("content"))).alias("data"))).alias("raw"))
    return wire.market_lists(raw).select("list_key", "received_ms", "rank", "symbol", "price")


@query("wire_candles", "select symbol, day, slot, open, high, low, close, volume from candles where tf = 30 and session = 'rth'")
def _(t):
    c = t.candles.where("tf = 30 and key_session = 'rth'")
    ms = F.datediff("et_date", F.lit(BASE_DATE)).cast("bigint") * 86400000 + F.col("slot")
    doc = c.groupBy("symbol", "et_date").agg(F.to_json(F.struct(F.first("symbol").alias("symbol"), F.collect_list(
        F.struct(ms.alias("datetime"), "open", "high", "low", "close", "volume")).alias("candles"))).alias("raw"))
    d = wire.candles(doc)
    ms = F.unix_millis("ts")
    return d.select("symbol", F.floor(ms / 86400000).cast("int").alias("day"), (ms % 86400000).cast("int").alias("slot"), "open", "high", "low", "close", "volume")


# ---- directories and files ------------------------------------------------------------------------------------------------------------------

@query("directory_files", """select 'P' || p_partkey as symbol, p_name as name, case when p_partkey % 2 = 0 then 'Nasdaq' when p_partkey % 5 = 1 then 'NYSE' when p_partkey % 5 = 2 then 'NYSE Arca' else 'Q' end as exchange, p_size % 7 = 0 as etf
 from part where p_size % 10 <> 3""")
def _(t):
    p = t.raw("part").withColumn("sym", F.concat(F.lit("P"), F.col("p_partkey").cast("string")))
    etf, test = F.when(F.col("p_size") % 7 == 0, "Y").otherwise("N"), F.when(F.col("p_size") % 10 == 3, "Y").otherwise("N")
    even = F.col("p_partkey") % 2 == 0
    cols = {"Security Name": F.col("p_name"), "ETF": etf, "Test Issue": test}
    listed = p.where(even).select(F.col("sym").alias("Symbol"), *[c.alias(n) for n, c in cols.items()])
    trailer = t.spark.range(1).select(F.lit("File Creation Time: 0102202409:30").alias("Symbol"), *[F.lit("").alias(n) for n in cols])
    code = F.when(F.col("p_partkey") % 5 == 1, "N").when(F.col("p_partkey") % 5 == 2, "P").otherwise("Q")
    other = p.where(~even).select(F.col("sym").alias("ACT Symbol"), *[c.alias(n) for n, c in cols.items()], code.alias("Exchange"))
    a, b = folder(t, "listed"), folder(t, "other")
    for df, path in ((listed.unionByName(trailer), a), (other, b)):
        df.write.mode("overwrite").option("sep", "|").option("header", True).csv(path)
    return reference_data.read_directory(t.spark, a, "listed").unionByName(reference_data.read_directory(t.spark, b, "other"))


def universe_file(t):
    u = t.raw("nation").select(F.concat(F.lit(" "), F.lower("n_name")).alias("symbol"), F.col("n_regionkey").cast("string").alias("price"))
    extra = t.raw("region").select(F.when(F.col("r_regionkey") == 0, "NA").otherwise("nan").alias("symbol"), F.lit("n/a").alias("price"))
    path = folder(t, "universe")
    u.unionByName(extra).write.mode("overwrite").option("header", True).csv(path)
    return path


@query("universe_csv", "select distinct upper(n_name) as symbol from nation union select 'NA' union select 'NAN'")
def _(t):
    return reference_data.read_universe(t.spark, universe_file(t))


@query("universe_meta_files", """select coalesce(u.symbol, s.symbol) as symbol, price, etf as sector_etf from (select upper(n_name) as symbol, n_regionkey::double as price from nation
 union all select case when r_regionkey = 0 then 'NA' else 'NAN' end, null from region) u full join (select upper(n_name) as symbol, 'X' || n_regionkey as etf from nation where n_nationkey % 2 = 0 union all select 'ONLY', 'X9') s on s.symbol = u.symbol""")
def _(t):
    s = t.raw("nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("symbol"), F.concat(F.lit("X"), F.col("n_regionkey").cast("string")).alias("sector_etf"))
    s = s.unionByName(t.spark.range(1).select(F.lit("only").alias("symbol"), F.lit("X9").alias("sector_etf")))
    path = folder(t, "sectors")
    s.write.mode("overwrite").option("header", True).csv(path)
    return reference_data.read_meta(t.spark, universe_file(t), path)


@query("rss_items", """select source || ':g' || doc_id as id, 'Note ' || doc_id || ' & ' || lang as headline, 'http://x/' || doc_id as url, 'A' || (doc_id % 9) || ',B1' as symbols,
 epoch_ms(timestamp '2024-01-02 10:00:00' + to_minutes((doc_id % 60)::bigint)) as created_ms from documents where doc_id % 10 <> 0""")
def _(t):
    d = t.raw("documents").select("doc_id", "lang", "source")
    i = F.col("doc_id").cast("string")
    minute = F.lpad((F.col("doc_id") % 60).cast("string"), 2, "0")
    xml = F.concat(F.lit("<item><title>Note "), i, F.lit(" &amp; &lt;b&gt;"), F.col("lang"), F.lit("&lt;/b&gt;</title><link>http://x/"), i, F.lit("</link><guid>g"), i, F.lit("</guid><pubDate>"),
                   F.when(F.col("doc_id") % 10 == 0, F.lit("soon")).otherwise(F.concat(F.lit("Tue, 02 Jan 2024 10:"), minute, F.lit(":00 +0000"))),
                   F.lit("</pubDate><description>d</description><tickers>b1, a"), (F.col("doc_id") % 9).cast("string"), F.lit("</tickers></item>"))
    items = d.select(F.concat(F.lit("A"), (F.col("doc_id") % 9).cast("string")).alias("symbol"), "source", xml.alias("xml"))
    r = reference_data.parse_rss(items)
    return r.select("id", "headline", "url", F.array_join("symbols", ",").alias("symbols"), F.unix_millis("created_at").alias("created_ms"))


# ---- archive ------------------------------------------------------------------------------------------------------------------------------

def archive_path(t, name="alerts"):
    a = qr.alerts(t)
    rows = a.select(F.when(F.col("et_min") % 10 != 0, F.concat_ws(":", "setup", "symbol", F.col("et_date").cast("string"), F.col("et_min").cast("string"))).alias("event_id"),
                    F.lit("s1").alias("session_id"), F.lit("live").alias("mode"), F.lit("custom").alias("source"), "symbol", "setup", "direction", "trigger", "ts", "price",
                    F.col("score").cast("double").alias("score"), F.col("et_date").alias("session_date"))
    path = folder(t, name)
    t.spark.range(0).select(F.lit(None).cast("string").alias("event_id"), F.lit("x").alias("session_date")).limit(0).write.mode("overwrite").json(path)
    archive.append_alerts(rows, path)
    return path


@query("alert_archive_recent", """select symbol, setup, day, et_min, price, et_min % 10 = 0 as legacy, case when et_min % 10 = 0 then 'unknown' else 'live' end as mode from alerts where day between 3 and 5""")
def _(t):
    from ..functions.clock import add_clock
    a = archive.read_recent(t.spark, archive_path(t), schemas.ALERTS, "2000-01-08", 3).where("session_date <= date'2000-01-08'")
    a = add_clock(a).withColumn("legacy", F.col("event_id").startswith("legacy:"))
    return out(a, "symbol setup day et_min price legacy mode")


@query("alert_archive_retention", "select setup, symbol, day, et_min from alerts where day >= 4")
def _(t):
    from ..functions.clock import add_clock
    path = archive_path(t, "alerts-retention")
    archive.expire(t.spark, path, "2000-01-09", 3)
    return out(add_clock(t.spark.read.schema(schemas.ALERTS).json(path)), "setup symbol day et_min")


@query("replay_capture_digests", """select symbol, label, count(*) as rows, true as verified from (select symbol, '1min' as label from bars where day = 3 union all select symbol, 'daily' from sessions where day < 3
 union all select symbol, '5min' from (select distinct symbol, day, floor(et_min / 5) from bars where day < 3)) group by all""")
def _(t):
    five = co.chart_buckets(t.bars, 5)
    root = folder(t, "capture")
    m = archive.capture(t.sessions, five, t.bars.select(*DAY, "et_min", "open", "high", "low", "close", "volume"), "2000-01-06", root)
    bad = archive.verify(t.spark, root, m).select("symbol", "label", F.lit(False).alias("v"))
    return m.join(bad, ["symbol", "label"], "left").select("symbol", "label", "rows", F.coalesce("v", F.lit(True)).alias("verified"))


@query("replay_bar_order", "select symbol, day, et_min, case symbol when 'S00' then 0 when 'S01' then 1 else 2 end as prio from bars where et_min <= 800")
def _(t):
    return out(archive.replay_order(t.bars, "S00", ["S01"], 800), "symbol day et_min prio")


@query("screen_csv_export", "select symbol, result from scra")
def _(t):
    path = folder(t, "screen-csv")
    archive.export_csv(qm.screen_a(t).select("symbol", "avg_dollar_volume", "result"), path, "avg_dollar_volume")
    return t.spark.read.option("header", True).csv(path).select("symbol", "result")


@query("source_bar_identity", "select symbol, day, et_min, source || ':' || symbol || ':1m:' || strftime(timestamp '2000-01-03' + to_days(day) + to_minutes(et_min::bigint) + to_hours(case when day between 90 and 299 then 4 else 5 end), '%Y-%m-%dT%H:%M:%SZ') as bar_id from bars")
def _(t):
    b = t.bars.withColumn("bar_id", archive.source_bar_id(F.col("source"), F.col("symbol"), F.col("ts")))
    return out(b, "symbol day et_min bar_id")


@query("revision_digests", """select symbol, d::varchar as d, sha256('{"d":"' || d || '","symbol":"' || symbol || '"}') as revision, substr(sha1('{"d":"' || d || '","symbol":"' || symbol || '"}'), 1, 8) as short_hash
 from daily""")
def _(t):
    doc = F.struct("d", "symbol")
    return t.daily.select("symbol", F.col("d").cast("string").alias("d")).select("symbol", "d", archive.revision(doc).alias("revision"), archive.short_hash(doc).alias("short_hash"))


CTES["fentries"] = """select s_suppkey, date '2024-03-01' + (s_suppkey % 20)::int as fetched, s_suppkey % 4 <> 0 as ok, s_suppkey % 9 = 0 as limited, case when s_suppkey % 3 = 0 then date '2024-03-05' + (s_suppkey % 15)::int end as ne from supplier"""


@query("fundamentals_freshness", """select s_suppkey from fentries where not limited and case when ok then date '2024-03-12' - fetched between 0 and 6 and coalesce(ne >= date '2024-03-12', true) else fetched = date '2024-03-12' end""")
def _(t):
    k = F.col("s_suppkey")
    e = t.raw("supplier").select("s_suppkey", F.date_add(F.lit("2024-03-01"), (k % 20).cast("int")).alias("fetched_at"), (k % 4 != 0).alias("ok"), (k % 9 == 0).alias("rate_limited"),
                                 F.when(k % 3 == 0, F.date_add(F.lit("2024-03-05"), (k % 15).cast("int"))).alias("next_earnings"))
    return archive.fresh_fundamentals(e, F.lit("2024-03-12").cast("date")).select("s_suppkey")


@query("fundamentals_next_earnings", """select s_suppkey, (list_min(list_filter([date '2024-01-01' + (s_suppkey % 90)::int, date '2024-02-10', date '2024-03-01' + (s_suppkey % 7)::int], lambda d: d > date '2024-02-15')))::varchar as next_earnings from supplier""")
def _(t):
    k = F.col("s_suppkey")
    dates = F.array(F.date_add(F.lit("2024-01-01"), (k % 90).cast("int")), F.lit("2024-02-10").cast("date"), F.date_add(F.lit("2024-03-01"), (k % 7).cast("int")))
    return t.raw("supplier").select("s_suppkey", archive.next_earnings(dates, F.lit("2024-02-15").cast("date")).cast("string").alias("next_earnings"))


@query("fundamentals_provider_merge", """select s_name as symbol, coalesce(case when s_suppkey % 5 <> 0 then s_name end, n_name) as name, coalesce(case when s_suppkey % 2 = 0 then (s_suppkey % 40) / 100.0::double end, 0.5::double) as short_pct_float,
 coalesce(case when s_suppkey % 2 = 0 then s_acctbal * 2 end, s_acctbal) as market_cap from supplier left join nation on s_suppkey % 2 = 0 and n_nationkey = s_nationkey""")
def _(t):
    s = t.raw("supplier")
    e = s.select(F.col("s_name").alias("symbol"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_name")).alias("name"), F.lit(0.5).alias("short_pct_float"), F.col("s_acctbal").alias("market_cap"))
    p = (s.where("s_suppkey % 2 = 0").join(t.raw("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
          .select(F.col("s_name").alias("symbol"), F.col("n_name").alias("name"), (F.col("s_suppkey") % 40).cast("double").alias("short_percent"), (F.col("s_acctbal") * 2).alias("market_cap")))
    return archive.merge_provider(e, p)


@query("alerts_published", """select setup, symbol, day, et_min, 1000 + row_number() over (order by day, et_min, setup, symbol) as seq from alerts""")
def _(t):
    p = archive.publish(archive.stored(qr.alerts(t), folder(t, "published")), "s1", 1000, ["et_date", "et_min", "setup", "symbol"], "et_date")
    return out(p, "setup symbol day et_min seq")


@query("sink_sanitised_values", "select symbol, day, et_min, case when et_min % 10 <> 0 and et_min % 7 <> 0 then close end as close from bars")
def _(t):
    b = t.bars.select(*DAY, "et_min", F.when(F.col("et_min") % 10 == 0, float("nan")).when(F.col("et_min") % 7 == 0, float("inf")).otherwise(F.col("close")).alias("close"))
    return out(archive.sanitize(b), "symbol day et_min close")


@query("sink_sanitised_nested", """select symbol, day, et_min, case when et_min % 10 <> 0 then close end as inner_close, case when et_min % 10 <> 0 then close end as listed, case when et_min % 7 <> 0 then high end as mapped, volume from bars""")
def _(t):
    """Values two levels down: a struct in a struct, a struct in an array, a map."""
    c, h = F.when(F.col("et_min") % 10 == 0, float("nan")).otherwise(F.col("close")), F.when(F.col("et_min") % 7 == 0, float("-inf")).otherwise(F.col("high"))
    b = t.bars.select(*DAY, "et_min", F.struct(F.struct(c.alias("close"), F.col("symbol").alias("name")).alias("bar"), "volume").alias("s"),
                      F.array(F.struct(c.alias("close"))).alias("a"), F.create_map(F.lit("h"), h).alias("m"))
    s = archive.sanitize(b)
    return out(s.select(*DAY, "et_min", F.col("s.bar.close").alias("inner_close"), F.col("a")[0]["close"].alias("listed"), F.col("m")["h"].alias("mapped"), F.col("s.volume").alias("volume")),
               "symbol day et_min inner_close listed mapped volume")

"""Streaming runs over the stored tables; the SQL is the batch result the stream must reproduce."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir, unmeasured_batches
from ..streaming import live, streams as sm
from . import q_market as qm
from . import q_rules as qr
from .registry import CTES, out, query
from .tables import BASE_DATE


SMALL_FILES = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}  # stamps and numbers that count on are stored as differences


def as_stream(t, df, name: str, files: int | None = None):
    """Write ``df`` as parquet files and open the folder as a stream."""
    path = f"{shared_dir(t.spark)}/{t.spark.sparkContext.applicationId}/stream-{t.tag}/{name}-{uuid.uuid4().hex[:8]}"
    (df if files is None else df.repartition(files)).write.options(**SMALL_FILES).parquet(f"{path}/in")
    return t.spark.readStream.schema(df.schema).parquet(f"{path}/in"), path


def in_batches(t, parts, path: str, schema, start) -> None:
    """One micro-batch per part: a part is written by as many tasks as hold it, and the query ``start(stream)`` is resumed from its checkpoint for it."""
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        start(t.spark.readStream.schema(schema).parquet(f"{path}/in")).awaitTermination()


def finish(stream, path, mode="append"):
    return sm.run_to_table(stream, f"{path}/out", f"{path}/ck", mode)


@query("stream_tumbling_candles", """select symbol, day, b as bucket, open, high, low, close, volume, n_bars from (select symbol, day, cast(floor(et_min / 5) * 5 as int) as b, min_by(open, et_min) as open, max(high) as high,
 min(low) as low, max_by(close, et_min) as close, sum(volume) as volume, count(*) as n_bars from bars group by all)
 where day * 1440 + b + 5 <= (select max(day * 1440 + et_min) - 2 from bars)""")
def _(t):
    s, path = as_stream(t, t.bars.select("symbol", "ts", "open", "high", "low", "close", "volume"), "candles")
    c = finish(sm.tumbling_candles(s, 5), path)
    from ..functions.clock import add_clock
    return out(add_clock(c, "window_start").withColumn("bucket", F.col("et_min")), "symbol day bucket open high low close volume n_bars")


@query("stream_distinct_bars", "select symbol, day, et_min, close from bars")
def _(t):
    b = t.bars.select("symbol", "ts", "et_date", "et_min", "close")
    s, path = as_stream(t, b.unionByName(b.where("et_min % 50 = 0")), "distinct")
    return out(finish(sm.distinct_bars(s), path), "symbol day et_min close")


@query("stream_live_signals", "select symbol, day, et_min, direction, trigger, round(value, 6) as value from cooled")
def _(t):
    s, path = as_stream(t, t.bars.select("symbol", "et_date", "ts", "et_min", "session", "high", "low", "close", "volume"), "signals")
    return out(finish(sm.live_signals(s), path), "symbol day et_min direction trigger", "value")


@query("stream_warmup_priming", "select symbol, day, et_min, direction, trigger, round(value, 6) as value from cooled where day >= 3")
def _(t):
    """A restart before session 3: the earlier bars prime the state and emit nothing."""
    s, path = as_stream(t, t.bars.select("symbol", "et_date", "ts", "et_min", "session", "high", "low", "close", "volume"), "priming")
    cutoff = F.date_add(F.lit(BASE_DATE), 3).cast("timestamp")
    return out(finish(sm.live_signals(s, cutoff), path), "symbol day et_min direction trigger", "value")


LIVE_DOCUMENTS = [
    {"id": "live_break", "mode": "or", "direction": "long", "sessions": ["rth"], "triggers": [{"id": "cross_above", "options": ["vwap"], "params": {"tf": 5}}, {"id": "hod", "options": ["high"]}],
     "parameters": [{"id": "rvol", "op": "gte", "value": 1}, {"id": "ta_ema", "op": "gte", "value": 100, "params": {"tf": 5, "period": 9}}], "universe_profile": "nobody knows this one", "param_set": "late"},
    {"id": "live_fade", "mode": "or", "direction": "short", "sessions": ["rth"], "triggers": [{"id": "cross_below", "options": ["vwap"], "params": {"tf": 5}}],
     "parameters": [{"id": "gap_pct", "op": "lte", "value": 50, "option": "signed"}]}]
CTES["liver"] = """select 'live_break' as setup, f.symbol, f.day, f.et_min, min(case when f.trigger = 'hod' then 'hod' else 'cross' end) as lead, bool_or(coalesce(c.rvol >= 1 and e.y >= 100 and c.time_et >= 1000, false)) as ok
  from fx f join cbt c using (symbol, day, et_min) join bc b on b.symbol = f.symbol and b.day = f.day and b.et_min = f.et_min and b.tf = 5 left join c5ema9 e on e.symbol = f.symbol and e.cpos = b.cbefore where f.direction = 'long' group by all
 union all select 'live_fade', f.symbol, f.day, f.et_min, 'cross', bool_or(coalesce(c.gap_pct <= 50, false)) from fx f join cbt c using (symbol, day, et_min) where f.trigger = 'cross_below' group by all"""
CTES["liveok"] = "select setup, symbol, lead, day, et_min from liver where ok"
qr.greedy("livesent", "liveok", "setup symbol lead", "5")


@query("stream_rule_documents", """select r.setup, r.symbol, r.day, r.et_min, case when not r.ok then 'blocked' when s.et_min is null then 'repeat' else 'sent' end as outcome
 from liver r left join livesent s on s.setup = r.setup and s.symbol = r.symbol and s.day = r.day and s.et_min = r.et_min where r.day >= 2""")
def _(t):
    """Rule documents on a stream of three batches that cut a session in two; the first two sessions are the replay after a restart.

    A profile that nobody knows lets everything pass; a shared set adds its condition.  Some bars come twice and some late.
    """
    b = t.bars.select(live.BAR)
    path = f"{shared_dir(t.spark)}/{t.spark.sparkContext.applicationId}/stream-{t.tag}/rules-{uuid.uuid4().hex[:8]}"
    day = F.datediff("et_date", F.lit(BASE_DATE))
    parts = [b.where(day < 2), b.where((day == 2) & (F.col("et_min") <= 700)).unionByName(b.where((day == 1) & (F.col("et_min") % 40 == 0))),
             b.where((day > 2) | ((day == 2) & (F.col("et_min") > 690)))]
    cutoff = F.date_add(F.lit(BASE_DATE), 2).cast("timestamp")
    known = live.Known(t.context, t.profile, t.sessions)
    in_batches(t, parts, path, b.schema, lambda s: live.start(s, path, LIVE_DOCUMENTS, known, cutoff=cutoff, shared={"late": [{"id": "time_et", "op": "gte", "value": 1000}]}))
    return out(live.outcomes(t.spark, path), "setup symbol day et_min outcome")


_ROLLED: dict[str, str] = {}  # two queries read the tables of one run


def rolled(t):
    """A stream of all bars in three batches: closed sessions and the context after each, in the folder that is returned."""
    if t.tag in _ROLLED:
        return _ROLLED[t.tag]
    b = t.bars.select(live.BAR)
    path = f"{shared_dir(t.spark)}/{t.spark.sparkContext.applicationId}/stream-{t.tag}/rollover-{uuid.uuid4().hex[:8]}"
    day = F.datediff("et_date", F.lit(BASE_DATE))
    parts = (b.where(day < 2), b.where((day == 2) | ((day == 3) & (F.col("et_min") <= 700))), b.where((day > 3) | ((day == 3) & (F.col("et_min") > 700))))
    in_batches(t, parts, path, b.schema, lambda s: live.closing_sessions(s).writeStream.outputMode("append").foreachBatch(live.fold_in_to(path))
               .option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start())
    _ROLLED[t.tag] = path
    return path


@query("stream_closed_sessions", "select symbol, day, open, high, low, close, volume from sessions where day < (select max(day) from sessions)")
def _(t):
    return out(t.spark.read.parquet(f"{rolled(t)}/daily").drop("batch_id"), "symbol day open high low close volume")


@query("stream_daily_context", """select symbol, day, prior_open, prior_high, prior_low, prior_close, hi_52w, lo_52w, days, n_day_high, n_day_low, round(adv20, 6) as adv20, round(atr_d1, 6) as atr_d1
 from ctx where prior_close is not null""")
def _(t):
    """The context that each session opens with, folded in when the session before has closed on the stream."""
    from pyspark.sql import Window
    opened = t.sessions.select("symbol", "et_date", F.lag("et_date").over(Window.partitionBy("symbol").orderBy("et_date")).alias("after"))
    c = t.spark.read.parquet(f"{rolled(t)}/context").drop("batch_id").join(opened, ["symbol", "after"])
    return out(c, "symbol day prior_open prior_high prior_low prior_close hi_52w lo_52w days n_day_high n_day_low", "adv20 atr_d1")


@query("stream_bar_continuity", """select symbol, day, et_min, arrival, case when t is null then 'first' when et_min = t then 'duplicate' when et_min < t then 'late' when et_min = t + 1 then 'next' else 'gap' end
 as continuity from (select *, max(et_min) over (partition by symbol, day order by arrival rows between unbounded preceding and 1 preceding) as t from arrive)""")
def _(t):
    b = t.bars.select("symbol", "et_date", "et_min", (F.col("et_min") * 10).cast("bigint").alias("arrival"))
    dup = b.where("et_min % 50 = 0").withColumn("arrival", F.col("arrival") + 5)
    late = b.where("et_min % 70 = 0").withColumn("arrival", F.col("arrival") + 7).withColumn("et_min", F.col("et_min") - 3)
    s, path = as_stream(t, b.unionByName(dup).unionByName(late), "continuity")
    return out(finish(sm.continuity(s), path), "symbol day et_min arrival continuity")


@query("stream_bars_from_quotes", """select symbol, session_day, minute, open, high, low, close, volume from (select symbol, session_day, receipt_ms // 60000 as minute, min_by(last, seq) filter (ok) as open, max(last) filter (ok) as high,
 min(last) filter (ok) as low, max_by(last, seq) filter (ok) as close, sum(traded)::double as volume from (select *, last_size >= case when last <= 250 then 100 when last <= 1000 then 40 when last <= 10000 then 10 else 1 end as ok,
  row_number() over (partition by symbol, session_day order by receipt_ms, seq) as n from quotes) where n > 1 group by 1, 2, 3 having count(*) filter (ok) > 0)
 where (minute + 1) * 60000 + 3000 <= (select max(receipt_ms) - 3000 from quotes)""")
def _(t):
    s, path = as_stream(t, qm.with_totals(t).drop("_h"), "quotebars")
    b = finish(sm.bars_from_quotes(s), path)
    top = qm.quotes(t).agg(F.max("receipt_ms").alias("top")).withColumn("k", F.lit(1))
    b = b.withColumn("k", F.lit(1)).join(top, "k").where((F.col("minute") + 1) * 60000 + 3000 <= F.col("top") - 3000)
    return b.select("symbol", "session_day", "minute", "open", "high", "low", "close", "volume")


CTES["qday"] = "select symbol, session_day, receipt_ms, seq, bid, ask, last, ms from quotes"


def _day_side(s):
    return f"""(select symbol, seq, last_value(case when {s} is not null and ms >= top then {s} end ignore nulls) over (partition by symbol, session_day order by receipt_ms, seq rows unbounded preceding) as {s} from (
 select *, max(case when {s} is not null then ms end) over (partition by symbol, session_day order by receipt_ms, seq) as top from qday))"""


@query("stream_quote_merge", f"""select q.symbol, q.receipt_ms, q.seq, b.bid, a.ask, l.last from quotes q join {_day_side('bid')} b using (symbol, seq) join {_day_side('ask')} a using (symbol, seq)
 join {_day_side('last')} l using (symbol, seq)""")
def _(t):
    s, path = as_stream(t, qm.quotes(t).select("symbol", "session_day", "receipt_ms", "seq", "bid", "ask", "last", "bid_ms", "ask_ms", "last_ms"), "merge")
    return finish(sm.merge_quotes(s), path).select("symbol", "receipt_ms", "seq", "bid", "ask", "last")


@query("stream_trade_cross", "select symbol, day, interval, et_min, trade_ms, or_high, round(price, 6) as price from crossing")
def _(t):
    s, path = as_stream(t, qm.trades(t), "trades")
    with unmeasured_batches(t.spark):
        crossed = finish(sm.trade_cross(s, qm.openings(t)), path)
    return out(crossed, "symbol day interval et_min trade_ms or_high", "price")


@query("stream_current_session", "select symbol, day, et_min, close from bars where day >= 4")
def _(t):
    s, path = as_stream(t, t.bars.select("symbol", "et_date", "et_min", "close"), "session")
    return out(finish(sm.current_session_only(s, "2000-01-07"), path), "symbol day et_min close")


@query("stream_startup_reconcile", "select symbol, day, et_min, close from bars where day > 2 or (day = 2 and et_min > 700) or symbol in ('S18', 'S19')")
def _(t):
    """The snapshot already holds everything up to 11:40 of session 2 for all but two symbols."""
    snap = t.bars.where("symbol not in ('S18', 'S19')").where((F.datediff("et_date", F.lit(BASE_DATE)) < 2) | ((F.datediff("et_date", F.lit(BASE_DATE)) == 2) & (F.col("et_min") <= 700)))
    limit = F.to_utc_timestamp(F.timestamp_add("MINUTE", F.lit(700), F.date_add(F.lit(BASE_DATE), 2).cast("timestamp")), "America/New_York")
    cut = snap.select("symbol").distinct().withColumn("cutoff_ts", limit)
    s, path = as_stream(t, t.bars.select("symbol", "et_date", "et_min", "ts", "close"), "startup")
    return out(finish(sm.after_cutoff(s, cut), path), "symbol day et_min close")


@query("stream_staleness_monitor", """select symbol, max(day * 1440 + et_min) as last_minute, max(day * 1440 + et_min) < (select max(day * 1440 + et_min) from bars) - 1 as stale from bars group by symbol""")
def _(t):
    s, path = as_stream(t, t.bars.select("symbol", "ts", (F.datediff("et_date", F.lit(BASE_DATE)) * 1440 + F.col("et_min")).alias("m")), "stale")
    agg = s.groupBy("symbol").agg(F.max("m").alias("last_minute"))

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/out")
    q = agg.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    last = t.spark.read.schema(agg.schema).parquet(f"{path}/out")
    top = last.agg(F.max("last_minute").alias("top")).withColumn("k", F.lit(1))
    return last.withColumn("k", F.lit(1)).join(top, "k").select("symbol", "last_minute", (F.col("last_minute") < F.col("top") - 1).alias("stale"))


@query("stream_publish", "select symbol, day, et_min, direction, trigger, row_number() over (order by day, et_min, symbol, trigger, direction) as seq from cooled")
def _(t):
    f = qr.all_fires(t).select("symbol", "et_date", "et_min", "direction", "trigger", "value")
    from ..operators import rules as ru
    s, path = as_stream(t, ru.spaced(f, ["symbol", "direction", "trigger"], 300), "publish", 1)
    w = sm.publish_to(f"{path}/out", "s1", ["et_date", "et_min", "symbol", "trigger", "direction"], "et_date")
    q = s.writeStream.foreachBatch(w).option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return out(t.spark.read.parquet(f"{path}/out"), "symbol day et_min direction trigger seq")

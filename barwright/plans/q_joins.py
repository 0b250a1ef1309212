"""As-of lookups, merges of bar sources, feed comparisons and audits."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.asof import asof
from ..functions.ordered import Smooth, recurrence
from ..operators import candles as co
from ..operators import daily as dl
from ..operators import indicators as ind
from ..operators import merging as mg
from ..operators import triggers as tr
from ..operators import universe as un
from . import q_rules as qr
from .q_conditions import fundamentals
from .q_triggers import inputs
from .registry import CTES, add_smooth, out, query

DAY = ["symbol", "et_date"]


@query("join_benchmark_latest_bar", """select b.symbol, b.day, b.et_min, s.close as bench_close, s.et_min as bench_min from bars b asof left join (select * from bars where symbol = 'S00') s
 on s.day = b.day and s.et_min <= b.et_min where b.symbol <> 'S00'""")
def _(t):
    bench = t.bars.where("symbol = 'S00'").select("et_date", "et_min", "close", F.col("et_min").alias("min"))
    per = tr.per_minute(bench, ["close", "min"])
    j = t.bars.where("symbol <> 'S00'").join(per, ["et_date", "et_min"], "left")
    return out(j, "symbol day et_min bench_close bench_min")


# sector map of the derived bars: odd symbols follow S01, even ones S02
CTES["smap"] = "select distinct symbol, case when cast(substr(symbol, 2) as int) % 2 = 1 then 'S01' else 'S02' end as etf from bars"


@query("join_sector_latest_bar", """select b.symbol, b.day, b.et_min, m.etf, s.close as sector_close, s.et_min as sector_min from bars b join smap m on m.symbol = b.symbol asof left join bars s
 on s.symbol = m.etf and s.day = b.day and s.et_min <= b.et_min""")
def _(t):
    even = F.substring("symbol", 2, 2).cast("int") % 2
    smap = t.bars.select("symbol").distinct().withColumn("etf", F.when(even == 1, "S01").otherwise("S02"))
    b = t.bars.select(*DAY, "et_min").join(smap, "symbol", "left")
    right = t.bars.join(smap.select(F.col("etf").alias("symbol")).distinct(), "symbol", "left_semi").select(
        F.col("symbol").alias("etf"), "et_date", "et_min", F.col("close").alias("sector_close"), F.col("et_min").alias("sector_min"))
    w = Window.partitionBy("etf", "et_date").orderBy("et_min")
    until = F.coalesce(F.lead("et_min").over(w) - 1, F.lit(1200))
    per = right.withColumn("_to", until).withColumn("et_min", F.explode(F.sequence("et_min", "_to"))).drop("_to")
    return out(b.join(per, ["etf", "et_date", "et_min"], "left"), "symbol day et_min etf sector_close sector_min")


@query("join_fundamentals_asof", "select symbol, day, et_min, x.m as market_cap, x.f as float_shares from fb")
def _(t):
    b = t.bars.where("session = 'rth'").select(*DAY, "et_min")
    return out(asof(b, fundamentals(t), ["symbol"], "et_date", "et_min", ["market_cap", "float_shares"]), "symbol day et_min market_cap float_shares")


CTES["q20"] = "select 'S' || lpad(cast(user_id % 20 as varchar), 2, '0') as symbol, cast(event_id // 1500 as int) as day, cast(540 + event_id % 420 as int) as et_min, event_id as seq, value from events"


@query("join_quote_at_alert", """select a.setup, a.symbol, a.day, a.et_min, arg_max(q.value, q.day::bigint * 1000000000000 + q.et_min::bigint * 100000000 + q.seq) as quote from spaced_or a left join q20 q on q.symbol = a.symbol
 and q.day * 10000 + q.et_min <= a.day * 10000 + a.et_min group by all""")
def _(t):
    i = F.col("event_id")
    q = t.raw("events").select(F.concat(F.lit("S"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0")).alias("symbol"),
                               F.date_add(F.lit("2000-01-03"), F.floor(i / 1500).cast("int")).alias("et_date"), (540 + i % 420).cast("int").alias("et_min"),
                               i.alias("seq"), F.col("value").alias("quote"))
    q = q.groupBy("symbol", "et_date", "et_min").agg(F.max_by("quote", "seq").alias("quote"))
    a = qr.or_spaced(t).select("setup", *DAY, "et_min")
    return out(asof(a, q, ["symbol"], "et_date", "et_min", ["quote"]), "setup symbol day et_min quote")


# ---- merges -----------------------------------------------------------------------------------------------------------------------------

CTES["hsrc"] = "select symbol, day, et_min, open, high, low, case when et_min % 40 = 0 then close + 1 else close end as close, volume from bars where et_min < 800"
CTES["ssrc"] = "select symbol, day, et_min, open, high, low, close, volume from bars where et_min >= 750"


def sources(t):
    cols = [*DAY, "et_min", "open", "high", "low", "close", "volume"]
    h = t.bars.where("et_min < 800").select(*cols).withColumn("close", F.when(F.col("et_min") % 40 == 0, F.col("close") + 1).otherwise(F.col("close")))
    return h, t.bars.where("et_min >= 750").select(*cols)


@query("merge_history_later_wins", """select * from ssrc union all select h.* from hsrc h anti join ssrc s on s.symbol = h.symbol and s.day = h.day and s.et_min = h.et_min""")
def _(t):
    return out(mg.later_wins(list(sources(t))), "symbol day et_min open high low close volume")


@query("merge_stream_over_history", """select symbol, day, et_min, coalesce(max(s), max(h)) as close, count(s) > 0 and count(h) > 0 as overlap, coalesce(abs(max(h) - max(s)) > 1e-4, false) as disagrees from (
 select symbol, day, et_min, close as h, null as s from hsrc union all select symbol, day, et_min, null, close from ssrc) group by all""")
def _(t):
    m = mg.stream_over_history(*sources(t))
    return out(m.withColumn("disagrees", F.coalesce("disagrees", F.lit(False))), "symbol day et_min close overlap disagrees")


@query("merge_report", """select symbol, day, count(*) filter (inh) as history_rows, count(*) filter (ins) as stream_rows, count(*) as merged_rows, count(*) filter (inh and ins) as deduplicated,
 count(*) filter (dis) as disagreements, sum(case when et_min >= 570 and p is not null then et_min - p - 1 else 0 end)::bigint as gap_minutes from (
 select *, max(case when et_min >= 570 then et_min end) over (partition by symbol, day order by et_min rows between unbounded preceding and 1 preceding) as p from (
 select coalesce(h.symbol, s.symbol) as symbol, coalesce(h.day, s.day) as day, coalesce(h.et_min, s.et_min) as et_min, h.symbol is not null as inh, s.symbol is not null as ins,
 coalesce(abs(h.close - s.close) > 1e-4, false) as dis from hsrc h full join ssrc s on h.symbol = s.symbol and h.day = s.day and h.et_min = s.et_min)) group by all""")
def _(t):
    return out(mg.merge_report(mg.stream_over_history(*sources(t))), "symbol day history_rows stream_rows merged_rows deduplicated disagreements gap_minutes")


CTES["cb5"] = """select symbol, day, cast(floor(et_min / 5) * 5 as int) as bucket, min_by(open, et_min) as open, max(high) as high, min(low) as low, max_by(close, et_min) as close, sum(volume) as volume, count(*) as n,
 count(*) filter (et_min >= 700) as nl, sum(volume) filter (et_min >= 700) as vl from bars group by all"""


@query("chart_history_upsert", """select symbol, day, bucket, coalesce(bucket >= 700 and (nl = 5 or bucket = max(bucket) over (partition by symbol, day)), false) as is_live,
 case when bucket >= 700 and (nl = 5 or bucket = max(bucket) over (partition by symbol, day)) then close else close + 0.5 end as close from cb5""")
def _(t):
    h = co.chart_buckets(t.bars, 5).withColumn("close", F.col("close") + 0.5)
    return out(mg.chart_upsert(h, t.bars.where("et_min >= 700"), 5), "symbol day bucket is_live close")


@query("chart_completed_candles", "select symbol, day, bucket, close from cb5 where bucket + 5 <= 843")
def _(t):
    return out(mg.completed_only(co.chart_buckets(t.bars, 5), 5, F.lit(843)), "symbol day bucket close")


@query("chart_indicator_values", """select c.symbol, c.day, c.slot, c.close, round(e.y, 6) as ema9, round(c.vwap, 6) as vwap from candles c left join re5x9 e on e.symbol = c.symbol and e.rpos = c.rpos
 where c.tf = 5 and c.session = 'rth'""")
def _(t):
    e = tr.candle_emas(inputs(t), 5, [9]).select(*DAY, "slot", "ema9")
    c = t.candles.where("tf = 5 and key_session = 'rth'")
    return out(c.join(e, [*DAY, "slot"], "left"), "symbol day slot close", "ema9 vwap")


@query("chart_premarket_and_prior_levels", """select p.symbol, p.day, p.pm_high, p.pm_low, c.prior_high, c.prior_low, c.prior_close from (
 select symbol, day, max(high) as pm_high, min(low) as pm_low from bars where session = 'pre' group by all) p left join ctx c using (symbol, day)""")
def _(t):
    p = co.premarket(t.bars).join(t.context.select(*DAY, "prior_high", "prior_low", "prior_close"), DAY, "left")
    return out(p, "symbol day pm_high pm_low prior_high prior_low prior_close")


# ---- comparisons and audits -------------------------------------------------------------------------------------------------------------

def alert_sets(t):
    """Fires with every fifth minute's repeated, and the same ones shifted or lost as another feed may show them."""
    a = qr.all_fires(t).select("symbol", "trigger", "direction", "et_date", "et_min").distinct()
    b = a.where("et_min % 7 <> 0").withColumn("et_min", F.col("et_min") + F.col("et_min") % 3)
    return a.unionByName(a.where("et_min % 5 = 0")), b


CTES["alist"] = "select distinct symbol, trigger, direction, day, et_min from fx"
CTES["asets"] = """select symbol, trigger, direction, day, coalesce(list(et_min order by et_min) filter (side = 'a'), []) as al, coalesce(list(et_min order by et_min) filter (side = 'b'), []) as bl from (
 select *, 'a' as side from alist union all select *, 'a' from alist where et_min % 5 = 0 union all select * replace (et_min + et_min % 3 as et_min), 'b' from alist where et_min % 7 <> 0) group by all"""
CTES["amatch"] = """select symbol, trigger, direction, day, al, bl, 0 as n, null::bigint as pick, []::bigint[] as used from asets union all
 select symbol, trigger, direction, day, al, bl, n + 1, p, case when p is null then used else list_append(used, p) end from (
  select *, list_sort(list_transform(list_filter(range(1, len(bl) + 1), lambda i: abs(bl[i] - al[n + 1]) <= 3 and not list_contains(used, i)), lambda i: [abs(bl[i] - al[n + 1]), bl[i], i]))[1][3] as p
  from amatch where n < len(al))"""


@query("feed_alert_matching", """select symbol, trigger, direction, day, case when pick is null then 'a' else 'both' end as side, al[n] as a_min, bl[pick] as b_min from amatch where n > 0
 union all select symbol, trigger, direction, day, 'b', null, bl[i] from (select *, unnest(range(1, len(bl) + 1)) as i from amatch where n = len(al)) where not list_contains(used, i)""")
def _(t):
    a, b = alert_sets(t)
    return out(mg.match_alerts(a, b, ["symbol", "trigger", "direction"]), "symbol trigger direction day side a_min b_min")


CTES["lbx"] = "select symbol, day, close, cum_volume, vwap, day_high from lastbar"


@query("feed_state_diff", """select tier, field, count(*) as n, round(median(d), 6) as median_diff, round(median(abs(d)), 6) as median_abs, round(max(abs(d)), 6) as worst_abs from (
 select case when r.rank <= 300 then 'top' else 'middle' end as tier, f.field, (f.b - f.a) / nullif(f.a, 0) * 100 as d from (
  select symbol, day, 'close' as field, close as a, close * (1 + (cast(substr(symbol, 2) as int) - 5) / 1000.0::double) as b from lbx union all
  select symbol, day, 'cum_volume', cum_volume, cum_volume - 100 from lbx) f join (select symbol, day, row_number() over (partition by day order by adv20 * prior_close desc nulls last, symbol) as rank from ctx) r using (symbol, day)) where d is not null group by all""")
def _(t):
    s = qr.latest(t).select(*DAY, "close", "cum_volume")
    r = un.liquidity_rank(t.context, ["et_date"]).select(*DAY, "tier")
    a = s.join(r, DAY)
    b = s.withColumn("close", F.col("close") * (1 + (F.substring("symbol", 2, 2).cast("int") - 5) / F.lit(1000.0))).withColumn("cum_volume", F.col("cum_volume") - 100)
    return out(mg.state_diff(a, b, ["close", "cum_volume"], DAY, ["tier"]), "tier field n", "median_diff median_abs worst_abs")


CTES["dtr1"] = "select symbol, pos, d, close, case when pc is null then high - low else greatest(high - low, abs(high - pc), abs(low - pc)) end as tr from dtr"
CTES["datr_legacy"] = """select symbol, pos, tr as y from dtr1 where pos = 1 union all select s.symbol, s.pos, 0.2::double * s.tr + 0.8::double * r.y from datr_legacy r join dtr1 s on s.symbol = r.symbol and s.pos = r.pos + 1"""


def two_atrs(t):
    d = ind.true_range(dl.with_pos(t.daily, "d"), ["symbol"], "pos", "_t").withColumn("tr", F.coalesce("_t", F.col("high") - F.col("low")))
    return recurrence(d, ["symbol"], "pos", [Smooth("atr_new", "_t", 5, wilder=True, start=2), Smooth("atr_old", "tr", 5, wilder=True, seed_first=True)])


@query("audit_atr_seed_flips", """select symbol, count(*) as sessions, count(*) filter (a.y / d.close * 100 >= 500 <> (l.y / d.close * 100 >= 500)) as flips, round(max(abs(a.y - l.y)), 6) as max_delta
 from dpos d join datr5 a using (symbol, pos) join datr_legacy l using (symbol, pos) group by symbol""".replace("a.y / d.close * 100 >= 500 <>", "(a.y / d.close * 100 >= 500) <>"))
def _(t):
    x = two_atrs(t).where("atr_new is not null")
    over = lambda c: F.col(c) / F.col("close") * 100 >= 500
    g = x.groupBy("symbol").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(over("atr_new") != over("atr_old")).alias("flips"),
                                F.max(F.abs(F.col("atr_new") - F.col("atr_old"))).alias("max_delta"))
    return out(g, "symbol sessions flips", "max_delta")


@query("audit_indicator_parity", """select symbol, min(pos) as first_valid, count(*) as compared, round(max(abs(a.y - l.y)), 6) as max_abs, round(max_by(a.y, pos), 6) as last_a, round(max_by(l.y, pos), 6) as last_b
 from datr5 a join datr_legacy l using (symbol, pos) group by symbol""")
def _(t):
    return out(mg.parity(two_atrs(t), "atr_new", "atr_old", "pos", ["symbol"]), "symbol first_valid compared", "max_abs last_a last_b")

"""Registered queries, each next to the SQL that must give the same rows."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import BASE_DATE, Tables, tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
BODIES: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            BODIES[name] = sql
        return fn
    return deco


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the named table expressions it (transitively) refers to."""
    known = {**CTES, **(extra or {})}
    order: list[str] = []

    def visit(text: str):
        for word in dict.fromkeys(re.findall(r"\b[a-z_][a-z0-9_]*\b", text)):
            if word in known and word not in order and word not in active:
                active.append(word)
                visit(known[word])
                active.remove(word)
                order.append(word)
    active: list[str] = []
    visit(body)
    if not order:
        return body.strip()
    return "with recursive " + ",\n".join(f"{n} as ({known[n].strip()})" for n in order) + "\n" + body.strip()


def out(df: DataFrame, keep: str, rounded: str = "", digits: int = 6) -> DataFrame:
    """Final projection: ``keep`` as is (``day`` = session number), ``rounded`` to six (or four) digits."""
    cols = []
    for c in keep.split():
        cols.append(F.datediff("et_date", F.lit(BASE_DATE)).alias("day") if c == "day" else F.col(c))
    return df.select(*cols, *[round_to(F.col(c), digits).alias(c) for c in rounded.split()])


def round_to(c, digits: int = 6):
    """Rounding in plain double arithmetic, the same in both engines.  The boundary lies off the decimal grid: prices are
    short decimals, and their exact halves would otherwise round by the last bit of a sum."""
    return F.floor(c * F.lit(10.0 ** digits) + F.lit(0.4987654)) / F.lit(10.0 ** digits)


def spell_round(sql: str) -> str:
    """Write every ``round(x, 6)`` and ``round(x, 4)`` of a query as the same arithmetic."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[at + 6:end - 1]
        if inner[-3:] in (", 6", ", 4"):
            sql = f"{sql[:at]}(floor(({inner[:-3]}) * 1e{inner[-1]} + 0.4987654::double) / 1e{inner[-1]}){sql[end:]}"
        at += 6
    return sql


def r6(cols: str) -> str:
    """SQL list of the same rounded columns."""
    return ", ".join(f"round({c}, 6) as {c}" for c in cols.split())


def oracles() -> dict[str, str]:
    return {name: spell_round(with_ctes(body)) for name, body in BODIES.items()}


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, fn=fn: fn(tables(spark, sf_dir))) for name, fn in QUERIES.items()}


# ---- shared table expressions ------------------------------------------------------------------------------------------

CTES["bars"] = """
select symbol, cast(floor(r / 420) as int) as day, cast(540 + (r % 420) as int) as et_min,
       coalesce(ppx, px) as open, greatest(coalesce(ppx, px), px) * (1 + l_discount / 100) as high,
       least(coalesce(ppx, px), px) * (1 - l_tax / 100) as low, px as close, l_quantity * 100 as volume,
       case when 540 + (r % 420) < 570 then 'pre' else 'rth' end as session,
       case when (540 + (r % 420)) % 2 = 0 then 'stream' else 'history' end as source
from (select *, lag(px) over (partition by symbol order by r) as ppx from (
        select 'S' || lpad(cast(l_suppkey % 20 as varchar), 2, '0') as symbol, l_orderkey, l_discount, l_tax, l_quantity,
               l_extendedprice / l_quantity / 10.0 as px,
               row_number() over (partition by l_suppkey % 20 order by l_shipdate, l_orderkey, l_linenumber, l_suppkey,
                                  l_partkey, l_extendedprice) - 1 as r
        from lineitem))
where l_orderkey % 97 <> 0
"""
CTES["daily"] = """
select 'S' || lpad(cast(l_suppkey as varchar), 3, '0') as symbol, cast(l_shipdate as date) as d,
       min_by(px, ord) as open, max(px) as high, min(px) as low, max_by(px, ord) as close, sum(l_quantity) * 100 as volume
from (select *, l_extendedprice / l_quantity / 10.0 as px, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey as ord
      from lineitem)
group by 1, 2
"""
CTES["dpos"] = "select *, row_number() over (partition by symbol order by d) as pos from daily"
CTES["state"] = """
select *, case when session = 'rth' then lag(close, 15) over sw end as close_15ago,
       case when session = 'rth' then min(low) over (sw rows between 4 preceding and current row) end as stop_low,
       case when session = 'rth' then max(high) over (sw rows between 4 preceding and current row) end as stop_high
from (select *, lag(close) over w as prev_close,
        max(case when session = 'rth' then high end) over (w rows unbounded preceding) as day_high,
        min(case when session = 'rth' then low end) over (w rows unbounded preceding) as day_low,
        max(case when session = 'rth' then high end) over (w rows between unbounded preceding and 1 preceding) as prev_day_high,
        min(case when session = 'rth' then low end) over (w rows between unbounded preceding and 1 preceding) as prev_day_low,
        max(high) over (w rows unbounded preceding) as ext_high, min(low) over (w rows unbounded preceding) as ext_low,
        max(high) over (w rows between unbounded preceding and 1 preceding) as prev_ext_high,
        min(low) over (w rows between unbounded preceding and 1 preceding) as prev_ext_low,
        max(case when session = 'pre' then high end) over (w rows unbounded preceding) as pm_high,
        min(case when session = 'pre' then low end) over (w rows unbounded preceding) as pm_low,
        sum(case when session = 'pre' then volume end) over (w rows unbounded preceding) as pm_volume,
        last_value(case when session = 'pre' then close end ignore nulls) over (w rows unbounded preceding) as pm_last,
        first_value(case when session = 'rth' then open end ignore nulls) over (w rows unbounded preceding) as session_open,
        first_value(case when et_min = 600 then open end ignore nulls) over (w rows unbounded preceding) as open_10am,
        sum(case when session = 'rth' then volume end) over (w rows unbounded preceding) as cum_volume,
        sum(case when session = 'rth' then (high + low + close) / 3 * volume end) over (w rows unbounded preceding)
          / nullif(sum(case when session = 'rth' then volume end) over (w rows unbounded preceding), 0) as vwap,
        last_value(case when session = 'rth' then close end ignore nulls) over (w rows unbounded preceding) as last_close,
        count(case when session = 'rth' then 1 end) over (w rows unbounded preceding) as rth_n
      from bars window w as (partition by symbol, day order by et_min))
window sw as (partition by symbol, day, session order by et_min)
"""
CTES["candles"] = """
select *, case when covered then row_number() over (partition by symbol, tf, series, covered order by day, start_min) end as cpos,
  coalesce(sum(covered::int) over (partition by symbol, tf, series order by day, start_min
           rows between unbounded preceding and 1 preceding), 0)::bigint as cbefore,
  case when isr then row_number() over (partition by symbol, tf, series, isr order by day, start_min) end as rpos,
  coalesce(sum(isr::int) over (partition by symbol, tf, series order by day, start_min
           rows between unbounded preceding and 1 preceding), 0)::bigint as rbefore
from (select *, covered and session = 'rth' as isr from (
  select symbol, day, tf, session, cast(floor((et_min - case when session = 'pre' then 240 else 570 end) / tf) as int) as slot,
    case when tf >= 5 then -1 else day end as series,
    min_by(open, et_min) as open, max(high) as high, min(low) as low, max_by(close, et_min) as close, sum(volume) as volume,
    max_by(vwap, et_min) as vwap, min(et_min) as start_min, max(et_min) as last_min, cast(count(*) as int) as n_bars,
    max(case when et_min = lastm then nmin end) as done_min, max(case when et_min = lastm then nsess end) as done_session,
    count(*) = tf and min(et_min) % 1 = 0
      and min(et_min) = (case when session = 'pre' then 240 else 570 end)
          + cast(floor((min(et_min) - case when session = 'pre' then 240 else 570 end) / tf) as int) * tf
      and max(et_min) = min(et_min) + tf - 1 as covered
  from (select *, max(et_min) over (partition by symbol, day, tf, session,
               floor((et_min - case when session = 'pre' then 240 else 570 end) / tf)) as lastm
        from (select *, lead(et_min) over (partition by symbol, day order by et_min) as nmin,
                     lead(session) over (partition by symbol, day order by et_min) as nsess from state)
        cross join (select unnest([1, 2, 3, 5, 15, 30, 60]) as tf))
  group by symbol, day, tf, session, slot))
"""
CTES["sessions"] = """
select symbol, day, min_by(open, et_min) as open, max(high) as high, min(low) as low, max_by(close, et_min) as close,
       sum(volume) as volume, row_number() over (partition by symbol order by day) as pos
from bars where session = 'rth' group by symbol, day
"""


def smooth_cte(src: str, keys: str, value: str, n: int, wilder: bool = False, start: int = 1, name: str = "y",
               pos: str = "pos") -> str:
    """Recursive SQL for a seeded moving average over ``src`` (numbered by ``pos``); used inside its own CTE."""
    k = 1.0 / n if wilder else 2.0 / (n + 1)
    on = " and ".join(f"s.{x.strip()} = r.{x.strip()}" for x in keys.split(","))
    seed = start + n - 1
    return (f"select {keys}, max({pos}) as {pos}, avg({value}) as {name} from {src} where {pos} between {start} and {seed} "
            f"group by {keys} having count(*) = {n} union all select {', '.join('s.' + x.strip() for x in keys.split(','))}, "
            f"s.{pos}, {k!r}::double * s.{value} + (1 - {k!r}::double) * r.{name} from SELF r join {src} s on {on} "
            f"and s.{pos} = r.{pos} + 1")


def add_smooth(cte: str, *args, **kw) -> None:
    CTES[cte] = smooth_cte(*args, **kw).replace("SELF", cte)

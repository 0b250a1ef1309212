"""Detectors on hand-made bars and against sequential models."""
import datetime

import pytest
from pyspark.sql import functions as F

from barwright.operators import candles as co
from barwright.operators import state as st
from barwright.operators import triggers as tr
from barwright.plans.tables import tables

D = datetime.date(2024, 1, 2)
SF = "/root/testdata/sf0.001"
CTX = ["prior_close", "atr_d1"]


def inputs(spark, rows):
    """rows: (et_min, open, high, low, close, volume)."""
    bars = spark.createDataFrame([("X", D, r[0], *map(float, r[1:])) for r in rows],
                                 "symbol string, et_date date, et_min int, open double, high double, low double, close double, volume double")
    bars = bars.withColumn("session", F.expr("case when et_min < 570 then 'pre' when et_min < 960 then 'rth' else 'post' end"))
    s = st.bar_state(bars)
    return tr.Inputs(s.withColumns({c: F.lit(100.0) for c in CTX}), co.candles(s))


def minute_bars(candles, tf=1, start=570):
    """One flat-volume bar per candle of ``tf`` = 1."""
    return [(start + i, o, h, l, c, 100) for i, (o, h, l, c) in enumerate(candles)]


def ids(df):
    return sorted((r.trigger, r.et_min) for r in df.collect())


def test_candle_patterns(spark):
    bars = minute_bars([(10, 10.2, 8.8, 9), (8.9, 10.6, 8.8, 10.5), (10, 10.1, 9.9, 10), (9, 9.5, 8.9, 9.4)])
    got = ids(tr.pair_patterns(inputs(spark, bars), 1))
    assert ("bull_engulfing", 572) in got and all(t != "bear_engulfing" for t, _ in got)


def test_completion_needs_a_next_bar_and_the_right_session(spark):
    bars = [(m, 10, 11, 9, 10.5, 100) for m in range(955, 960)] + [(960, 10, 11, 9, 10.5, 100)]
    assert ids(tr.candle_close(inputs(spark, bars), 5)) == []           # closed by a post bar
    bars = [(m, 10, 11, 9, 10.5, 100) for m in range(565, 571)]
    assert ids(tr.candle_close(inputs(spark, bars), 5)) == [("bull_candle_close", 570)]   # the 09:25 candle, seen at 09:30


def test_a_missing_minute_voids_the_candle(spark):
    bars = [(m, 10, 11, 9, 10.5, 100) for m in (570, 571, 573, 574, 575)]
    assert ids(tr.candle_close(inputs(spark, bars), 5)) == []


def test_confirmed_vwap_cross(spark):
    closes = [10, 9, 8, 12, 12.5, 9]
    bars = [(570 + i, c, c + .1, c - .1, c, 100) for i, c in enumerate(closes)]
    got = [(r.option, r.et_min) for r in tr.vwap_cross_confirmed(inputs(spark, bars), 1).collect()]
    assert sorted(got) == [("above", 575), ("below", 573)]      # at VWAP counts as the earlier side of both


def test_range_break_rearms_inside(spark):
    flat = [(570 + i, 10, 10.05, 9.95, 10, 100) for i in range(4)]
    after = [(574, 10, 10.3, 10, 10.2, 500), (575, 10.2, 10.3, 10, 10.2, 100), (576, 10.2, 10.2, 10, 10.1, 100), (577, 10.1, 11, 10.1, 10.9, 900)]
    got = [r.et_min for r in tr.range_break(inputs(spark, flat + after), tf=1, n=2, width=5.0).where("option = 'up'").collect()]
    assert got == [574, 577]


def test_post_bars_extend_the_regular_slots(spark):
    c = co.candles(inputs(spark, [(m, 1, 1, 1, 1, 1) for m in range(955, 965)]).bars, (5,)).orderBy("start_min").collect()
    assert [(r.key_session, r.start_session, r.slot, r.covered) for r in c] == [("rth", "rth", 77, True), ("rth", "post", 78, True)]


def plain_failed_swings(candles, lookback, max_wait, pct):
    """candles of one (symbol, day, tf) in order, covered or not; yields (minute, side, level)."""
    out = []
    for side in ("high", "low"):
        pending, gaps, done = None, 0, []
        for c in candles:
            if c.done_min is None:
                continue
            if not c.covered:
                gaps += 1
                continue
            done.append(c)
            if c.done_session != "rth":
                continue
            if pending:
                level, slot, sess, g = pending
                if c.key_session != sess or c.slot - slot > max_wait or g != gaps:
                    pending = None
                elif (c.close < level) if side == "high" else (c.close > level):
                    out.append((c.done_min, side, level))
                    pending = None
                    continue
                else:
                    continue
            prev = done[-lookback - 1:-1]
            if len(prev) < lookback or any(p.key_session != c.key_session for p in prev) or [p.slot for p in prev] != list(range(c.slot - lookback, c.slot)):
                continue
            level = max(p.high for p in prev) if side == "high" else min(p.low for p in prev)
            if (c.close > level + level * pct / 100) if side == "high" else (c.close < level - level * pct / 100):
                pending = (level, c.slot, c.key_session, gaps)
    return sorted(out)


def test_failed_swings_equal_a_sequential_model(spark):
    t = tables(spark, SF)
    i = tr.Inputs(st.derived(t.state, t.context), t.candles)
    got = {}
    for r in tr.failed_swing(i, 1, lookback=4, max_wait=3).collect():
        got.setdefault((r.symbol, r.et_date), []).append((r.et_min, "high" if r.trigger.endswith("high") else "low", r.value))
    groups = {}
    for r in t.candles.where("tf = 1").orderBy("start_min").collect():
        groups.setdefault((r.symbol, r.et_date), []).append(r)
    want = {k: w for k, v in groups.items() if (w := plain_failed_swings(v, 4, 3, 0.1))}
    assert {k: sorted(v) for k, v in got.items()} == want and sum(map(len, want.values())) > 100


def test_detectors_do_not_look_ahead(spark):
    t = tables(spark, SF)
    def fired(bars):
        s = st.bar_state(bars)
        ctx = t.context
        i = tr.Inputs(st.derived(s, ctx), co.candles(s))
        f = tr.both(tr.new_extreme(i), tr.break_recent(i, 5), tr.candle_level_cross(i, 5), tr.ema_cross_ema(i, 1, 3, 9))
        return {(r.symbol, r.et_date, r.et_min, r.trigger, r.option) for r in f.collect()}
    bars = t.bars.where("et_date = date'2000-01-03'")
    full, part = fired(bars), fired(bars.where("et_min < 700"))
    assert part == {f for f in full if f[2] < 700} and part

"""Minute bars from quotes: odd lots, resets, day extremes, grace."""
import datetime
import random

import pandas as pd

from barwright.functions import ticks
from barwright.operators import quotes as qt

M = 60_000


def run(updates):
    """updates: (minute, last, size, total, day_high, day_low) -> finished bars; the same however the updates are cut into parts."""
    rows = pd.DataFrame([(m * M, *rest) for m, *rest in updates], columns=["receipt_ms", "last", "last_size", "total_volume", "day_high", "day_low"]).astype({c: "float64" for c in ("last", "last_size", "total_volume", "day_high", "day_low")})
    results = []
    for size in (len(rows), 1, 2):
        carry, out = None, []
        for lo in range(0, len(rows), size):
            bars, carry = ticks.quote_bars(rows.iloc[lo:lo + size], carry)
            out += [tuple(b) for b in bars.itertuples(index=False)]
        if carry["minute"] is not None:
            out += [tuple(b) for b in ticks.finished(pd.DataFrame([{k: carry[k] for k in ticks.BAR}])).itertuples(index=False)]
        results.append(out)
    assert results[0] == results[1] == results[2]
    return results[0]


def test_first_quote_is_a_baseline():
    assert run([(1, 10.0, 100, 1000, None, None)]) == []


def test_volume_is_the_growth_of_the_total():
    assert run([(1, 10.0, 100, 1000, None, None), (1, 10.5, 100, 1300, None, None), (1, 10.2, 100, 1500, None, None)]) == [(1, 10.5, 10.5, 10.2, 10.2, 500.0)]


def test_odd_lot_prices_do_not_count_but_their_volume_does():
    assert run([(1, 10.0, 100, 0, None, None), (1, 10.0, 100, 100, None, None), (1, 12.0, 5, 105, None, None)]) == [(1, 10.0, 10.0, 10.0, 10.0, 105.0)]


def test_only_odd_lots_make_no_bar():
    assert run([(1, 10.0, 5, 100, None, None), (1, 10.5, 5, 105, None, None), (2, 10.5, 5, 110, None, None)]) == []


def test_smaller_round_lot_for_a_high_price():
    assert len(run([(1, 500.0, 40, 0, None, None), (1, 500.0, 40, 40, None, None)])) == 1


def test_small_regression_is_ignored_and_not_counted_twice():
    assert run([(1, 10.0, 100, 1000, None, None), (1, 10.0, 100, 1200, None, None), (1, 10.0, 100, 1100, None, None), (1, 10.0, 100, 1300, None, None)])[0][-1] == 300.0


def test_reset_starts_a_new_baseline():
    assert run([(1, 10.0, 100, 1000, None, None), (1, 10.0, 100, 150, None, None)])[0][-1] == 150.0


def test_new_day_high_is_taken_exactly():
    got = run([(1, 10.0, 100, 100, 10.0, 9.0), (1, 10.1, 100, 200, 10.0, 9.0), (1, 10.1, 100, 300, 10.7, 8.5)])
    assert got == [(1, 10.1, 10.7, 8.5, 10.1, 200.0)]


def test_price_and_volume_in_separate_updates():
    assert run([(1, 10.0, 100, 100, None, None), (1, 10.4, 100, None, None, None), (1, None, None, 200, None, None)]) == [(1, 10.4, 10.4, 10.4, 10.4, 100.0)]


def test_minutes_without_trades_make_no_bar():
    got = run([(1, 10.0, 100, 100, None, None), (1, 10.0, 100, 200, None, None), (2, 10.0, 100, 200, None, None), (4, 11.0, 100, 300, None, None)])
    assert [b[0] for b in got] == [1, 4]


def cross(trades, sizes=(100, 1, 2)):
    """trades: (trade_ms, price[, good, generation]) against a range high of 100 -> stamps of the crossing, the same in any parts."""
    rows = pd.DataFrame([(ms, p, *(rest or (True, 1))) for ms, p, *rest in [(t[0], t[1], *t[2:]) for t in trades]], columns=["trade_ms", "price", "trusted", "generation"])
    rows = rows.assign(receipt_ms=rows["trade_ms"] + 100, et_min=600, interval=5, or_high=100.0, range_id="r")
    results = []
    for size in sizes:
        carry, out = None, []
        for lo in range(0, len(rows), size):
            found, carry = ticks.first_cross(rows.iloc[lo:lo + size], carry)
            out += found["trade_ms"].tolist()
        results.append(out)
    assert all(r == results[0] for r in results)
    return results[0]


def test_a_trade_crosses_within_a_continuous_stretch():
    assert cross([(1000, 99.0), (2000, 101.0), (3000, 99.0), (4000, 101.0)]) == [2000]
    assert cross([(1000, 99.0), (20_000, 101.0)]) == []
    assert cross([(1000, 101.0), (2000, 102.0)]) == []


def test_an_older_trade_breaks_the_stretch():
    assert cross([(1000, 99.0), (500, 99.0), (700, 101.0)]) == []
    assert cross([(1000, 99.0), (500, 99.0), (700, 99.0), (900, 101.0)]) == [900]
    assert cross([(1000, 99.0), (500, 99.0), (400, 99.0), (450, 101.0)]) == [450]


def test_repeats_are_passed_over_and_bad_trades_clear():
    assert cross([(1000, 99.0), (1000, 101.0), (2000, 101.0)]) == [2000]
    assert cross([(1000, 99.0), (1500, 99.0, False, 1), (2000, 101.0)]) == []
    assert cross([(1000, 99.0), (2000, 101.0, True, 2), (3000, 99.0, True, 2), (3500, 101.0, True, 2)]) == [3500]


def test_crosses_on_columns_equal_the_folded_ticks(spark):
    """Random sessions with falling, repeated and untrusted stamps, new generations and pauses: the window form against the streamed one."""
    r, day, rows = random.Random(6), datetime.date(2024, 1, 2), []
    for k in range(60):
        ms, seq = 36_000_000, 0
        for _ in range(r.randint(5, 200)):
            ms += r.choice((0, 200, 900, 900, 4000, 12_000, -500, -300, 70_000 if r.random() < 0.1 else 800))
            seq += 1
            rows.append((f"X{k}", day, ms // 60_000, ms, max(ms, 36_000_000) + seq * 0 + r.choice((50, 100, 2500 if r.random() < 0.2 else 100)), 0, 100 + r.uniform(-1, 0.4), r.randint(0, 12) // 12 + ms // 300_000, r.random() < 0.95))
    rows = [(*x[:5], n, *x[6:]) for n, x in enumerate(rows)]
    # receipt order is the order of arrival
    top, fixed = {}, []
    for x in rows:
        top[x[0]] = max(top.get(x[0], 0), x[4])
        fixed.append((*x[:4], top[x[0]], *x[5:]))
    trades = spark.createDataFrame(fixed, "symbol string, et_date date, et_min long, trade_ms long, receipt_ms long, seq long, price double, generation long, trusted boolean").repartition(5)
    opening = spark.createDataFrame([(f"X{k}", day, i, 100.0, f"r{i}") for k in range(60) for i in (5, 15)], "symbol string, et_date date, interval int, or_high double, range_id string")
    got = sorted((x.symbol, x.interval, x.trade_ms, x.price) for x in qt.trade_cross(trades, opening).collect())
    want = []
    frame = pd.DataFrame(fixed, columns=trades.columns)
    for k in range(60):
        for i in (5, 15):
            own = frame[frame["symbol"] == f"X{k}"].sort_values(["receipt_ms", "seq"]).assign(interval=i, or_high=100.0, range_id=f"r{i}")
            found, _ = ticks.first_cross(own, None)
            want += [(x.symbol, x.interval, x.trade_ms, x.price) for x in found.itertuples()]
    assert got == sorted(want) and len(want) > 30

"""Worked examples."""
import pytest
from pyspark.sql import functions as F

from barwright.functions import clock
from barwright.functions.ordered import segments
from barwright.operators import indicators as ind
from barwright.operators import state as st

K = ["symbol"]


def series(spark, rows, cols="high double, low double, close double"):
    return spark.createDataFrame([("X", i, *r) for i, r in enumerate(rows, 1)], f"symbol string, pos long, {cols}")


def values(df, col):
    return [r[0] for r in df.orderBy("pos").select(col).collect()]


def test_ema_of_1_to_22(spark):
    df = series(spark, [(float(i),) for i in range(1, 23)], "close double")
    e = ind.ema(df, K, "pos", {"e9": 9, "e21": 21})
    e9, e21 = values(e, "e9"), values(e, "e21")
    assert e9[:8] == [None] * 8 and e9[8] == pytest.approx(5) and e9[-1] == pytest.approx(18)
    assert e21[20] == pytest.approx(11) and e21[21] == pytest.approx(12) and e21[19] is None


def test_atr_seed_and_first_step(spark):
    df = series(spark, [(100 + r / 2, 100 - r / 2, 100.0) for r in (1, 2.5, 4, 5, 2)])
    assert values(ind.atr(df, K, "pos", {"a": 3}), "a") == [None, None, None, pytest.approx(23 / 6), pytest.approx(29 / 9)]


def test_atr_restarts_after_a_missing_high(spark):
    rows = [(None if i == 2 else 100 + r / 2, 100 - r / 2, 100.0) for i, r in enumerate(range(1, 8))]
    df = series(spark, rows).withColumn("c", F.lit(0)).withColumnRenamed("pos", "i")
    s = segments(df, K, ["c"], ["i"], ["high", "low", "close"])
    got = {r.i: r.a for r in ind.atr(s, ["symbol", "seg"], "pos", {"a": 3}).collect()}
    assert {i for i, a in got.items() if a is not None} == {7} and got[7] == pytest.approx(6.0)


def test_rrs_first_value(spark):
    rows = [(10.0 + i + 1, 10.0 + i - 1, 10.0 + i + 0.0, 101.0, 99.0, 100.0) for i in range(4)]
    df = series(spark, rows, "high double, low double, close double, bench_high double, bench_low double, bench_close double")
    r = values(ind.rrs(df, K, "pos", 3), "rrs_raw")
    assert r[:3] == [None] * 3 and r[3] == pytest.approx(3 / 2)       # moved 3, true range 2, flat benchmark


def test_adx_of_a_one_way_trend_is_100(spark):
    df = series(spark, [(101.0 + i, 99.0 + i, 100.0 + i) for i in range(40)])
    a = values(ind.adx(df, K, "pos", 5), "adx")
    assert a[:9] == [None] * 9 and a[9] == pytest.approx(100) and a[-1] == pytest.approx(100)


def test_rsi_all_gains(spark):
    assert values(ind.rsi(series(spark, [(1.0, 1.0, float(i)) for i in range(1, 20)]), K, "pos", 14), "rsi")[14] == pytest.approx(100)


def test_studies_agree_with_the_single_functions(spark):
    import random
    rnd = random.Random(1)
    rows = []
    for _ in range(120):
        o = rnd.uniform(90, 110)
        rows.append((o + rnd.uniform(0, 3), o - rnd.uniform(0, 3), o + rnd.uniform(-1, 1), float(rnd.randint(1, 9) * 100)))
    df = series(spark, rows, "high double, low double, close double, volume double").withColumn("open", F.col("close"))
    whole = {r.pos: r for r in ind.studies(df, K, "pos").collect()}
    for fn, cols in ((ind.rsi, ["rsi"]), (ind.cci, ["cci"]), (ind.obv, ["obv"]), (ind.macd, ["macd", "macd_signal", "macd_hist"]), (ind.stoch, ["stoch_k", "stoch_d"]),
                     (ind.bbands, ["bb_lower", "bb_width", "bb_percent_b"]), (ind.adx, ["adx", "plus_di", "minus_di"])):
        for r in fn(df, K, "pos").collect():
            for c in cols:
                assert (r[c] is None) == (whole[r.pos][c] is None) and (r[c] is None or r[c] == pytest.approx(whole[r.pos][c])), (c, r.pos)


def test_no_look_ahead(spark):
    rows = [(100.0 + (i * 7) % 13, 90.0 + (i * 5) % 7, 95.0 + (i * 3) % 9) for i in range(60)]
    full, part = series(spark, rows), series(spark, rows[:40])
    for fn, col in ((lambda d: ind.rsi(d, K, "pos"), "rsi"), (lambda d: ind.adx(d, K, "pos", 7), "adx"), (lambda d: ind.macd(d, K, "pos"), "macd_hist")):
        assert values(fn(full), col)[:40] == [None if v is None else pytest.approx(v) for v in values(fn(part), col)]


def test_rvol_is_one_at_the_normal_pace(spark):
    import datetime
    d = datetime.date(2024, 1, 2)
    prof = spark.createDataFrame([("X", d, s, 500.0) for s in range(0, 390, 5)], "symbol string, et_date date, slot int, mean_volume double")
    bars = spark.createDataFrame([("X", d, m, "rth", 100.0 * (m - 569)) for m in range(570, 960)], "symbol string, et_date date, et_min int, session string, cum_volume double")
    assert all(r.rvol == pytest.approx(1.0) for r in st.rvol(bars, prof).collect())


def test_volume_profile_knows_earlier_sessions_only(spark):
    import datetime
    from barwright.operators import candles as co
    days = [datetime.date(2024, 1, 2) + datetime.timedelta(days=k) for k in range(25)]
    bars = spark.createDataFrame([("X", d, m, 10.0 * (k + 1)) for k, d in enumerate(days) for m in range(570, 580)], "symbol string, et_date date, et_min int, volume double")
    full = {(r.et_date, r.slot): r.mean_volume for r in co.volume_profile(bars).collect()}
    part = {(r.et_date, r.slot): r.mean_volume for r in co.volume_profile(bars.where(F.col("et_date") <= F.lit(days[12]))).collect()}
    assert all(full[k] == v for k, v in part.items()) and len(part) == 13 * 78
    assert full[days[0], 0] is None and full[days[1], 5] == 50.0 and full[days[24], 0] == pytest.approx(50.0 * sum(range(5, 25)) / 20) and full[days[24], 10] is None


def test_clock_on_both_sides_of_the_spring_change(spark):
    df = spark.sql("select * from values (timestamp'2024-03-08 14:30:00'), (timestamp'2024-03-11 13:30:00'), (timestamp'2024-03-11 20:00:00') t(ts)")
    got = [(str(r.et_date), r.et_min, r.session) for r in clock.add_clock(df).orderBy("ts").collect()]
    assert got == [("2024-03-08", 570, "rth"), ("2024-03-11", 570, "rth"), ("2024-03-11", 960, "post")]

"""How the work is dealt: buckets by rows, candles without a sort or a second exchange, one acceptance a report, several files a micro-batch."""
import datetime
import uuid

from pyspark.sql import functions as F

from barwright.functions import clock
from barwright.operators import candles as co
from barwright.operators import rules as ru
from barwright.operators import state as st
from barwright.plans import q_streaming as qs
from barwright.session import ROWS_PER_BUCKET, bucket_count, shared_dir, shuffle_partitions, write_bucketed

D = datetime.date(2024, 1, 2)


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_follow_the_rows_and_not_the_packed_bytes(spark):
    path = f"{shared_dir(spark)}/buckets-{uuid.uuid4().hex[:8]}"
    spark.range(20 * ROWS_PER_BUCKET + 1).select(F.lit(1).alias("l_quantity")).coalesce(1).write.parquet(path)     # a few kilobytes
    assert bucket_count(spark.read.parquet(path)) == 21


def minute_bars(spark):
    rows = [("X", D, m, "pre" if m < 570 else "rth" if m < 960 else "post", 1.0 + m % 7, 9.0, 0.5, 2.0 + m % 5, 10.0) for m in range(560, 966) if m % 50]
    return spark.createDataFrame(rows, "symbol string, et_date date, et_min int, session string, open double, high double, low double, close double, volume double")


def test_candles_of_a_stored_state_are_hashed_where_they_lie(spark):
    name = f"scale_{uuid.uuid4().hex[:8]}"
    state = write_bucketed(st.bar_state(minute_bars(spark)), name, ["symbol", "et_date"], ["et_min"], 6)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    with shuffle_partitions(spark, 6):
        plan = physical(co.candles(state))
    assert "SortAggregate" not in plan
    # only the counts per (symbol, date) travel: candle rows would bring their highs along
    assert not [line for line in plan.splitlines() if "Exchange" in line and "high" in line]
    assert plan.count("Exchange") == 2
    last = {(r.tf, r.start_min): (r.done_min, r.done_session) for r in co.candles(state).collect()}
    assert last[1, 569] == (570, "rth") and last[1, 959] == (960, "post") and last[1, 965] == (None, None)
    assert set(clock.SESSIONS) == {"pre", "rth", "post"}


def test_report_judges_each_alert_once(spark):
    rows = [("s", "X", D, 600, "sent"), ("s", "X", D, 640, "waiting"), ("s", "X", D, 645, "blocked"), ("t", "X", D, 611, "sent"), ("t", "Y", D, 611, "repeat")]
    outcomes = spark.createDataFrame(rows, "setup string, symbol string, et_date date, et_min int, outcome string")
    report = ru.activity(outcomes, 30)
    assert "Join" not in physical(report)
    assert sorted((r.setup, r.symbol, r.status, r.events) for r in report.collect()) == [("s", "X", "blocked", 2), ("t", "Y", "repeat", 1)]


def test_a_micro_batch_is_a_part_of_many_files(spark):
    path = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex[:8]}"
    b = spark.range(0, 300, 1, 4)
    seen = {}

    def write(batch, number):
        seen[number] = (batch.count(), batch.select(F.input_file_name()).distinct().count())
    qs.in_batches(type("T", (), {"spark": spark}), [b.where("id < 150"), b.where("id between 150 and 151"), b.where("id > 151")], path, b.schema,
                  lambda s: s.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start())
    assert [seen[n][0] for n in sorted(seen)] == [150, 2, 148]
    assert seen[0][1] > 1 and seen[2][1] > 1


def test_candles_of_one_timeframe_are_those_of_all(spark):
    state = st.bar_state(minute_bars(spark).union(minute_bars(spark).withColumn("et_date", F.date_add("et_date", 1))))
    columns = sorted(co.candles(state).columns)
    rows = lambda c: sorted((tuple(r) for r in c.select(*columns).collect()), key=repr)
    for tf in (2, 5, 60):
        assert rows(co.candles(state, (tf,))) == rows(co.candles(state).where(F.col("tf") == tf))


def test_alerts_build_the_candles_they_read(spark, monkeypatch):
    from barwright.plans import q_rules, tables
    asked, made = [], co.candles
    monkeypatch.setattr(tables.candle_ops, "candles", lambda state, *tfs: asked.append(tfs) or made(state, *tfs))
    q_rules.all_fires(tables.Tables(spark.newSession(), "/root/testdata/sf0.001/."))
    assert asked == [((5,),)]


def test_minutes_of_a_combination_are_spread_without_a_sort_or_a_second_exchange(spark):
    rows = [("s", mode, "X", D, m, 0, 2, 2, 2, ["rth"], i, f"t{i}", "t", "", "long", 0) for mode in ("and", "or") for m, i in ((600, 0), (600, 1), (602, 1))]
    matched = spark.createDataFrame(rows, "setup string, mode string, symbol string, et_date date, et_min int, repeat_sec int, and_window_min int, min_triggers int, n_triggers int, "
                                          "sessions array<string>, idx int, instance string, trigger string, option string, direction string, trigger_repeat int")
    spread = ru.evaluation_rows(matched)
    plan = physical(spread)
    assert "SortAggregate" not in plan and plan.count("Exchange") == 1
    got = sorted((r["mode"], r.et_min, [h.instance for h in r.hits or []]) for r in spread.collect())
    assert got == [("and", 600, ["t0", "t1"]), ("and", 601, []), ("and", 602, ["t1"]), ("and", 603, []), ("and", 604, []), ("and", 605, []),
                   ("or", 600, ["t0", "t1"]), ("or", 602, ["t1"])]


def test_alerts_store_the_columns_they_read(spark):
    """Not the whole state, which has twice as many; where the whole state is there it is read."""
    from barwright.plans import q_rules, tables
    t = tables.Tables(spark.newSession(), "/root/testdata/sf0.001/./")
    alerts = q_rules.alerts(t)
    assert "state" not in t.__dict__ and t.alert_state.columns == tables.ALERT_STATE and t.alert_state.count() == t.bars.count()
    u = tables.Tables(spark.newSession(), "/root/testdata/sf0.001/././")
    assert len(u.state.columns) > len(tables.ALERT_STATE) and u.alert_state is u.state
    assert sorted(map(repr, alerts.collect())) == sorted(map(repr, q_rules.alerts(u).collect()))

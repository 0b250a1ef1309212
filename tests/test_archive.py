"""Legacy identities and retention of the alert archive, exact quantiles, the gap plan on month bins."""
import datetime
import os

from pyspark.sql import functions as F

from barwright.functions import quantiles as qn
from barwright.operators import merging, universe
from barwright.sources import archive, history, schemas

D = datetime.date


def stored(spark, folder):
    """Three equal legacy lines and one other in one file, one of them in a second file, and a modern row per day."""
    line = {"symbol": "A", "setup": "s", "direction": "long", "trigger": "hod", "ts": "2024-01-03T10:00:00Z", "price": 1.5}
    lines = [line, line, line | {"price": 2.5}, line | {"event_id": "s1:1", "session_id": "s1", "mode": "live", "source": "x"}]
    for day, rows in (("2024-01-01", [lines[3]]), ("2024-01-02", lines[:1]), ("2024-01-03", lines)):
        part = spark.createDataFrame([(str(r).replace("'", '"'),) for r in rows], "value string").coalesce(1)
        part.write.mode("append").text(f"{folder}/session_date={day}")


def test_equal_legacy_lines_keep_ids_of_their_own(spark, tmp_path):
    path = str(tmp_path / "alerts")
    stored(spark, path)
    read = lambda: archive.read_recent(spark, path, schemas.ALERTS, "2024-01-03", 2)
    rows = read().collect()
    assert len(rows) == 5 and len({r["event_id"] for r in rows}) == 5
    legacy = [r for r in rows if r["event_id"].startswith("legacy:")]
    assert len(legacy) == 4 and {(r["mode"], r["session_id"], r["source"]) for r in legacy} == {("unknown", "legacy", "unknown")}
    assert [r["event_id"] for r in rows if r["mode"] == "live"] == ["s1:1"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")  # another split of the files, the same ids
    try:
        assert {r["event_id"] for r in read().collect()} == {r["event_id"] for r in rows}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_expired_days_are_gone_and_stay_gone(spark, tmp_path):
    path = str(tmp_path / "alerts")
    stored(spark, path)
    os.makedirs(f"{path}/other")
    assert archive.expire(spark, path, "2024-01-03", 2) == ["2024-01-01"]
    assert sorted(os.listdir(path)) == ["other", "session_date=2024-01-02", "session_date=2024-01-03"]
    assert archive.expire(spark, path, "2024-01-03", 2) == []
    assert archive.expire(spark, str(tmp_path / "none"), "2024-01-03", 2) == []


def test_a_retention_that_was_cut_short_is_finished(spark, tmp_path):
    path = str(tmp_path / "alerts")
    stored(spark, path)
    os.makedirs(f"{path}/_retention")
    open(f"{path}/_retention/before-2024-01-03", "w").close()
    assert spark.read.schema(schemas.ALERTS).json(path).count() == 6  # readers pass the marker over
    assert archive.expire(spark, path, "2024-01-01", 5) == ["2024-01-01", "2024-01-02"]
    assert sorted(os.listdir(path)) == ["session_date=2024-01-03"]


def compared(df, by, wanted, **options):
    got = {tuple(r[b] for b in by): r for r in qn.quantiles(df, by, "x", wanted, **options).collect()}
    want = df.where("x is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("largest"), *[F.percentile("x", s).alias(k) for k, s in wanted.items()]).collect()
    assert len(got) == len(want)
    for r in want:
        g = got[tuple(r[b] for b in by)]
        assert (g["n"], g["largest"]) == (r["n"], r["largest"])
        for k in wanted:
            assert abs(g[k] - r[k]) <= 1e-12 * max(1.0, abs(r[k])), (k, g, r)


def test_quantiles_equal_the_gathered_ones(spark):
    """A hot group of 60,000 rows beyond the whole-group size, many ties, nulls, null groups, a group of one row."""
    k = F.col("id")
    x = F.when(k % 7 == 0, 0.0).when(k % 11 == 0, None).otherwise(F.sin(k.cast("double")) * F.exp((k % 13).cast("double")))
    g = F.when(k % 3 > 0, "hot").when(k == 0, "one").when(k % 5 == 0, F.lit(None)).otherwise((k % 4).cast("string"))
    df = spark.range(90_000).select(g.alias("g"), x.alias("x")).repartition(7)
    wanted = {"least": 0.0, "p05": 0.05, "mid": 0.5, "p95": 0.95, "most": 1.0}
    compared(df, ["g"], wanted)
    compared(df, ["g"], wanted, groups=2)  # brackets joined instead of sent
    compared(df.withColumn("x", F.lit(3.0)), ["g"], wanted)
    assert qn.quantiles(df.limit(0), ["g"], "x", wanted).count() == 0


def test_no_task_gathers_a_hot_group(spark):
    df = spark.range(200_000).select((F.col("id") % 1).alias("g"), F.sin(F.col("id").cast("double")).alias("x"))
    plan = qn.quantiles(df, ["g"], "x", {"mid": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "BroadcastNestedLoopJoin" not in plan
    compared(df, ["g"], {"mid": 0.5, "p999": 0.999})


def test_feed_and_universe_comparisons(spark):
    a = spark.createDataFrame([(f"S{k}", "t", float(k), 10.0) for k in range(5)], "symbol string, tier string, close double, volume double")
    b = spark.createDataFrame([(f"S{k}", "t", k * 1.1, 9.0 + k) for k in range(5)], "symbol string, tier string, close double, volume double")
    d = {r["field"]: r for r in merging.state_diff(a, b, ["close", "volume"], ["symbol"], ["tier"]).collect()}
    assert d["close"]["n"] == 4 and abs(d["close"]["median_diff"] - 10) < 1e-9  # a zero has no percent difference
    assert (d["volume"]["n"], round(d["volume"]["median_diff"], 9), round(d["volume"]["median_abs"], 9), round(d["volume"]["worst_abs"], 9)) == (5, 10.0, 10.0, 30.0)
    r = {x["metric"]: x for x in universe.metric_ratios(a, b, ["close", "volume"]).collect()}
    assert r["volume"]["n"] == 5 and abs(r["volume"]["median_ratio"] - 1.1) < 1e-12 and abs(r["volume"]["p05"] - 0.92) < 1e-12


def test_gap_plan_meets_the_calendar_on_months(spark):
    """Spans inside a month, across a year's end, without a session and turned round; the plan has no nested loop."""
    requests = spark.createDataFrame([("A", D(2024, 1, 2), D(2024, 1, 9)), ("B", D(2023, 11, 20), D(2024, 2, 10)), ("C", D(2024, 1, 6), D(2024, 1, 7)), ("D", D(2024, 3, 5), D(2024, 3, 1))],
                                     "symbol string, start date, end date")
    calendar = spark.sql("select explode(sequence(date'2023-11-01', date'2024-03-31')) as session_date").where("dayofweek(session_date) between 2 and 6")
    bounds = spark.createDataFrame([("A", D(2024, 1, 4), D(2024, 1, 9), True), ("B", D(2023, 11, 20), D(2024, 1, 31), True), ("C", D(2024, 1, 6), D(2024, 1, 7), True)],
                                   "symbol string, first_date date, last_date date, ok boolean")
    coverage = spark.createDataFrame([], "symbol string, start date, end date")
    out = history.plan(requests, bounds, coverage, calendar)
    got = {(r["symbol"], r["mode"], r["span_start"], r["span_end"]) for r in out.collect()}
    assert got == {("A", "incremental", D(2024, 1, 2), D(2024, 1, 4)), ("B", "incremental", D(2024, 1, 31), D(2024, 2, 10)), ("D", "full", D(2024, 3, 5), D(2024, 3, 1))}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_sessions_around_a_day(spark):
    days = [D(2024, 1, 2), D(2024, 1, 3), D(2024, 1, 8), D(2024, 3, 1)]
    calendar = spark.createDataFrame([(d, datetime.datetime(d.year, d.month, d.day, 13 if d.day == 3 else 16)) for d in days], "session_date date, close_et timestamp")
    got = {r["day"]: (r["last_session"], r["first_session"]) for r in history.session_lookup(calendar).collect()}
    assert got[D(2024, 1, 3)] == (D(2024, 1, 3), D(2024, 1, 3)) and got[D(2024, 1, 5)] == (D(2024, 1, 3), D(2024, 1, 8))
    assert got[D(2024, 1, 1)] == (None, D(2024, 1, 2)) and got[D(2024, 1, 22)] == (D(2024, 1, 8), None) and D(2024, 2, 5) not in got
    at = lambda d, h, m, s=0: (D(2024, 1, d), datetime.datetime(2024, 1, d, h, m, s))
    moments = spark.createDataFrame([at(2, 16, 1), at(2, 16, 1, 30), at(3, 13, 2), at(4, 9, 0)], "d date, at timestamp")
    assert [r["past_close"] for r in history.past_close(moments, "at", "d", calendar, 90).orderBy("at").collect()] == [False, True, True, True]


def test_bars_of_a_date_are_one_file_until_it_is_large(spark, tmp_path):
    path = str(tmp_path / "bars")
    bars = spark.range(4000).selectExpr("concat('S', id % 40) as symbol", "date_add(date'2024-01-01', cast(id % 5 as int)) as et_date", "cast(id % 900 as int) as et_min",
                                        *[f"cast(id as double) as {c}" for c in ("open", "high", "low", "close", "volume", "vwap")], "id as trade_count")
    history.write_bars(bars, path)
    history.write_bars(bars.where("et_date = date'2024-01-02'").withColumn("close", F.lit(-1.0)), path)
    assert all(len([f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")]) == 1 for d in os.listdir(path) if d.startswith("et_date="))
    back = history.read_bars(spark, path)
    assert back.count() == 4000 and back.where("close = -1").select("et_date").distinct().collect() == [(D(2024, 1, 2),)]

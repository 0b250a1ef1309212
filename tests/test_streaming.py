"""Streams cut into many micro-batches give the batch result."""
import uuid

import pytest
from pyspark.sql import functions as F

from barwright.plans import q_market as qm
from barwright.plans import q_rules as qr
from barwright.plans.tables import tables
from barwright.operators import quotes as qt
from barwright.operators import rules as ru
from barwright.session import shared_dir
from barwright.streaming import live, streams as sm

SF = "/root/testdata/sf0.001"


def in_batches(spark, slices):
    """Files of the slices, read one file per micro-batch in order."""
    path = f"{shared_dir(spark)}/stream-test-{uuid.uuid4().hex[:8]}"
    for df in slices:
        df.coalesce(1).write.mode("append").parquet(f"{path}/in")
    s = spark.readStream.schema(slices[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    return s, path


def test_live_signals_over_micro_batches(spark):
    t = tables(spark, SF)
    b = t.bars.select("symbol", "et_date", "ts", "et_min", "session", "high", "low", "close", "volume")
    slices = [b.where(F.col("et_min").between(lo, hi)) for lo, hi in ((540, 640), (641, 702), (703, 959))]
    s, path = in_batches(spark, [slices[0], slices[1].unionByName(slices[0].where("et_min > 630")), slices[2]])       # the second batch repeats bars
    cols = ["symbol", "et_date", "et_min", "direction", "trigger"]
    got = sm.run_to_table(sm.live_signals(s), f"{path}/out", f"{path}/ck").select(*cols).collect()
    want = ru.spaced(qr.all_fires(t).select(*cols, "value"), ["symbol", "direction", "trigger"], 300).select(*cols).collect()
    assert sorted(got) == sorted(want) and got


def test_quote_bars_over_micro_batches(spark):
    t = tables(spark, SF)
    q = qm.with_totals(t).drop("_h").cache()
    top = q.agg(F.max("receipt_ms")).first()[0]
    cuts = [q.where(F.pmod(F.col("seq"), F.lit(1000)).between(lo, hi)) for lo, hi in ((0, 333), (334, 700), (701, 999))]
    s, path = in_batches(spark, cuts)
    got = {(r.symbol, r.session_day, r.minute): r[3:] for r in sm.run_to_table(sm.bars_from_quotes(s), f"{path}/out", f"{path}/ck").collect()}
    want = {(r.symbol, r.session_day, r.minute): r[3:] for r in qt.bars_from_quotes(q).collect()}
    late = [k for k in want if k not in got]
    assert all((k[2] + 1) * 60_000 + 3000 > top - 3000 or k[2] == max(x[2] for x in want if x[0] == k[0]) for k in late)
    assert all(want[k] == v for k, v in got.items()) and len(got) > len(want) * 0.9


def test_sequence_numbers_continue_over_batches(spark):
    t = tables(spark, SF)
    f = ru.spaced(qr.all_fires(t).select("symbol", "et_date", "et_min", "direction", "trigger", "value"), ["symbol", "direction", "trigger"], 300)
    s, path = in_batches(spark, [f.where("et_min < 700"), f.where("et_min >= 700")])
    w = sm.publish_to(f"{path}/out", "s1", ["et_date", "et_min", "symbol", "trigger", "direction"], "et_date")
    s.writeStream.foreachBatch(w).option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = [r[0] for r in spark.read.parquet(f"{path}/out").select("seq").orderBy("seq").collect()]
    assert got == list(range(1, f.count() + 1))


def test_silent_symbols_turn_stale_by_a_timer_and_live_again(spark):
    """No bar announces that a symbol is stale: the timer of its state does."""
    import time
    path = f"{shared_dir(spark)}/stream-test-{uuid.uuid4().hex[:8]}"
    send = lambda *symbols: spark.createDataFrame([(s, int(time.time() * 1000)) for s in symbols], "symbol string, close_ms bigint").coalesce(1).write.mode("append").parquet(f"{path}/in")
    send("A", "B")
    stream = spark.readStream.schema("symbol string, close_ms bigint").parquet(f"{path}/in")
    q = live.feed_states(stream, 8_000).writeStream.outputMode("append").format("memory").queryName("feed_states").option("checkpointLocation", f"{path}/ck").trigger(processingTime="1 second").start()
    try:
        seen = lambda: [(r.symbol, r.state) for r in spark.table("feed_states").collect()]
        end = time.time() + 90
        while ("B", "stale") not in seen() and time.time() < end:
            send("A")
            time.sleep(1)
        send("A", "B")
        while seen().count(("B", "live")) < 2 and time.time() < end:
            send("A")
            time.sleep(1)
    finally:
        q.stop()
    assert [s for x, s in seen() if x == "B"][:3] == ["live", "stale", "live"]
    assert [s for x, s in seen() if x == "A"][:1] == ["live"]


def test_rules_of_a_repeated_batch_stand_once(spark):
    """The second call with the same batch id overwrites what the first one wrote; bars sent again change nothing."""
    from barwright.plans.q_streaming import LIVE_DOCUMENTS
    t = tables(spark, SF)
    path = f"{shared_dir(spark)}/stream-test-{uuid.uuid4().hex[:8]}"
    b = t.bars.where("symbol in ('S00', 'S01')").select(live.BAR)
    write = live.rules_to(path, LIVE_DOCUMENTS[1:], live.Known(t.context, t.profile, t.sessions))
    write(b.where("et_min <= 700"), 0)
    write(b.where("et_min <= 700"), 0)
    first = live.outcomes(spark, path).collect()
    write(b.where("et_min <= 650"), 1)
    assert sorted(live.outcomes(spark, path).collect()) == sorted(first) and first
    assert live.received(spark, path, 2).count() == b.where("et_min <= 700").count()


def test_trade_crosses_over_micro_batches(spark):
    """Trades of a session in several batches and files, ranges from the table or with every trade: the crossings of the window form."""
    t = tables(spark, SF)
    trades, opening = qm.trades(t), qm.openings(t)
    cols = ["symbol", "et_date", "interval", "et_min", "trade_ms", "price", "or_high"]
    want = sorted(qt.trade_cross(trades, opening).select(*cols).collect())
    cuts = lambda df: [df.where(F.col("et_min").between(lo, hi)) for lo, hi in ((540, 590), (591, 640), (641, 959))]
    s, path = in_batches(spark, cuts(trades))
    assert sorted(sm.run_to_table(sm.trade_cross(s, opening), f"{path}/out", f"{path}/ck").select(*cols).collect()) == want and len(want) > 5
    ranged = trades.join(opening.select("symbol", "et_date", "interval", "or_high", "range_id"), ["symbol", "et_date"])
    s, path = in_batches(spark, cuts(ranged))
    assert sorted(sm.run_to_table(sm.trade_cross(s), f"{path}/out", f"{path}/ck").select(*cols).collect()) == want


def test_packed_rows_come_back_and_a_key_travels_once_a_task(spark):
    rows = [(f"K{n % 3}" if n % 3 else None, 10 ** 12 + 250 * n, n if n % 5 else None, n % 7, None if n % 4 == 0 else n / 3, n % 2 == 0) for n in range(2000)]
    names = ["k", "ms", "seq", "low", "price", "good"]
    df = spark.createDataFrame(rows, "k string, ms long, seq long, low int, price double, good boolean").repartition(3)
    for columns in (names[1:], ["ms", "low", "price", "good"]):         # with and without a missing whole number
        packs = sm.packed(df, ["k"], columns)
        assert packs.count() <= 9 and packs.select("_steps").distinct().collect()[0][0] == ("seq" not in columns)
        back = sm.unpacked(packs.toPandas(), ["k"], columns)
        plain = lambda frame: sorted([tuple(None if v is None or v != v else v for v in r) for r in frame[["k", *columns]].itertuples(index=False)], key=repr)
        assert plain(back.astype({"ms": "int64", "low": "int64"})) == plain(df.toPandas().astype({"ms": "int64", "low": "int64"}))


def test_stored_streams_take_few_bytes_a_row(spark):
    import os
    from barwright.plans import q_streaming as qs
    n, t = 200_000, tables(spark, SF)
    stamps = spark.range(n).select(*[(F.col("id") * 250 + F.lit(10 ** 12 + c)).alias(f"ms{c}") for c in range(3)])
    s, path = qs.as_stream(t, stamps.coalesce(1), "few-bytes")
    assert sum(os.path.getsize(f"{path}/in/{f}") for f in os.listdir(f"{path}/in")) < 2 * n
    assert sorted(spark.read.schema(s.schema).parquet(f"{path}/in").agg(F.sum("ms0"), F.max("ms2")).collect()[0]) == sorted(stamps.agg(F.sum("ms0"), F.max("ms2")).collect()[0])

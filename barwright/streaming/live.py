"""Rule documents on a live stream: the detectors, conditions and the acceptance of the batch catalog, run over the sessions that a micro-batch touches.

The state is a table of the bars received so far, partitioned by session date, and nothing else: latches, evidence and clocks of a session follow from its
bars, so a restarted or repeated batch cannot lose or double them.  A batch reads the open sessions of the symbols it brings (at most 960 bars each)
and, for candles and averages that continue over sessions, the bars of ``warm_sessions`` dates before.  Every trigger and condition of the catalog is
thereby live, with the same results as in batch.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import candles as co
from ..operators import catalog, daily as da, state as st
from ..operators.triggers import Inputs

DAY = ["symbol", "et_date"]
BAR = ["symbol", "et_date", "et_min", "ts", "session", "open", "high", "low", "close", "volume", "source"]


@dataclass
class Known:
    """What is known before a session opens: daily context and slot volumes per (symbol, et_date), and the daily bars before."""
    context: DataFrame
    profile: DataFrame
    sessions: DataFrame | None = None
    external: DataFrame | None = None
    trades: DataFrame | None = None
    sectors: DataFrame | None = None


def exists(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def received(spark, path: str, batch_id: int) -> DataFrame | None:
    """Bars of the batches before ``batch_id``."""
    if not exists(spark, f"{path}/bars"):
        return None
    return spark.read.parquet(f"{path}/bars").where(F.col("batch_id") < batch_id).withColumn("et_date", F.col("et_date").cast("date"))


def fresh_bars(batch: DataFrame, held: DataFrame | None) -> DataFrame:
    """One row per minute, and only minutes after the newest one held of the session: repeated and late bars change nothing."""
    rest = [c for c in BAR if c not in ("symbol", "et_date", "et_min")]
    new = batch.groupBy("symbol", "et_date", "et_min").agg(F.min(F.struct(*rest)).alias("b")).select("symbol", "et_date", "et_min", "b.*").select(BAR)
    if held is None:
        return new
    top = held.join(batch.select("et_date").distinct(), "et_date", "left_semi").groupBy(*DAY).agg(F.max("et_min").alias("_top"))
    return new.join(top, DAY, "left").where(F.col("_top").isNull() | (F.col("et_min") > F.col("_top"))).drop("_top")


def inputs_of(bars: DataFrame, touched: DataFrame, known: Known) -> Inputs:
    """Detector inputs: bars of the touched sessions, candles over all ``bars``."""
    state = st.bar_state(bars)
    live = st.rvol(st.derived(state.join(touched, DAY, "left_semi"), known.context), known.profile)
    return Inputs(live, co.candles(state), known.sessions, known.external, known.trades, known.sectors)


def rules_to(path: str, documents: list[dict], known: Known, cutoff=None, warm_sessions: int | None = None, always: tuple[str, ...] = (), **options) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of outcomes (``path``/outcomes).

    Bars up to ``cutoff`` (a timestamp; the replay after a restart) only fill the state.  ``always`` names benchmark symbols that are read with every batch,
    ``options`` go to ``catalog.run_documents``.  A repeated batch overwrites its own folders, so its outcomes stand once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = received(spark, path, batch_id)
        (fresh_bars(batch, held).withColumn("batch_id", F.lit(batch_id)).repartition("et_date").write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
         .partitionBy("et_date", "batch_id").parquet(f"{path}/bars"))
        if not exists(spark, f"{path}/bars"):
            return
        stored = received(spark, path, batch_id + 1)
        new = stored.where(F.col("batch_id") == batch_id).select(*DAY, "et_min", "ts")
        emitted = new if cutoff is None else new.where(F.col("ts") > (cutoff if isinstance(cutoff, Column) else F.lit(cutoff)))
        if emitted.isEmpty():
            return
        touched = emitted.select(*DAY).distinct()
        first, last = touched.agg(F.min("et_date"), F.max("et_date")).first()
        dates = stored.where(F.col("et_date") <= F.lit(last)).select("et_date").distinct()
        if warm_sessions is not None:  # one row per date: bounded by the calendar
            place = F.row_number().over(Window.orderBy(F.desc("et_date")))
            earlier = dates.where(F.col("et_date") < F.lit(first)).withColumn("_n", place).where(F.col("_n") <= warm_sessions).select("et_date")
            dates = dates.where(F.col("et_date") >= F.lit(first)).unionByName(earlier)
        symbols = touched.select("symbol").unionByName(spark.createDataFrame([(s,) for s in always], "symbol string")).distinct()
        bars = stored.join(F.broadcast(dates), "et_date", "left_semi").join(symbols, "symbol", "left_semi").select(BAR)
        if always:
            touched = touched.unionByName(dates.where(F.col("et_date") >= F.lit(first)).crossJoin(spark.createDataFrame([(s,) for s in always], "symbol string")).select(*DAY)).distinct()
        outcomes = catalog.run_documents(inputs_of(bars, touched, known), documents, **options)
        outcomes.join(emitted.drop("ts"), [*DAY, "et_min"], "left_semi").write.mode("overwrite").parquet(f"{path}/outcomes/batch_id={batch_id}")
    return write


def start(bars: DataFrame, path: str, documents: list[dict], known: Known, trigger: dict | None = None, **options):
    """The running query over a stream of bars with the columns of ``BAR``."""
    return (bars.select(BAR).writeStream.foreachBatch(rules_to(path, documents, known, **options)).option("checkpointLocation", f"{path}/checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start())


def outcomes(spark, path: str) -> DataFrame:
    """All outcomes written so far."""
    return spark.read.parquet(f"{path}/outcomes").drop("batch_id")


# ---- sessions that end ---------------------------------------------------------------------------------------------------------

DAILY = ["symbol", "et_date", "open", "high", "low", "close", "volume"]


def closing_sessions(bars: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The regular-session daily bar of every (symbol, date), emitted once when the event time has passed 22:00 UTC of that date by ``delay``.

    Any bar moves the event time, also one of the evening or of another symbol, so a symbol that falls silent closes as well.  The state of a session is one
    row and goes with its emission; a new session starts from nothing.
    """
    span = F.window("ts", "1 day", "1 day", "22 hours")
    g = bars.withWatermark("ts", delay).where("session = 'rth'").groupBy("symbol", "et_date", span)
    return g.agg(F.min_by("open", "et_min").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "et_min").alias("close"),
                 F.sum("volume").alias("volume")).select(DAILY)


def context_after(daily: DataFrame) -> DataFrame:
    """The daily context as it stands after each session: ``after`` and the columns of ``daily_context``, the newest session included."""
    coming = daily.groupBy("symbol").agg(F.date_add(F.max("et_date"), 1).alias("et_date")).select(*[F.col(c) if c in ("symbol", "et_date") else F.lit(None).cast("double").alias(c) for c in DAILY])
    days = daily.select(DAILY).unionByName(coming)
    before = days.select("symbol", "et_date", F.lag("et_date").over(Window.partitionBy("symbol").orderBy("et_date")).alias("after"))  # one row per trading date
    return da.daily_context(days).join(before.where("after is not null"), DAY).drop("et_date")


def fold_in_to(path: str, history: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of a stream of ``closing_sessions``: closed daily bars join ``path``/daily, and the context that the next session opens with goes to ``path``/context.

    ``history`` holds daily bars from before the stream.  A repeated batch overwrites its own folders.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.select(DAILY).write.mode("overwrite").parquet(f"{path}/daily/batch_id={batch_id}")
        stored = spark.read.schema(batch.select(DAILY).schema.add("batch_id", "integer")).parquet(f"{path}/daily").where(F.col("batch_id") <= batch_id)
        new = stored.where(F.col("batch_id") == batch_id).select("symbol", F.col("et_date").alias("after"))
        if new.isEmpty():
            return
        known = stored.select(DAILY) if history is None else stored.select(DAILY).unionByName(history.select(DAILY))
        mine = known.join(new.select("symbol").distinct(), "symbol", "left_semi")
        context_after(mine).join(new, ["symbol", "after"], "left_semi").write.mode("overwrite").parquet(f"{path}/context/batch_id={batch_id}")
    return write


# ---- silent feeds ----------------------------------------------------------------------------------------------------------------

FEED_STATES = "symbol string, state string, last_ms bigint"


def feed_states(bars: DataFrame, limit_ms: int = 90_000) -> DataFrame:
    """A row whenever a symbol turns ``live`` (its first bar, or one after a silence) or ``stale`` (no bar for ``limit_ms`` of processing time).

    Staleness comes from a timer of the state, so it is noticed without any further bar.  ``bars``: symbol, close_ms; the state holds one row a symbol.
    """
    def run(key, frames, state):
        import pandas as pd
        held, last = state.get if state.exists else ("stale", 0)
        if state.hasTimedOut:
            turned = "stale"
            state.update((turned, last))
        else:
            last = max(last, *(int(f["close_ms"].max()) for f in frames))
            turned = "live" if held == "stale" else None
            state.update(("live", last))
            state.setTimeoutDuration(limit_ms)
        yield pd.DataFrame([(key[0], turned, last)] if turned else [], columns=["symbol", "state", "last_ms"])
    return bars.select("symbol", "close_ms").groupBy("symbol").applyInPandasWithState(run, FEED_STATES, "state string, last_ms bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)

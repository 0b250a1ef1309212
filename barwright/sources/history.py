"""Bar history tables: read, write, integrity, coverage and the plan of spans still to load."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import schemas


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def read_bars(spark: SparkSession, path: str, symbols=None, start=None, end=None) -> DataFrame:
    """Bars of a date-partitioned folder; the filters prune partitions and reach the parquet scan."""
    df = spark.read.schema(schemas.BARS_HISTORY).parquet(path)
    if symbols:
        df = df.where(F.col("symbol").isin(*symbols))
    if start is not None:
        df = df.where(F.col("et_date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("et_date") <= F.lit(end).cast("date"))
    return df


def write_bars(bars: DataFrame, path: str) -> None:
    """Replace exactly the dates contained in ``bars``; rows are sorted for row-group pruning.

    A date is one file until it passes Spark's advisory partition size: Spark then splits a large date and joins small ones at run time.
    """
    (bars.hint("rebalance", "et_date").sortWithinPartitions("et_date", "symbol", "et_min")
         .write.partitionBy("et_date").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path))


def freshness(bars: DataFrame, as_of) -> DataFrame:
    last = bars.groupBy("symbol").agg(F.max("et_date").alias("last_date"))
    return last.withColumn("fresh", F.col("last_date") >= F.lit(as_of).cast("date"))


def integrity(bars: DataFrame) -> DataFrame:
    """Bounds of each symbol with ``ok``: unique stamps, finite numbers, no negative volume.

    Duplicates are counted on (symbol, date, minute) groups first, so a symbol with most of the rows is never gathered.
    """
    bad = F.lit(False)
    for c in ("open", "high", "low", "close", "volume"):
        bad = bad | F.coalesce(finite(F.col(c)).isNull(), F.lit(True))
    bad = bad | F.coalesce(F.col("volume") < 0, F.lit(True))
    stamps = bars.groupBy("symbol", "et_date", "et_min").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))
    return stamps.groupBy("symbol").agg(F.min("et_date").alias("first_date"), F.max("et_date").alias("last_date"), F.sum("n").alias("rows"),
                                        F.sum(F.col("n") - 1).alias("duplicates"), F.sum("bad").alias("bad_rows")) \
        .withColumn("ok", (F.col("duplicates") == 0) & (F.col("bad_rows") == 0))


def plan(requests: DataFrame, bounds: DataFrame, coverage: DataFrame, calendar: DataFrame) -> DataFrame:
    """Spans to load per requested (symbol, start, end): everything without usable history, else the missing head and tail.

    The boundary session is fetched again so that a corrected last bar is replaced.  Spans meet the calendar on the months they touch.
    """
    months = F.when(F.col("end") >= F.col("start"), F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))).otherwise(F.array(F.trunc("start", "month")))
    spans = requests.select("start", "end").distinct().withColumn("_month", F.explode(months))
    inside = F.when(F.col("session_date").between(F.col("start"), F.col("end")), F.col("session_date"))
    edge = (spans.join(calendar.select("session_date", F.trunc("session_date", "month").alias("_month")), "_month", "left").groupBy("start", "end")
                 .agg(F.min(inside).alias("need_first"), F.max(inside).alias("need_last")))
    r = (requests.join(edge, ["start", "end"]).join(bounds.where("ok").select("symbol", "first_date", "last_date"), "symbol", "left")
                 .join(coverage.select("symbol", F.col("start").alias("asked_from"), F.col("end").alias("checked_to")), "symbol", "left"))
    full = F.col("first_date").isNull()
    covered = F.coalesce(F.col("asked_from") <= F.col("start"), F.lit(False))
    head = F.when(full, F.struct(F.col("start").alias("a"), F.col("end").alias("b"))) \
            .when((F.col("first_date") > F.col("need_first")) & ~covered, F.struct(F.col("start").alias("a"), F.col("first_date").alias("b")))
    checked = F.coalesce(F.col("checked_to") >= F.col("need_last"), F.lit(False))
    tail = F.when(~full & (F.col("last_date") < F.col("need_last")) & ~checked,
                  F.struct(F.greatest("last_date", "checked_to").alias("a"), F.col("end").alias("b")))
    spans = F.filter(F.array(head, tail), lambda s: s.isNotNull())
    return r.select("symbol", F.when(full, "full").otherwise("incremental").alias("mode"), F.explode(spans).alias("s")).select(
        "symbol", "mode", F.col("s.a").alias("span_start"), F.col("s.b").alias("span_end"))


def note_coverage(coverage: DataFrame, loaded: DataFrame) -> DataFrame:
    return coverage.unionByName(loaded).groupBy("symbol").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def request_batches(spans: DataFrame, size: int = 100) -> DataFrame:
    """Symbols that miss the same span, in requests of at most ``size`` symbols (hash-numbered, so a common span is split)."""
    from pyspark.sql import Window
    share = F.pmod(F.xxhash64("symbol"), F.lit(64))
    w = Window.partitionBy("span_start", "span_end", "share").orderBy("symbol")
    s = spans.withColumn("share", share)
    s = s.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
    return s.groupBy("span_start", "span_end", "share", "batch").agg(F.sort_array(F.collect_list("symbol")).alias("symbols"))


def prior(bars: DataFrame, day) -> DataFrame:
    return bars.where(F.col("et_date") < F.lit(day).cast("date"))


def session(bars: DataFrame, day) -> DataFrame:
    return bars.where(F.col("et_date") == F.lit(day).cast("date"))


def session_lookup(calendar: DataFrame, reach: int = 14) -> DataFrame:
    """Per calendar day near a session: the last session on or before it and the first on or after it, ``reach`` days away at most.

    Every session names the days around it, so days find their sessions by an equi-join on ``day``; a day without a session in reach has no value.
    """
    around = F.sequence(F.date_sub("session_date", reach), F.date_add("session_date", reach))
    near = calendar.select("session_date", F.explode(around).alias("day"))
    return near.groupBy("day").agg(F.max(F.when(F.col("session_date") <= F.col("day"), F.col("session_date"))).alias("last_session"),
                                   F.min(F.when(F.col("session_date") >= F.col("day"), F.col("session_date"))).alias("first_session"))


def past_close(moments: DataFrame, at: str, day: str, calendar: DataFrame, grace_s: int = 0) -> DataFrame:
    """``moments`` with ``past_close``: the session of their day ended at least ``grace_s`` seconds before ``at``; true on a day without a session."""
    c = calendar.select(F.col("session_date").alias("_day"), F.timestamp_add("SECOND", F.lit(grace_s), F.col("close_et")).alias("_close"))
    return moments.join(c, F.col(day) == F.col("_day"), "left").withColumn("past_close", F.coalesce(F.col(at) >= F.col("_close"), F.lit(True))).drop("_day", "_close")


def closed_sessions(calendar: DataFrame, at: Column) -> DataFrame:
    """Sessions whose close has passed, with an early-close flag (before 16:00)."""
    early = F.hour("close_et") * 60 + F.minute("close_et") < 960
    return calendar.where(F.col("close_et") <= at).withColumn("early_close", early)

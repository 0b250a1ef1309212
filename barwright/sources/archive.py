"""Alert archive, frozen inputs with digests, exports and revision digests."""
from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .schemas import BAR_SOURCE


def append_alerts(alerts: DataFrame, path: str) -> None:
    alerts.write.partitionBy("session_date").mode("append").json(path)


def read_recent(spark: SparkSession, path: str, schema: str, today, days: int) -> DataFrame:
    """Alerts of the last ``days`` dates, legacy rows (no event_id) upgraded with an identity from their file, their content and their number.

    JSON lines have no position that survives another split of the file, so equal lines of one file are numbered: which of them gets which number makes no
    difference, and every reading gives the same set of ids.  Only legacy rows are ordered; the others pass without a shuffle.
    """
    first = F.date_sub(F.lit(today).cast("date"), days - 1)
    a = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_name").alias("_file")).where(F.col("session_date") >= first).withColumn("source", F.coalesce("source", F.lit("unknown")))
    legacy = a.where("event_id is null")
    body = F.sha2(F.to_json(F.struct(*[c for c in a.columns if c != "_file"])), 256)
    again = F.row_number().over(Window.partitionBy("_file", "_body").orderBy("ts"))
    named = legacy.withColumn("_body", body).withColumn("_again", again).withColumns({
        "event_id": F.concat_ws(":", F.lit("legacy"), F.sha1("_file"), "_body", F.col("_again").cast("string")), "mode": F.lit("unknown"), "session_id": F.lit("legacy")})
    return a.where("event_id is not null").unionByName(named.select(a.columns)).drop("_file")


def expire(spark: SparkSession, path: str, today, days: int) -> list[str]:
    """Delete the date folders of an archive that are older than the last ``days`` dates; returns the dates deleted.

    A marker under ``_retention`` names the first date that stays; it is written before the first folder goes and removed after the last one, and a marker
    that a lost driver left behind is finished by the next call, whatever its own dates.  Readers skip names that begin with ``_``.  Nothing but
    ``session_date=<date>`` folders is touched; a missing archive has nothing to delete.
    """
    jvm = spark._jvm
    place = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *parts]))
    fs = place().getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place()):
        return []
    first = datetime.date.fromisoformat(str(today)) - datetime.timedelta(days=days - 1)
    if fs.exists(place("_retention")):
        left = [s.getPath().getName().removeprefix("before-") for s in fs.listStatus(place("_retention"))]
        first = max([first, *map(datetime.date.fromisoformat, left)])
    old = []
    for status in fs.listStatus(place()):
        name = status.getPath().getName()
        try:
            day = datetime.date.fromisoformat(name.removeprefix("session_date="))
        except ValueError:
            continue
        if status.isDirectory() and name.startswith("session_date=") and day < first:
            old.append(name)
    if not old:
        fs.delete(place("_retention"), True)
        return []
    plan = place("_retention", f"before-{first.isoformat()}")
    fs.create(plan, True).close()
    for name in sorted(old):
        fs.delete(place(name), True)
    fs.delete(place("_retention"), True)
    return sorted(n.removeprefix("session_date=") for n in old)


def retained(alerts: DataFrame, today, days: int) -> DataFrame:
    """Rows a retention rewrite keeps (a filter on the partition column)."""
    return alerts.where(F.col("session_date") >= F.date_sub(F.lit(today).cast("date"), days - 1))


def digest(df: DataFrame, by: list[str]) -> DataFrame:
    """Order-free content digest per group: row hashes are summed, so any partition layout gives the same value and a large
    group is reduced before the shuffle."""
    text = F.to_json(F.struct(*sorted(df.columns)))
    high, low = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(20,0)"), F.conv(F.substring(F.sha2(text, 256), 13, 12), 16, 10).cast("decimal(20,0)")
    g = df.select(*by, high.alias("_a"), low.alias("_b")).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    return g.select(*by, "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), F.col("_a").cast("string"), F.col("_b").cast("string")), 256).alias("digest"))


def capture(daily: DataFrame, five: DataFrame, one: DataFrame, day, root: str) -> DataFrame:
    """Freeze the inputs of one session (earlier daily and 5-minute bars, the session's minutes) and return their digests."""
    d = F.lit(day).cast("date")
    parts = {"daily": daily.where(F.col("et_date") < d), "5min": five.where(F.col("et_date") < d), "1min": one.where(F.col("et_date") == d)}
    out = None
    for label, df in parts.items():
        df.write.mode("overwrite").parquet(f"{root}/{label}")
        g = digest(df, ["symbol"]).withColumn("label", F.lit(label))
        out = g if out is None else out.unionByName(g)
    return out


def verify(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Manifest rows whose stored data no longer has the recorded digest."""
    now = None
    for label in ("daily", "5min", "1min"):
        g = digest(spark.read.parquet(f"{root}/{label}"), ["symbol"]).withColumn("label", F.lit(label))
        now = g if now is None else now.unionByName(g)
    j = manifest.select("symbol", "label", F.col("digest").alias("recorded")).join(now.select("symbol", "label", "digest"), ["symbol", "label"], "full")
    return j.where(~F.col("recorded").eqNullSafe(F.col("digest")))


def replay_order(bars: DataFrame, benchmark: str, sectors: list[str], end_min: int) -> DataFrame:
    """Bars up to a clock time in replay order: time, then benchmark, sectors, others, symbol."""
    prio = F.when(F.col("symbol") == benchmark, 0).when(F.col("symbol").isin(*sectors), 1).otherwise(2)
    return bars.where(F.col("et_min") <= end_min).withColumn("prio", prio).orderBy("et_date", "et_min", "prio", "symbol")


def source_bar_id(source: Column, symbol: Column, ts: Column) -> Column:
    """source:symbol:1m:utc stamp, unknown sources named so; a feed's own label is kept (``wire.bars`` writes it)."""
    known = F.when(source.isin("stream", "history", "quotes", BAR_SOURCE), source).otherwise("unknown")
    return F.concat_ws(":", known, symbol, F.lit("1m"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def revision(doc: Column) -> Column:
    return F.sha2(F.to_json(doc), 256)


def short_hash(doc: Column) -> Column:
    return F.substring(F.sha1(F.to_json(doc)), 1, 8)


def export_csv(df: DataFrame, path: str, by: str) -> None:
    """One ordered CSV file of a screen result (a universe report: one row per symbol)."""
    df.orderBy(F.col(by).desc_nulls_last(), "symbol").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def fresh_fundamentals(entries: DataFrame, today: Column) -> DataFrame:
    """Usable entries: never a rate limit; failures only on their own day; good ones for 7 days and until the known earnings date."""
    age = F.datediff(today, "fetched_at")
    good = (age >= 0) & (age < 7) & F.coalesce(F.col("next_earnings") >= today, F.lit(True))
    return entries.where(~F.coalesce("rate_limited", F.lit(False)) & F.when(F.col("ok"), good).otherwise(F.to_date("fetched_at") == today))


def next_earnings(dates: Column, now: Column) -> Column:
    return F.array_min(F.filter(dates, lambda d: d > now))


def merge_provider(entries: DataFrame, provider: DataFrame) -> DataFrame:
    """Provider figures over the cached ones: percent becomes a fraction, the cached name stays unless it is missing."""
    p = provider.select("symbol", F.col("name").alias("p_name"), (F.col("short_percent") / 100).alias("p_short"), F.col("market_cap").alias("p_cap"))
    return (entries.join(p, "symbol", "left")
                   .select("symbol", F.coalesce("name", "p_name").alias("name"), F.coalesce("p_short", "short_pct_float").alias("short_pct_float"),
                           F.coalesce("p_cap", "market_cap").alias("market_cap")))


def stored(alerts: DataFrame, path: str) -> DataFrame:
    """``alerts`` written once and read back: ``publish`` counts the dates and then numbers the rows, and the acceptance behind them would run for each."""
    alerts.write.mode("overwrite").parquet(path)
    return alerts.sparkSession.read.schema(alerts.schema).parquet(path)


def publish(alerts: DataFrame, session_id: str, offset: int, order: list[str], chunk: str) -> DataFrame:
    """Sequence numbers and event ids continuing after ``offset``, numbered chunk by chunk."""
    from ..functions.ordered import position
    a = position(alerts.withColumn("_k", F.lit(session_id)), ["_k"], [chunk], order, "_n")
    a = a.withColumn("seq", F.col("_n") + offset).withColumn("session_id", F.col("_k"))
    return a.withColumn("event_id", F.concat_ws(":", "session_id", F.col("seq").cast("string"))).drop("_n", "_k")


def sanitize(df: DataFrame) -> DataFrame:
    """NaN and infinities of every double or float as NULL before a sink, also inside arrays, structs and map values at any depth."""
    return df.select(*[_finite_inside(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def _has_floats(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(_has_floats(f.dataType) for f in t)
    inner = t.elementType if isinstance(t, T.ArrayType) else t.valueType if isinstance(t, T.MapType) else None
    return isinstance(t, (T.DoubleType, T.FloatType)) if inner is None else _has_floats(inner)


def _finite_inside(c: Column, t: T.DataType) -> Column:
    if not _has_floats(t):
        return c
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _finite_inside(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda _, x: _finite_inside(x, t.valueType))
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_finite_inside(c.getField(f.name), f.dataType).alias(f.name) for f in t]))
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)

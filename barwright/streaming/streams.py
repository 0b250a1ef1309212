"""Structured Streaming versions of the live operators.  State is keyed by (symbol, session date), so it is bounded by one session
and a busy symbol is spread over its sessions."""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import clock, ticks

KEYS = ["symbol", "et_date"]
DAY_MS = 86_400_000


def tumbling_candles(bars: DataFrame, minutes: int, delay: str = "2 minutes") -> DataFrame:
    """OHLCV per symbol and event-time window, emitted once the watermark has passed the window."""
    w = F.window("ts", f"{minutes} minutes")
    g = bars.withWatermark("ts", delay).groupBy("symbol", w).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_bars"))
    return g.select("symbol", F.col("window.start").alias("window_start"), "open", "high", "low", "close", "volume", "n_bars")


def distinct_bars(bars: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """Re-sent bars dropped while the watermark still covers them."""
    return bars.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "ts"])


def _rows(frames: Iterator, by: list[str]):
    """Rows of one key in this micro-batch, in order (at most a session of minutes or ticks)."""
    import pandas as pd
    got = [f for f in frames if len(f)]
    return pd.concat(got).sort_values(by).itertuples(index=False) if got else iter(())


SIGNALS = "symbol string, et_date date, et_min int, direction string, trigger string, value double"
# four cooldown clocks (one per direction and trigger), running session values, the candle being formed and the one before it
_CLOCKS = {("long", "hod"): "t_hod_up", ("short", "hod"): "t_hod_dn", ("long", "cross_above"): "t_x_up", ("short", "cross_below"): "t_x_dn"}
_STATE = ("last_min int, day_high double, day_low double, pv double, vol double, slot int, sess string, n int, first int, close double, vwap double, "
          "p_slot int, p_sess string, p_close double, p_vwap double, t_hod_up int, t_hod_dn int, t_x_up int, t_x_dn int")


def names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def live_signals(bars: DataFrame, cutoff: Column | None = None, cooldown_min: int = 5, delay: str = "1 day") -> DataFrame:
    """New high/low of day and 5-minute VWAP crosses with the per-trigger cooldown, evaluated bar by bar.

    Bars up to ``cutoff`` (a replay after a restart) only move the state and emit nothing.  A bar that is not newer than the last
    one of its session is ignored: repeated and late bars never move a latch.
    """
    prime = F.lit(False) if cutoff is None else F.col("ts") <= cutoff
    rows = bars.withWatermark("ts", delay).select(*KEYS, "ts", "et_min", "session", "high", "low", "close", "volume", prime.alias("prime"))
    fields = names(_STATE)

    def run(key, frames, state: GroupState):
        import pandas as pd
        if state.hasTimedOut:
            state.remove()
            return
        s = dict(zip(fields, state.get)) if state.exists else dict.fromkeys(fields)
        out = []

        def emit(r, direction, trigger, value):
            at = _CLOCKS[direction, trigger]
            if s[at] is None or r.et_min - s[at] >= cooldown_min:
                s[at] = int(r.et_min)
                if not r.prime:
                    out.append((r.symbol, r.et_date, r.et_min, direction, trigger, float(value)))

        def candle_done(r):
            """Judge the finished candle when every minute is there; an incomplete one leaves the earlier candle in place."""
            anchor = clock.PRE_OPEN if s["sess"] == "pre" else clock.RTH_OPEN
            if s["n"] != 5 or s["first"] != anchor + s["slot"] * 5:
                return
            adjacent = s["p_slot"] is not None and (s["p_sess"] != s["sess"] or s["slot"] == s["p_slot"] + 1)
            if adjacent and r.session == "rth" and s["p_vwap"] is not None and s["vwap"] is not None:
                before, now = s["p_close"] - s["p_vwap"], s["close"] - s["vwap"]
                if before <= 0 < now:
                    emit(r, "long", "cross_above", s["vwap"])
                if now < 0 <= before:
                    emit(r, "short", "cross_below", s["vwap"])
            s.update(p_slot=s["slot"], p_sess=s["sess"], p_close=s["close"], p_vwap=s["vwap"])
        for r in _rows(frames, ["et_min"]):
            if s["last_min"] is not None and r.et_min <= s["last_min"]:
                continue
            s["last_min"] = int(r.et_min)
            regular = r.session == "rth"
            if regular:
                s["pv"] = (s["pv"] or 0.0) + (r.high + r.low + r.close) / 3 * r.volume
                s["vol"] = (s["vol"] or 0.0) + r.volume
            sess = "pre" if r.et_min < clock.RTH_OPEN else "rth"
            slot = (int(r.et_min) - (clock.PRE_OPEN if sess == "pre" else clock.RTH_OPEN)) // 5
            if (s["slot"], s["sess"]) != (slot, sess):
                if s["slot"] is not None:
                    candle_done(r)
                s.update(slot=slot, sess=sess, n=0, first=int(r.et_min))
            s.update(n=s["n"] + 1, close=r.close, vwap=s["pv"] / s["vol"] if s["vol"] else None)
            if regular:
                hi, lo = s["day_high"], s["day_low"]
                if hi is not None and r.high > hi:
                    emit(r, "long", "hod", r.high)
                if lo is not None and r.low < lo:
                    emit(r, "short", "hod", r.low)
                s["day_high"] = r.high if hi is None else max(hi, r.high)
                s["day_low"] = r.low if lo is None else min(lo, r.low)
        state.update(tuple(s[f] for f in fields))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 2 * 86_400_000)
        yield pd.DataFrame(out, columns=names(SIGNALS))
    return rows.groupBy(*KEYS).applyInPandasWithState(run, SIGNALS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


CONTINUITY = "symbol string, et_date date, et_min int, arrival bigint, continuity string"


def by_session_date(df: DataFrame, day: Column, delay: str) -> DataFrame:
    """``df`` with the session's midnight as event time, so that its state can expire."""
    return df.withColumn("_session_ts", day.cast("timestamp")).withWatermark("_session_ts", delay)


def expire(state: GroupState, ms: int) -> None:
    """Let the state go once the watermark has passed ``ms``."""
    state.setTimeoutTimestamp(max(ms, state.getCurrentWatermarkMs() + 1))


def _midnight(day) -> int:
    return (day.toordinal() - 719_163) * DAY_MS


def continuity(bars: DataFrame, delay: str = "2 days") -> DataFrame:
    """first / next / gap / duplicate / late per incoming bar of a session (columns et_min, arrival); its state goes two days later."""
    def run(key, frames, state: GroupState):
        import pandas as pd
        if state.hasTimedOut:
            state.remove()
            return
        top, out = (state.get[0] if state.exists else None), []
        for r in _rows(frames, ["arrival"]):
            m = int(r.et_min)
            kind = "first" if top is None else "duplicate" if m == top else "late" if m < top else "next" if m == top + 1 else "gap"
            top = m if top is None else max(top, m)
            out.append((r.symbol, r.et_date, m, r.arrival, kind))
        state.update((top,))
        expire(state, _midnight(key[1]) + 2 * DAY_MS)
        yield pd.DataFrame(out, columns=names(CONTINUITY))
    return by_session_date(bars, F.col("et_date"), delay).groupBy(*KEYS).applyInPandasWithState(run, CONTINUITY, "top int", "append", GroupStateTimeout.EventTimeTimeout)


QUOTE_KEYS = ["symbol", "session_day"]
QUOTE_BARS = "symbol string, session_day int, minute bigint, open double, high double, low double, close double, volume double"
_QB_STATE = ("price double, size double, eligible double, fresh boolean, total double, day_high double, day_low double, minute bigint, open double, high double, "
             "low double, close double, volume double")


def bars_from_quotes(quotes: DataFrame, grace_s: int = 3) -> DataFrame:
    """One-minute bars built from quotes; a minute is emitted by the next traded minute or when the watermark passes its grace.

    The state is the carry of ``ticks.quote_bars``: the last known values and the open minute.  It goes a day after the last minute.
    """
    q = quotes.withColumn("ts", F.timestamp_millis("receipt_ms")).withWatermark("ts", f"{grace_s} seconds")

    def run(key, frames, state: GroupState):
        import pandas as pd
        carry = dict(zip(ticks.QUOTE_CARRY, state.get)) if state.exists else None
        if state.hasTimedOut:
            if carry["minute"] is None:
                state.remove()
                return
            done = ticks.finished(pd.DataFrame([{k: carry[k] for k in ticks.BAR}]))
            carry |= dict.fromkeys(ticks.BAR)
            last = state.getCurrentWatermarkMs()
        else:
            rows = pd.concat(list(frames)).sort_values(["receipt_ms", "seq"])
            done, carry = ticks.quote_bars(rows, carry)
            last = int(rows["receipt_ms"].max())
        state.update(tuple(None if carry[k] is None else bool(carry[k]) if k == "fresh" else int(carry[k]) if k == "minute" else float(carry[k]) for k in ticks.QUOTE_CARRY))
        expire(state, last + DAY_MS if carry["minute"] is None else (int(carry["minute"]) + 1) * 60_000 + grace_s * 1000)
        yield done.assign(symbol=key[0], session_day=key[1])[names(QUOTE_BARS)]
    return q.groupBy(*QUOTE_KEYS).applyInPandasWithState(run, QUOTE_BARS, _QB_STATE, "append", GroupStateTimeout.EventTimeTimeout)


MERGED = "symbol string, session_day int, receipt_ms bigint, seq bigint, bid double, ask double, last double"
_SIDES = ("bid", "ask", "last")


def merge_quotes(quotes: DataFrame, delay: str = "1 day") -> DataFrame:
    """Sparse updates merged per symbol: a side moves when its market time is not older than the one held.  State goes two days after the last update."""
    def run(key, frames, state: GroupState):
        import pandas as pd
        if state.hasTimedOut:
            state.remove()
            return
        fields = [f"{s}{x}" for s in _SIDES for x in ("", "_ms")]
        held = dict(zip(fields, state.get)) if state.exists else dict.fromkeys(fields)
        rows = pd.concat(list(frames)).sort_values(["receipt_ms", "seq"]).reset_index(drop=True)
        out = rows[["symbol", "session_day", "receipt_ms", "seq"]].copy()
        for s in _SIDES:
            stamp = rows[f"{s}_ms"].where(rows[s].notna())
            top = stamp.cummax().ffill()
            top = top if held[f"{s}_ms"] is None else top.clip(lower=held[f"{s}_ms"]).fillna(held[f"{s}_ms"])
            moves = rows[s].notna() & ((stamp >= top) | (stamp.isna() & top.isna()))
            price = rows[s].where(moves).ffill()
            out[s] = price if held[s] is None else price.fillna(held[s])
            value, at = out[s].iloc[-1], top.iloc[-1]
            held[s], held[f"{s}_ms"] = (None if value != value else float(value)), (None if at != at else int(at))
        state.update(tuple(held[f] for f in fields))
        expire(state, int(rows["receipt_ms"].max()) + 2 * DAY_MS)
        yield out[names(MERGED)]
    state = ", ".join(f"{s} double, {s}_ms bigint" for s in _SIDES)
    timed = quotes.withColumn("_ts", F.timestamp_millis("receipt_ms")).withWatermark("_ts", delay)
    return timed.groupBy(*QUOTE_KEYS).applyInPandasWithState(run, MERGED, state, "append", GroupStateTimeout.EventTimeTimeout)


PACK_ROWS = 1 << 18  # rows of a task that are packed together; a buffer of that size is all that a task holds


def packed(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with equal ``keys`` that meet in a task as one row with an array per column, so that a shuffle carries the keys once and little else.

    Nothing is dropped or merged and no order of arrival is needed: keys that meet nobody travel as arrays of one.  Whole numbers go as differences
    (``_steps``), which compress to almost nothing when a feed counts on; ``unpacked`` gives the rows back.
    """
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("_steps", T.BooleanType()), *[T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in columns]])

    def pack(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        def together(held: list):
            table = pa.Table.from_batches(held).combine_chunks()
            group, n = np.zeros(len(table), np.int64), 1
            for k in keys:
                code = table[k].combine_chunks().dictionary_encode(null_encoding="encode")
                group, n = group * len(code.dictionary) + code.indices.to_numpy(), n * len(code.dictionary)
                if n > 1 << 40:     # numbered anew, before the next column could overflow
                    group = np.unique(group, return_inverse=True)[1]
                    n = len(group)
            values = {c: table[c].combine_chunks() for c in columns}
            whole = {c for c, v in values.items() if pa.types.is_integer(v.type)}
            steps = not any(values[c].null_count for c in whole)
            at = np.lexsort([*[values[c].to_numpy() for c in reversed(columns) if steps and c in whole], group])
            starts = np.flatnonzero(np.append(True, np.diff(group[at]) != 0))
            values = {c: v.take(pa.array(at)) for c, v in values.items()}
            for c in whole if steps else ():
                v = values[c].to_numpy()
                d = np.append(v[:1], v[1:] - v[:-1])
                d[starts] = v[starts]
                values[c] = pa.array(d)
            offsets, first = pa.array(np.append(starts, len(table)), pa.int32()), pa.array(at[starts])
            out = [*[table[k].combine_chunks().take(first) for k in keys], pa.array(np.full(len(starts), steps)), *[pa.ListArray.from_arrays(offsets, v) for v in values.values()]]
            return pa.RecordBatch.from_arrays(out, schema.names)

        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + len(b)
            if n >= PACK_ROWS:
                yield together(held)
                held, n = [], 0
        if n:
            yield together(held)
    return rows.select(*keys, *columns).mapInArrow(pack, schema)


def unpacked(packs, keys: list[str], columns: list[str]):
    """The rows of a ``packed`` frame."""
    import numpy as np
    import pandas as pd
    sizes = packs[columns[0]].map(len).to_numpy()
    out = {k: np.repeat(packs[k].to_numpy(), sizes) for k in keys}
    for c in columns:
        out[c] = np.concatenate([np.cumsum(v, dtype=v.dtype) if s and v.dtype.kind in "iu" else v for v, s in zip(map(np.asarray, packs[c]), packs["_steps"])])
    return pd.DataFrame(out)


CROSSES = "symbol string, et_date date, interval int, et_min int, trade_ms bigint, price double, or_high double"
_CROSS_STATE = "interval array<int>, trade_ms array<bigint>, price array<double>, generation array<bigint>, range_id array<string>, held array<boolean>, fired array<boolean>"


def trade_cross(trades: DataFrame, opening: DataFrame | None = None, delay: str = "2 days") -> DataFrame:
    """First trusted, continuous crossing of the opening range, for every interval; interval, or_high and range_id of the finished ranges come from the table
    ``opening`` or, without it, with every trade.

    The rule is ``ticks.first_cross``; the state holds the last trade of the session for each interval and goes two days later.  Trades travel packed, once
    for all intervals, and meet their ranges as they are sent to the state.  ``session.unmeasured_batches`` speeds the packing.
    """
    ranges, columns = ["interval", "or_high", "range_id"], ["receipt_ms", "seq", "trade_ms", "et_min", "price", "generation", "trusted"]
    if opening is None:
        packs = packed(trades, [*KEYS, *ranges], columns).withColumns({c: F.array(c) for c in ranges})
    else:
        known = opening.groupBy(*KEYS).agg(F.collect_list(F.struct(*ranges)).alias("_r")).select(*KEYS, *[F.col(f"_r.{c}").alias(c) for c in ranges])
        packs = packed(trades, KEYS, columns).join(known, KEYS)

    def run(key, frames, state: GroupState):
        import pandas as pd
        if state.hasTimedOut:
            state.remove()
            return
        carries = {i: dict(zip(ticks.CROSS_CARRY, c)) for i, *c in zip(*state.get)} if state.exists else {}
        packs, rows, order = {}, {}, ["receipt_ms", "seq"]
        for f in frames:
            for n, known in enumerate(zip(*[f[c] for c in ranges])):
                packs.setdefault(tuple(zip(*known)), []).append(f.iloc[n:n + 1])
        for known, own in packs.items():
            own = unpacked(pd.concat(own) if len(own) > 1 else own[0], KEYS, columns).sort_values(order)
            for r in known:
                rows.setdefault(int(r[0]), []).append(own.assign(**dict(zip(ranges, r))))
        for i in sorted(rows):
            found, carries[i] = ticks.first_cross(rows[i][0] if len(rows[i]) == 1 else pd.concat(rows[i]).sort_values(order), carries.get(i))
            if len(found):
                yield found[names(CROSSES)]
        state.update((list(carries), *[[c[k] for c in carries.values()] for k in ticks.CROSS_CARRY]))
        expire(state, _midnight(key[1]) + 2 * DAY_MS)
    timed = by_session_date(packs, F.col("et_date"), delay)
    return timed.groupBy(*KEYS).applyInPandasWithState(run, CROSSES, _CROSS_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def current_session_only(bars: DataFrame, opened) -> DataFrame:
    """Bars of sessions before the open one are dropped; ``opened`` is a date literal."""
    return bars.where(F.col("et_date") >= F.lit(opened).cast("date"))


def after_cutoff(bars: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Startup reconcile: stream bars not already contained in the snapshot (cutoff per symbol), a stream-static join."""
    return bars.join(cutoffs, "symbol", "left").where(F.col("cutoff_ts").isNull() | (F.col("ts") > F.col("cutoff_ts"))).drop("cutoff_ts")


def latest_per_symbol(bars: DataFrame) -> DataFrame:
    """Newest stamp per symbol (update mode); a monitor compares it with the clock."""
    return bars.groupBy("symbol").agg(F.max("ts").alias("last_ts"))


def publish_to(path: str, session_id: str, order: list[str], chunk: str):
    """foreachBatch writer: sequence numbers continue after the newest one already stored.

    A batch is written to its own folder, so a repeated batch after a failure overwrites itself and keeps its numbers.
    """
    from ..sources.archive import publish

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            stored = spark.read.parquet(path).where(F.col("batch_id") < batch_id)
            offset = stored.agg(F.max("seq")).first()[0] or 0
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            offset = 0
        out = publish(batch, session_id, offset, order, chunk).withColumn("emitted_at", F.current_timestamp())
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is available, then return the written rows."""
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)

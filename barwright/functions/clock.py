"""Exchange clock columns.  Minutes are minutes since midnight in New York."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Session bounds in minutes since midnight ET.
PRE_OPEN, RTH_OPEN, RTH_CLOSE, POST_CLOSE = 240, 570, 960, 1200
SESSIONS = ("pre", "rth", "post")
TIMEFRAMES = (1, 2, 3, 5, 15, 30, 60)
ZONE = "America/New_York"


def et_timestamp(ts) -> Column:
    return F.from_utc_timestamp(ts, ZONE)


def et_minute(ts) -> Column:
    et = et_timestamp(ts)
    return (F.hour(et) * 60 + F.minute(et)).cast("int")


def session_of(minute) -> Column:
    m = F.col(minute) if isinstance(minute, str) else minute
    return F.when(m < RTH_OPEN, "pre").when(m < RTH_CLOSE, "rth").otherwise("post")


def key_session(minute) -> Column:
    """The session a candle is anchored to: later bars extend the regular-session slots."""
    m = F.col(minute) if isinstance(minute, str) else minute
    return F.when(m < RTH_OPEN, "pre").otherwise("rth")


def candle_slot(minute, tf) -> Column:
    m = F.col(minute) if isinstance(minute, str) else minute
    anchor = F.when(m < RTH_OPEN, F.lit(PRE_OPEN)).otherwise(F.lit(RTH_OPEN))
    return F.floor((m - anchor) / tf).cast("int")


def add_clock(df: DataFrame, ts: str = "ts") -> DataFrame:
    """et_date, et_min, slot5 and session from a UTC minute-start stamp."""
    et = et_timestamp(F.col(ts))
    return (df.withColumn("et_date", F.to_date(et))
              .withColumn("et_min", et_minute(F.col(ts)))
              .withColumn("slot5", (F.floor(F.col("et_min") / 5) * 5).cast("int"))
              .withColumn("session", session_of("et_min")))


def session_clock(df: DataFrame, et: str) -> DataFrame:
    """Session label of an ET wall-clock column with the next boundary, weekend aware."""
    t = F.col(et)
    minute = F.hour(t) * 60 + F.minute(t)
    dow = F.dayofweek(t)                                  # 1 = Sunday, 7 = Saturday
    weekend = dow.isin(1, 7)
    label = (F.when(weekend | (minute < PRE_OPEN) | (minute >= POST_CLOSE), "closed")
              .when(minute < RTH_OPEN, "pre").when(minute < RTH_CLOSE, "rth").otherwise("post"))
    midnight = F.date_trunc("day", t)
    days_ahead = (F.when(dow == 7, 2).when(dow == 1, 1).when((dow == 6) & (minute >= POST_CLOSE), 3)
                   .when(minute >= POST_CLOSE, 1).otherwise(0))
    boundary = (F.when(weekend | (minute < PRE_OPEN) | (minute >= POST_CLOSE), PRE_OPEN)
                 .when(minute < RTH_OPEN, RTH_OPEN).when(minute < RTH_CLOSE, RTH_CLOSE).otherwise(POST_CLOSE))
    nxt = F.timestamp_add("MINUTE", boundary.cast("int"), F.timestamp_add("DAY", days_ahead.cast("int"), midnight))
    return df.withColumn("session_label", label).withColumn("next_boundary", nxt)

"""Latest earlier row of another table, as a union and a running 'last' instead of a range join."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], chunk: str, order: str, cols: list[str]) -> DataFrame:
    """``left`` with ``cols`` of the newest ``right`` row of the same keys at or before it.

    Both sides carry ``chunk`` (a coarse part of the ordering, e.g. the date) and ``order``.  The running value stays inside
    (keys, chunk); the value carried over from earlier chunks comes from a table with one row per chunk.
    """
    value = F.struct(*cols)
    l = left.drop(*cols) if set(cols) & set(left.columns) else left
    r = right.select(*keys, chunk, order, value.alias("_v"), F.lit(0).alias("_side"))
    u = l.withColumn("_side", F.lit(1)).unionByName(r, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, chunk).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    ends = u.groupBy(*keys, chunk).agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col(order))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, chunk, F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    j = u.withColumn("_in", F.last("_v", ignorenulls=True).over(inside)).where("_side = 1").join(carry, [*keys, chunk], "left")
    got = F.coalesce("_in", "_carry")
    return j.select(*l.columns, *[got[c].alias(c) for c in cols])

"""Headline clean-up and merging of news sources."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Entities that occur in feed text, applied in this order (the ampersand last).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")]


def clean_text(c: Column) -> Column:
    """Unescape entities, then strip tags and outer blanks."""
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(c, "<[^>]+>", ""))


def headline_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def merge_sources(items: DataFrame, priority: str = "source_rank") -> DataFrame:
    """One item per normalised headline, preferring the first source.  The pick is an aggregate with map-side combine, so a
    headline repeated by a third of all items does not gather in one task."""
    key = headline_key(F.col("headline"))
    rest = [c for c in items.columns]
    return (items.withColumn("hkey", key).groupBy("hkey").agg(F.min_by(F.struct(*rest), F.struct(priority, "id")).alias("i"))
                 .select("hkey", "i.*"))


def newest(items: DataFrame, since: Column, limit: int) -> DataFrame:
    return items.where(F.col("created_at") >= since).orderBy(F.col("created_at").desc(), "hkey").limit(limit)


def widened(items: DataFrame, now: Column, hours: int, fallback_hours: int, limit: int) -> DataFrame:
    """Items of the last ``hours``; when there are none, of ``fallback_hours``.  One pass: the flag is a one-row aggregate."""
    inside = F.col("created_at") >= now - F.expr(f"interval {hours} hours")
    wide = items.where(F.col("created_at") >= now - F.expr(f"interval {fallback_hours} hours"))
    any_inside = wide.agg(F.coalesce(F.max(inside), F.lit(False)).alias("hit")).withColumn("k", F.lit(1))
    j = wide.withColumn("k", F.lit(1)).join(any_inside, "k").where(~F.col("hit") | inside)
    return j.withColumn("widened", ~F.col("hit")).drop("k", "hit").orderBy(F.col("created_at").desc(), "hkey").limit(limit)

"""Market lists merged into candidates, sessions archives and membership decisions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

W = Window


def accepted_snapshots(snaps: DataFrame) -> DataFrame:
    """Snapshots whose provider epoch is newer than every earlier receipt of the same list.

    Lists deliver a handful of snapshots per minute; the window runs over the snapshot headers, not over their rows.
    """
    heads = snaps.select("list_key", "provider_epoch", "received_ms").distinct()
    w = W.partitionBy("list_key").orderBy("received_ms").rowsBetween(W.unboundedPreceding, -1)
    ok = heads.withColumn("_top", F.max("provider_epoch").over(w)).where("_top is null or provider_epoch > _top").drop("_top")
    return snaps.join(ok, ["list_key", "provider_epoch", "received_ms"], "left_semi")


def contributions(snaps: DataFrame) -> DataFrame:
    """Per (session_date, symbol, list): current rank (in the newest snapshot only), best rank, times seen, first / last seen."""
    newest = snaps.groupBy("session_date", "list_key").agg(F.max("received_ms").alias("_new"))
    j = snaps.join(newest, ["session_date", "list_key"])
    return j.groupBy("session_date", "symbol", "list_key").agg(
        F.min(F.when(F.col("received_ms") == F.col("_new"), F.col("rank"))).alias("current_rank"), F.min("rank").alias("best_rank"),
        F.count(F.lit(1)).alias("recurrence"), F.min("received_ms").alias("first_seen"), F.max("received_ms").alias("last_seen"))


def candidates(contrib: DataFrame) -> DataFrame:
    """One row per (session_date, symbol) with a map of its lists."""
    entry = F.struct("current_rank", "best_rank", "first_seen", "last_seen", "recurrence")
    return contrib.groupBy("session_date", "symbol").agg(
        F.min("current_rank").alias("current_rank"), F.min("best_rank").alias("best_rank"), F.sum("recurrence").alias("recurrence"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("list_key", entry.alias("v"))))).alias("lists"))


def listing_order() -> list[Column]:
    return [F.col("current_rank").asc_nulls_last(), F.col("best_rank").asc(), F.col("symbol").asc()]


def list_health(snaps: DataFrame, requested: DataFrame, connected: bool, now_ms: Column, errors: DataFrame | None = None) -> DataFrame:
    """live / waiting / disconnected / error per requested list with the age and row count of its newest snapshot.

    ``errors`` (list_key, received_ms, error): an error counts until a snapshot that is not older arrives; it then comes as a column.
    """
    counts = snaps.groupBy("list_key", "received_ms").agg(F.count(F.lit(1)).alias("row_count"))
    last = counts.groupBy("list_key").agg(F.max_by(F.struct("received_ms", "row_count"), "received_ms").alias("s")).select("list_key", "s.*")
    j = requested.join(last, "list_key", "left")
    status, more = F.when(~F.lit(connected), "disconnected").when(F.col("received_ms").isNotNull(), "live").otherwise("waiting"), []
    if errors is not None:
        failed = errors.groupBy("list_key").agg(F.max(F.struct("received_ms", "error")).alias("_e"))
        standing = F.coalesce(F.col("_e.received_ms") > F.col("received_ms"), F.col("_e").isNotNull())
        j = j.join(failed, "list_key", "left").withColumn("error", F.when(standing, F.col("_e.error")))
        status, more = F.when(F.col("error").isNotNull(), "error").otherwise(status), ["error"]
    return j.select("list_key", status.alias("status"), F.when(F.col("received_ms").isNotNull(), F.greatest(F.lit(0), now_ms - F.col("received_ms"))).alias("receipt_age_ms"),
                    F.coalesce("row_count", F.lit(0)).alias("row_count"), *more)


def latest_sessions(archive: DataFrame, keep: int) -> DataFrame:
    """Newest version of each session date, for the last ``keep`` dates."""
    one = archive.groupBy("session_date").agg(F.max_by(F.struct(*[c for c in archive.columns if c != "session_date"]), "updated_at").alias("r"))
    dates = one.select("session_date").orderBy(F.col("session_date").desc()).limit(keep)
    return one.join(dates, "session_date", "left_semi").select("session_date", "r.*")


def attach_decisions(cands: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates with their membership decisions in time order."""
    d = decisions.groupBy("session_date", "symbol").agg(F.sort_array(F.collect_list(F.struct("decided_ms", "decision"))).alias("d"))
    return cands.join(d, ["session_date", "symbol"], "left").withColumn("decisions", F.transform("d", lambda x: x["decision"])).drop("d")


def save_watchlist(existing: DataFrame, picked: DataFrame, known: DataFrame, replace: bool) -> tuple[DataFrame, DataFrame]:
    """(new watchlist, rejected symbols): unknown symbols are rejected; appending keeps the old order first."""
    rejected = picked.join(known, "symbol", "left_anti").select("symbol").distinct()
    good = picked.join(known, "symbol", "left_semi").select("symbol", F.lit(1).alias("part"), "place")
    base = good if replace else existing.select("symbol", F.lit(0).alias("part"), "place").unionByName(good)
    merged = base.groupBy("symbol").agg(F.min(F.struct("part", "place")).alias("p")).select("symbol", "p.*")
    return merged, rejected

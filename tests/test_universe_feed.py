"""Overlap of universes, stream budgets, errors of market lists and pages after a durable event id."""
import pytest
from pyspark.sql import functions as F

from barwright.operators import discovery, rules, universe


def symbols(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "symbol string")


def test_overlap_counts_each_symbol_once(spark):
    a, b = symbols(spark, "A", "B", "B", "C"), symbols(spark, "B", "C", "D", "E", "E")
    assert universe.overlap(a, b).first().asDict() == {"both_n": 2, "either_n": 5, "a_only": 1, "b_only": 2, "overlap_pct": 40.0, "a_covered_pct": pytest.approx(200 / 3)}
    none = universe.overlap(symbols(spark, "A").limit(0), symbols(spark, "A").limit(0)).first()
    assert (none.either_n, none.overlap_pct, none.a_covered_pct) == (0, 0.0, 0.0)


def test_budget_counts_support_that_the_list_lacks_and_cuts_nothing(spark):
    lists = spark.createDataFrame([("x", " spy"), ("x", "AA"), ("x", "aa"), ("x", ""), ("x", None), ("y", "AA"), ("y", "BB"), ("y", "CC")], "list string, symbol string")
    got = {r.list: tuple(r)[1:] for r in universe.stream_budget(lists, symbols(spark, "SPY", "XLK", "xlk ", " "), cap=4).collect()}
    assert got == {"x": (2, 1, 3, 0), "y": (3, 2, 5, 1)}


def test_list_error_stands_until_a_newer_snapshot(spark):
    snaps = spark.createDataFrame([("a", 100), ("a", 100), ("b", 100), ("c", 100)], "list_key string, received_ms long")
    errors = spark.createDataFrame([("a", 150, "old"), ("a", 200, "new"), ("b", 90, "past"), ("c", 100, "same time"), ("d", 1, "first")], "list_key string, received_ms long, error string")
    wanted = spark.createDataFrame([(k,) for k in "abcde"], "list_key string")
    got = {r.list_key: (r.status, r.receipt_age_ms, r.row_count, r.error) for r in discovery.list_health(snaps, wanted, True, F.lit(300), errors).collect()}
    assert got == {"a": ("error", 200, 2, "new"), "b": ("live", 200, 1, None), "c": ("live", 200, 1, None), "d": ("error", None, 0, "first"), "e": ("waiting", None, 0, None)}
    off = {r.list_key: r.status for r in discovery.list_health(snaps, wanted, False, F.lit(300), errors).collect()}
    assert off == {"a": "error", "b": "disconnected", "c": "disconnected", "d": "error", "e": "disconnected"}


def test_page_after_event_and_lost_cursor(spark):
    e = spark.range(1, 11).select(F.col("id").alias("seq"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("event_id"), (F.col("id") % 2 == 0).alias("mine"))
    page = lambda after, limit: [(r.seq, r.has_more) for r in rules.page_after_event(e, after, limit, F.col("mine")).orderBy("seq").collect()]
    assert page("e3", 2) == [(4, True), (6, True)]
    assert page("e3", 4) == [(4, False), (6, False), (8, False), (10, False)]
    assert page(None, 1) == [(2, True)]
    assert page("e10", 5) == []
    with pytest.raises(Exception, match="cursor not in retained archive"):
        page("e99", 5)

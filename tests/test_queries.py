"""Registered queries against their SQL at the smallest scale (check.py runs all of them)."""
import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ["bars_minute", "candles_covered", "indicator_macd", "rrs_five_minute", "rvol_time_of_day", "trigger_break_recent_high", "trigger_near_hod", "trigger_ta_rsi_cross",
          "condition_ema_hold", "condition_market_cap", "alerts_vwap_cross_cooldown", "alerts_assembled", "toplist_movers_5m", "quote_quality", "merge_report", "wire_quotes",
          "universe_diff", "news_headline_dedupe"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0] and repr(got[1]) == repr(want[1])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

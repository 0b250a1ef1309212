"""Symbol directories, universe files and RSS items."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.universe import EXCHANGES
from . import schemas


def read_directory(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One pipe-delimited directory file ('listed' or 'other'); test issues and the trailer line are dropped."""
    raw = spark.read.option("sep", "|").option("header", True).option("nullValue", "\u0000").csv(path)
    sym = "Symbol" if kind == "listed" else "ACT Symbol"
    d = raw.where(~F.col(f"`{sym}`").startswith("File Creation Time") & (F.coalesce("Test Issue", F.lit("")) != "Y"))
    if kind == "listed":
        exchange = F.lit("Nasdaq")
    else:
        names = F.create_map(*[F.lit(x) for kv in EXCHANGES.items() for x in kv])
        exchange = F.coalesce(F.try_element_at(names, F.col("Exchange")), F.col("Exchange"))
    return d.select(F.trim(F.col(f"`{sym}`")).alias("symbol"), F.col("`Security Name`").alias("name"), exchange.alias("exchange"),
                    (F.col("ETF") == "Y").alias("etf"))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Sorted distinct upper-case tickers; every field is text, so NA and NAN stay tickers."""
    u = spark.read.option("header", True).option("nullValue", "").option("inferSchema", False).csv(path)
    return u.select(F.upper(F.trim("symbol")).alias("symbol")).where("symbol <> ''").distinct().orderBy("symbol")


def read_meta(spark: SparkSession, universe_path: str, sector_path: str) -> DataFrame:
    """Universe figures and sector map, full outer on the symbol; numbers that do not parse are NULL."""
    u = spark.read.option("header", True).csv(universe_path).select(F.upper(F.trim("symbol")).alias("symbol"), F.expr("try_cast(price as double)").alias("price"))
    s = spark.read.option("header", True).csv(sector_path).select(F.upper(F.trim("symbol")).alias("symbol"), F.col("sector_etf"))
    return u.join(s, "symbol", "full")


def parse_rss(items: DataFrame, text: str = "xml") -> DataFrame:
    """RSS items held as XML text (columns symbol, source, xml) in the common news shape; undated or untitled items are dropped."""
    from ..operators.news import clean_text
    p = items.select("symbol", "source", F.from_xml(text, schemas.RSS_ITEM).alias("i"))
    tickers = F.filter(F.transform(F.split(F.coalesce("i.tickers", F.lit("")), ","), lambda s: F.upper(F.trim(s))), lambda s: s != "")
    created = F.try_to_timestamp(F.regexp_replace("i.pubDate", "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss Z"))
    head = clean_text(F.coalesce(F.col("i.title"), F.lit("")))
    return (p.select(F.concat_ws(":", "source", F.coalesce("i.guid", "i.link")).alias("id"), head.alias("headline"),
                     clean_text(F.coalesce(F.col("i.description"), F.lit(""))).alias("summary"), F.trim("i.link").alias("url"), "source",
                     F.concat(F.array("symbol"), F.filter(tickers, lambda s: s != F.col("symbol"))).alias("symbols"), created.alias("created_at"))
             .where("headline <> '' and url <> '' and created_at is not null"))

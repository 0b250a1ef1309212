"""URL filtering by rules and by a list of URLs: a blocked Bloom filter first, an exact hash join for its hits.

All expressions are DataFrame functions.  A URL's canonical form is its host without a leading ``www.`` or ``m.`` followed by its path
without ``.html`` at the end and without a closing slash; scheme, query and fragment do not count.  The filter is a table of 64-bit blocks:
a URL's hash names one block and sets ``_BITS`` bits in it, so a probe reads one block.  Blocks are built by a bit-wise OR that combines in the
map tasks.  Their number follows the length of the list up to ``MAX_BLOCKS`` (2 MB of blocks), which bounds what is broadcast; a longer
list only lets more URLs through to the exact join, never fewer.

A null URL, or one without ``://``, has an empty host and path, fits no rule and is not listed, so it is allowed.  Repeated rows keep their
number.  An empty list blocks nothing.  Columns of the input that clash with the added ones (host, path, rule, verdict) are replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .store import written

MAX_BLOCKS = 1 << 18
_BITS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path prefix, verdict) of the rules; a rule fits its host and all subdomains.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def parts(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.locate("://", url)
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """The form under which URLs are listed and looked up."""
    return F.concat(F.regexp_replace(host, r"\A(www\.|m\.)", ""), F.regexp_replace(F.regexp_replace(path, r"\.html\z", ""), r"/\z", ""))


def domain_list(pages: DataFrame, domains: tuple[str, ...], url: str = "url") -> DataFrame:
    """The URLs of ``pages`` whose host has one of ``domains`` as a label before the last one."""
    return pages.where(parts(url)[0].rlike(r"(^|\.)(" + "|".join(domains) + r")\.")).select(F.col(url).alias("url"))


def _place(c: Column, blocks: int) -> tuple[Column, Column]:
    """Block number and bit mask of a canonical URL."""
    h = F.xxhash64(c)
    mask = F.lit(0).cast("long")
    for k in range(_BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")))
    return F.pmod(F.xxhash64(c, F.lit(1)), F.lit(blocks)), mask


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of a table of canonical URLs (column ``c``): one row per block that has a bit set."""
    block, mask = _place(F.col("c"), blocks)
    return listed.groupBy(block.alias("_block")).agg(F.bit_or(mask).alias("_bits"))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, or null."""
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for h, p, v in rules]
    return F.greatest(*fits, F.lit(None).cast("struct<size:int,rule:string,verdict:string>"))


def filter_urls(pages: DataFrame, listed_urls: DataFrame, url: str = "url", rules=RULES, bits_per_url: int = 12) -> DataFrame:
    """``pages`` with host, path, rule and verdict: the longest rule's verdict, else ``block`` for a listed URL, else ``allow``."""
    host, path = parts("url")
    listed = written(listed_urls.select(F.col(listed_urls.columns[0]).cast("string").alias("url")).select(canonical(host, path).alias("c")).where("c <> ''").distinct(), "listed-urls")
    blocks = max(1, min(MAX_BLOCKS, listed.count() * bits_per_url // 64 + 1))
    host, path = parts(F.col(url).cast("string"))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    found = (pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host.alias("host"), path.alias("path"))
             .withColumn("fit", rule_for(F.col("host"), F.col("path"), rules)).withColumn("c", canonical(F.col("host"), F.col("path"))))
    block, mask = _place(F.col("c"), blocks)
    probed = (found.withColumn("_b", block).withColumn("_m", mask)
              .join(F.broadcast(bloom_blocks(listed, blocks)), F.col("_b") == F.col("_block"), "left")  # at most MAX_BLOCKS rows
              .withColumn("maybe", F.col("fit").isNull() & F.coalesce(F.col("_bits").bitwiseAND(F.col("_m")) == F.col("_m"), F.lit(False))))
    hits = probed.where("maybe").join(listed.withColumnRenamed("c", "_c"), F.col("c") == F.col("_c"), "left").withColumn("sure", F.col("_c").isNotNull())
    rest = probed.where(~F.col("maybe")).withColumn("sure", F.lit(False))
    columns = ["row", "host", "path", "fit", "sure"]
    return hits.select(*columns).unionByName(rest.select(*columns)).select(
        "row.*", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), F.when(F.col("sure"), "block").otherwise("allow")).alias("verdict"))

"""Importance resampling against a plain model and zlib's CRC-32."""
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from barwright.llm import resampling

DOCS = "doc_id bigint, text string"


def rows():
    r = random.Random(3)
    words = ["".join(r.choice("abcdeé9") for _ in range(r.randint(1, 9))) for _ in range(150)]
    text = lambda n: r.choice([" ", "-", "\n", "\x7f", " .. "]).join(r.choice(words) for _ in range(n))
    out = [(k, text(r.randint(0, 60)).upper() if k % 7 == 0 else text(r.randint(0, 60))) for k in range(400)]
    return out + [(1000, None), (1001, ""), (1002, "--- ___"), (1003, "x" * 70_000 + " " + text(30)), (1004, text(30_000)), (1005, "日本 語 ß \xa0 ok")]


@pytest.mark.parametrize("length", [0, 1, 3, 8, 9, 255, 256, 257, 511, 512, 513, 1000, 4096])
def test_crc_of_rows_equals_zlib(length):
    matrix = np.random.default_rng(length).integers(0, 256, (20, length), dtype=np.uint8)
    assert resampling.crc32_rows(matrix).tolist() == [zlib.crc32(m.tobytes()) for m in matrix]


def test_crc_of_ranges_equals_zlib():
    r = np.random.default_rng(1)
    raw = r.integers(97, 100, 5000, dtype=np.uint8)
    starts = r.integers(0, 4000, 700)
    ends = starts + r.integers(0, 600, 700)
    assert resampling.crc32_ranges(raw, starts, ends).tolist() == [zlib.crc32(raw[s:e].tobytes()) for s, e in zip(starts, ends)]


@pytest.mark.parametrize("sizes", [(1, 1), (1, 2), (2, 3)])
def test_draw_equals_plain_model(spark, sizes):
    target = [t for d, t in rows() if d % 5 == 0] + [None]
    docs = spark.createDataFrame(rows(), DOCS).withColumn("score", F.lit("old")).withColumn("rank", F.lit(0)).repartition(3)
    out = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), 10, sizes, 997)
    got = sorted(tuple(x) for x in out.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())
    assert got == brute.resampled(rows(), target, 997, sizes=sizes)


def test_draw_prefers_documents_of_the_target(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "if(id % 2 = 0, repeat('news of the day ', 10), repeat('buy cheap pills now ', 10)) as text")
    drawn = resampling.resample(docs, spark.createDataFrame([("news of the day",)] * 50, "text string")).where("rank is not null")
    assert drawn.count() == 200 and drawn.where("doc_id % 2 = 0").count() > 150
    assert sorted(x["rank"] for x in drawn.collect()) == list(range(1, 201))


def test_repeated_and_null_ids_empty_tables(spark):
    text = " ".join(["word"] * 25)
    docs = spark.createDataFrame([(1, text)] * 10 + [(None, text)] * 10, DOCS)
    target = spark.createDataFrame([], "text string")
    out = resampling.resample(docs, target, 50)
    assert out.count() == 20 and sorted(x["rank"] for x in out.where("rank is not null").collect()) == list(range(1, 11))
    assert resampling.resample(docs.limit(0), target).count() == 0
    assert resampling.resample(docs.withColumn("text", F.lit(None)), target).where("rank is null and weight = 0").count() == 20
    with pytest.raises(ValueError):
        resampling.bucket_counts(docs, sizes=(0, 1))

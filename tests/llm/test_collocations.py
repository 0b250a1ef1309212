"""Collocations against a plain model: ranked ids, bitmaps, dense and sparse tiles, exact scores."""
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from barwright.llm import collocations

DOCS = "doc_id bigint, lang string, text string"


def rows():
    r = random.Random(4)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(60)]
    fixed = ["new york city", "of the", "a b a b a b", "Ab c", "naïve bayes"]
    out = []
    for k in range(250):
        t = [r.choice(fixed) if r.random() < 0.3 else r.choice(words) for _ in range(r.randint(1, 40))]
        out.append((k, (None, "en", "und", "de")[k % 4], "".join(x + r.choice([" ", " ", " ", "\t", ". ", ",", "\n", "; ", "\x0b"]) for x in t)))
    return out + [(900, "en", None), (901, "en", ""), (902, "xx", "... ,,, \n"), (903, "de", "the same " * 12_000), (904, "en", "y" * 200_000 + " of the"), (0, None, out[0][2]), (None, "en", "of the of the\xa0x of the")]


@pytest.mark.parametrize("head, chunk, tile, dense", [(1 << 17, 1 << 20, 512, 1 << 16), (12, 300, 4, 8), (0, 1000, 8, 1)])
@pytest.mark.parametrize("longest", [3, 4])
def test_phrases_equal_plain_model(spark, monkeypatch, head, chunk, tile, dense, longest):
    for name, value in (("CHUNK", chunk), ("TILE", tile), ("DENSE", dense)):
        monkeypatch.setattr(collocations, name, value)
    docs = spark.createDataFrame(rows(), DOCS).withColumn("word", F.lit("old")).withColumn("n", F.lit(0)).repartition(3)
    got = collocations.collocations(docs, longest, least=5, per_lang=60, head=head, map_bits=12).collect()
    want = brute.collocations([(g, t) for _, g, t in rows()], longest, 5, per_lang=60)
    assert sorted(tuple(x) for x in got) == sorted(want) and len({x[0] for x in want}) >= 3


def test_pairs_in_dense_and_sparse_tiles():
    r = np.random.default_rng(2)
    a, b = r.zipf(1.3, 200_000) % 3000, r.zipf(1.3, 200_000) % 2000
    got = collocations.count_pairs(a, b, 3000, 2000)
    assert Counter(dict(zip(zip(got[0].tolist(), got[1].tolist()), got[2].tolist()))) == Counter(zip(a.tolist(), b.tolist()))
    assert len(got[0]) == len(set(zip(got[0].tolist(), got[1].tolist())))


def test_scores_beyond_64_bits_are_exact(spark):
    """10^6 * a * a of counts that no small table reaches: the score expression on given counts."""
    a, left, right = 3 * 10**12 + 7, 7 * 10**12 + 1, 5 * 10**12 + 3
    words = spark.createDataFrame([(1, left, "en", "x"), (2, right, "en", "y")], "w0 bigint, n bigint, lang string, word string")
    pairs = spark.createDataFrame([(1, 2, a)], "w0 bigint, w1 bigint, n bigint")
    out = collocations._scored({1: words, 2: pairs}, 2, ["w0", "w1"], 50, False).first()
    assert out["score"] == 10**6 * a * a // (left * right) and (out["l"], out["r"], out["a"]) == (left, right, a)


def test_empty_tables_and_columns(spark):
    docs = spark.createDataFrame(rows()[:20], DOCS)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.withColumn("text", F.lit(None))).count() == 0
    assert {x["lang"] for x in collocations.collocations(docs.withColumn("lang", F.lit(None)), least=2).collect()} == {"und"}
    with pytest.raises(ValueError):
        collocations.collocations(docs, 1)

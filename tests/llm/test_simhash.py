"""SimHash groups against all pairs; the guarantee of the covering masks."""
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from barwright.llm import simhash

DOCS = "doc_id bigint, text string"


def rows():
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    base = [[r.choice(words) for _ in range(n)] for n in (8, 40, 200)]
    out = []
    for k in range(240):
        own = list(base[k % 3])
        for _ in range(r.randint(0, 2)):
            own[r.randrange(len(own))] = r.choice(words)
        out.append((k, " ".join(own).upper() if k % 11 == 0 else "\t".join(own)))
    return out + [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "One"), (505, "é ß"), (506, " ".join(r.choice(words) for _ in range(40_000))), (507, "x" * 300_000), (3, out[3][1]), (3, "one")]


def test_fingerprints_equal_plain_model_and_sparks_hash(spark):
    texts = [t for _, t in rows()]
    got = np.concatenate(list(simhash.fingerprints_of(pa.array(texts, pa.string()), 3))).tolist()
    assert got == [brute.simhash(t) for t in texts]
    one = spark.createDataFrame([("é ß",)], "t string").select(F.xxhash64("t")).first()[0]
    assert one % 2**64 == brute.simhash("é ß")


@pytest.mark.parametrize("open_bits", [64, 30, 14, 6, 3, 1])
def test_masks_cover_every_difference_within_the_radius(open_bits):
    bits = np.sort(np.random.default_rng(open_bits).permutation(64)[:open_bits])
    masks = simhash.covering_masks(bits, 3)
    for n in range(1, min(3, open_bits) + 1):
        d = np.array([sum(1 << int(b) for b in c) for c in combinations(bits, n)], np.uint64)
        assert ((d[:, None] & masks[None]) == 0).any(1).all()


@pytest.mark.parametrize("leaf", [512, 16])
def test_links_join_what_all_pairs_join(spark, leaf):
    """Walks of few bits around three centres, so that buckets are large and have to be cut again."""
    r, values = random.Random(leaf), set()
    for centre in (0, 2**64 - 1, 0x123456789ABCDEF0):
        for _ in range(250):
            x = centre
            for _ in range(r.randint(0, 9)):
                x ^= 1 << r.randrange(64)
            values.add(x)
    values |= {r.getrandbits(64) for _ in range(100)}
    values = sorted(values)
    nodes = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp bigint")
    got = [(x["a"] % 2**64, x["b"] % 2**64) for x in simhash.links(nodes, 3, leaf).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in got)
    index = {v: k for k, v in enumerate(values)}
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in got:
        x, y = root(index[a]), root(index[b])
        parent[max(x, y)] = min(x, y)
    want = brute.components(range(len(values)), values, lambda x, y: (x ^ y).bit_count() <= 3)
    assert [root(k) for k in range(len(values))] == want


def test_groups_equal_plain_model(spark):
    docs = spark.createDataFrame(rows(), DOCS).withColumn("fp", F.lit("old")).withColumn("comp", F.lit(1)).repartition(4)
    got = sorted((x["doc_id"], x["fingerprint"], x["component_id"]) for x in simhash.simhash_groups(docs).collect())
    ids, prints = zip(*[(d, brute.simhash(t)) for d, t in rows()])
    # rows of one doc_id are nodes of their own; the plain model links equal prints by distance zero
    comp = brute.components(ids, prints, lambda x, y: (x ^ y).bit_count() <= 3)
    assert got == sorted((d, f"{p:016x}", c) for d, p, c in zip(ids, prints, comp))


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "alpha beta gamma delta"), (None, "alpha beta gamma delta"), (9, ""), (4, None)], DOCS)
    got = sorted(((x["doc_id"], x["component_id"]) for x in simhash.simhash_groups(docs).collect()), key=repr)
    assert got == [(4, 4), (9, 4), (None, None), (None, None)]
    assert simhash.simhash_groups(docs.limit(0)).count() == 0

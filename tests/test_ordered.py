"""Order-dependent helpers against plain loops, on shuffled input."""
import random

import pytest
from pyspark.sql import functions as F

from barwright.functions.asof import asof
from barwright.functions.ordered import Smooth, lagged, position, recurrence, rolling, running, running_sum, segments


def smooth(values, n, k, start=1, seed_first=False):
    out, y = [], None
    for p, v in enumerate(values, 1):
        seed = start if seed_first else start + n - 1
        if p < seed:
            out.append(None)
        elif p == seed:
            y = v if seed_first else sum(values[start - 1:seed]) / n
            out.append(y)
        else:
            y = k * v + (1 - k) * y
            out.append(y)
    return out


@pytest.mark.parametrize("rows", [10, 300, 1500, 140_000])
def test_recurrence_over_chunk_and_super_chunk_borders(spark, rows):
    rnd = random.Random(rows)
    values = [rnd.uniform(-5, 50) for _ in range(rows)]
    df = spark.createDataFrame(list(enumerate(values, 1)), "pos long, v double").withColumn("k", F.lit("a")).repartition(5)
    specs = [Smooth("e3", "v", 3), Smooth("e21", "v", 21), Smooth("w14", "v", 14, wilder=True, start=2), Smooth("f9", "v", 9, seed_first=True), Smooth("e1", "v", 1)]
    got = {r.pos: r for r in recurrence(df, ["k"], "pos", specs).collect()}
    assert len(got) == rows
    for s in specs:
        want = smooth(values, s.n, s.k, s.start, s.seed_first)
        for p in list(range(1, min(rows, 600) + 1)) + [x for x in (65_536, 65_537, 65_800, 131_072, 131_073, rows) if x <= rows]:
            w, g = want[p - 1], got[p][s.out]
            assert (w is None) == (g is None), (s.out, p)
            if w is not None:
                assert abs(w - g) < 1e-9, (s.out, p, w, g)


def test_long_smoothing_is_exact_over_many_super_chunks(spark):
    """n = 5,000 over 300,000 rows: the first rows still weigh in, and the chain over super-chunks cuts nothing off."""
    rnd = random.Random(5)
    values = [rnd.uniform(-5, 50) + (1e6 if p < 6000 else 0) for p in range(300_000)]
    df = spark.createDataFrame(list(enumerate(values, 1)), "pos long, v double").withColumn("k", F.lit("a")).repartition(4)
    specs = [Smooth("w", "v", 5000, wilder=True), Smooth("e", "v", 40_000)]
    out = rolling(recurrence(df, ["k"], "pos", specs), ["k"], "pos", 4999, lambda w: {"m": F.avg("v").over(w.rowsBetween(-4999, 0))})
    at = [4999, 5000, 5001, 40_000, 65_536, 65_537, 131_072, 131_073, 196_609, 262_144, 262_145, 300_000]
    got = {r.pos: r for r in out.where(F.col("pos").isin(at)).collect()}
    for s in specs:
        want = smooth(values, s.n, s.k)
        for p in at:
            w, g = want[p - 1], got[p][s.out]
            assert (w is None) == (g is None) and (w is None or abs(w - g) <= 1e-9 * max(1.0, abs(w))), (s.out, p, w, g)
    assert all(abs(got[p].m - sum(values[p - 5000:p]) / 5000) < 1e-6 * 1e6 for p in at[1:])


def test_position_rolling_running_do_not_depend_on_partitions(spark):
    rnd = random.Random(3)
    data = [(k, d, m, float(rnd.randint(0, 99))) for k in "ab" for d in range(7) for m in range(rnd.randint(1, 40))]
    want = {}
    for k in "ab":
        rows = sorted(r for r in data if r[0] == k)
        for i, r in enumerate(rows):
            last = [x[3] for x in rows[max(0, i - 4):i + 1]]
            want[r[:3]] = (i + 1, sum(last), max(x[3] for x in rows[:i + 1]), sum(x[3] for x in rows[:i + 1]), rows[i - 1][3] if i else None)
    for parts in (1, 7):
        df = spark.createDataFrame(random.sample(data, len(data)), "k string, d int, m int, v double").repartition(parts)
        p = position(df, ["k"], ["d"], ["m"])
        p = rolling(p, ["k"], "pos", 4, lambda w: {"s5": F.sum("v").over(w.rowsBetween(-4, 0))}, block=8)
        p = running(p, ["k"], ["d"], ["m"], {"top": ("max", F.col("v"))})
        p = running_sum(p, ["k"], "pos", "v", "cum", block=8)
        p = lagged(p, ["k"], ["d"], ["m"], {"prev": "v"})
        got = {(r.k, r.d, r.m): (r.pos, r.s5, r.top, r.cum, r.prev) for r in p.collect()}
        assert got == want


def test_asof_takes_the_newest_earlier_row_over_chunk_borders(spark):
    rnd = random.Random(5)
    left = [("a", d, m) for d in range(6) for m in range(0, 50, 7)] + [("b", 2, 3)]
    right = [("a", d, m, float(d * 100 + m)) for d in (1, 3) for m in rnd.sample(range(50), 5)]
    got = {(r.k, r.d, r.m): r.x for r in asof(spark.createDataFrame(left, "k string, d int, m int"), spark.createDataFrame(right, "k string, d int, m int, x double"),
                                             ["k"], "d", "m", ["x"]).collect()}
    for k, d, m in left:
        earlier = [r for r in right if r[0] == k and (r[1], r[2]) <= (d, m)]
        assert got[k, d, m] == (max(earlier, key=lambda r: (r[1], r[2]))[3] if earlier else None)


def test_segments_restart_after_missing_input(spark):
    df = spark.createDataFrame([("a", 0, i, None if i in (3, 4) else float(i)) for i in range(8)], "k string, c int, i int, v double")
    got = {r.i: (r.seg, r.pos) for r in segments(df, ["k"], ["c"], ["i"], ["v"]).collect()}
    assert got == {0: (0, 1), 1: (0, 2), 2: (0, 3), 5: (2, 1), 6: (2, 2), 7: (2, 3)}

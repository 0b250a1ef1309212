"""Greedy folds and one-to-one matching against plain models."""
import datetime
import random

from pyspark.sql import functions as F

from barwright.operators import merging as mg
from barwright.operators import rules as ru

D = datetime.date(2024, 1, 2)


def test_spaced_equals_a_plain_loop(spark):
    rnd = random.Random(2)
    rows = sorted({(s, D + datetime.timedelta(d), rnd.randint(570, 700)) for s in "ab" for d in range(3) for _ in range(60)})
    got = sorted((r.symbol, r.et_date, r.et_min) for r in ru.spaced(spark.createDataFrame(rows, "symbol string, et_date date, et_min int"), ["symbol"], 300).collect())
    want, last = [], {}
    for s, d, m in rows:
        if (s, d) not in last or m - last[s, d] >= 5:
            last[s, d] = m
            want.append((s, d, m))
    assert got == want


SETUP = [("s1", "and", "long", None, ["rth"], 600, 5, 2, [("a", "", 1, 0), ("b", "", 1, 240)], [], "up_all"),
         ("s2", "atleast", "all", None, ["rth"], 0, 10, 2, [("a", "", 1, 0), ("b", "", 1, 0), ("c", "", 1, 0)], [], "up_all"),
         ("s3", "or", "all", None, ["rth"], 180, 5, 2, [("c", "", 1, 0), ("a", "", 1, 420)], [], "up_all")]


def plain_fold(fires, ok):
    """Sequential model of one symbol-day: list of (setup, minute, outcome, lead, direction, size, reason, evidence)."""
    out = []
    for name, mode, want, _, _, rep, window, least, triggers, _, _ in SETUP:
        ids = [f"{t[0]}:{t[1]}@1" for t in triggers]
        need = len(ids) if mode == "and" else min(max(1, least), len(ids))
        seen, last_t, last, feed = {}, {}, None, {}
        for m in range(570, 960):
            fired = {}
            for i, t in enumerate(triggers):
                side = fires.get((t[0], m))
                if side is None or not (want == "all" or side in (want, "neutral")):
                    continue
                if t[3] and ids[i] in last_t and (m - last_t[ids[i]]) * 60 < t[3]:
                    out.append((name, m, "repeat", ids[i], side, 1, "trigger repeat", ()))
                else:
                    fired[ids[i]] = (m, side)
            if not fired and (mode == "or" or not seen):
                continue
            used = dict(fired)
            if mode != "or":
                seen.update(fired)
                seen = used = {k: v for k, v in seen.items() if v[0] >= m - window}
            lead = next(iter(fired)) if fired else max(used, key=lambda k: used[k][0]) if used else None
            row = lambda kind, reason, names=(): (name, m, kind, lead, used[lead][1], len(used), reason, tuple(sorted(names)))  # noqa: E731, B023
            if mode != "or" and len(seen) < need:
                out += [row("waiting", "combination")] if fired else []
            elif rep and last is not None and (m - last) * 60 < rep:
                out += [row("repeat", "setup repeat")] if fired else []
            elif not ok(name, m):
                out.append(row("blocked", "screen"))
            elif m - feed.get((lead, used[lead][1]), -100) < 5:
                out.append(row("repeat", "feed cooldown"))
            else:
                out.append(row("sent", "", used))
                last, seen, feed[lead, used[lead][1]] = m, {}, m
                last_t.update(dict.fromkeys(used, m))
    return sorted(out)


def folded(spark, fires, ok):
    f = spark.createDataFrame([("X", D, m, "rth", t, "", 1, d, 1.0) for (t, m), d in fires.items()],
                              "symbol string, et_date date, et_min int, session string, trigger string, option string, tf int, direction string, value double")
    verdicts = spark.createDataFrame([(s[0], "X", D, m, ok(s[0], m)) for s in SETUP for m in range(570, 960)], "setup string, symbol string, et_date date, et_min int, ok boolean")
    return ru.fold_setups(ru.evaluation_rows(ru.match(f, ru.setups_table(spark, SETUP))).join(verdicts, ["setup", "symbol", "et_date", "et_min"]))


def test_fold_setups_equals_a_plain_model(spark):
    """Trigger repeats, combinations, setup repeats, screen and feed cooldown in one decision, for sparse and busy days."""
    for seed, share in ((8, 0.12), (9, 0.4), (10, 0.03)):
        rnd = random.Random(seed)
        fires = {(t, m): rnd.choice(["long", "short", "neutral"]) for t in "abc" for m in range(570, 960) if rnd.random() < share}
        ok = lambda name, m: (m // 9) % 3 != 0
        got = sorted((r.setup, r.et_min, r.outcome, r.lead, r.direction, r.n_evidence, r.reason, tuple(sorted(r.evidence))) for r in folded(spark, fires, ok).collect())
        want = plain_fold(fires, ok)
        assert got == want
    assert {"trigger repeat", "setup repeat", "feed cooldown", "screen", "combination", ""} <= {r[6] for s, share in ((9, 0.4),) for r in plain_fold(
        {(t, m): random.Random(f"{t}{m}").choice(["long", "short"]) for t in "abc" for m in range(570, 960)}, lambda name, m: m % 7 != 0)}


def test_a_sent_alert_alone_moves_the_clocks(spark):
    """A screen that opens late: the blocked bars neither clear the evidence nor start the repeat time."""
    fires = {("a", 600): "long", ("b", 602): "long", ("a", 606): "long"}
    got = [(r.et_min, r.outcome) for r in folded(spark, fires, lambda name, m: m >= 604).where("setup = 's1'").orderBy("et_min").collect()]
    assert got == [(600, "waiting"), (602, "blocked"), (603, "blocked"), (604, "sent"), (606, "waiting")]


def test_alert_matching_is_one_to_one_nearest_first(spark):
    rnd = random.Random(4)
    a = sorted(rnd.sample(range(570, 800), 60))
    b = sorted(rnd.sample(range(570, 800), 55))
    used, want = set(), []
    for m in a:
        free = [(abs(x - m), x) for x in b if x not in used and abs(x - m) <= 3]
        if free:
            used.add(min(free)[1])
            want.append(("both", m, min(free)[1]))
        else:
            want.append(("a", m, None))
    want += [("b", None, x) for x in b if x not in used]
    mk = lambda xs: spark.createDataFrame([("X", D, x) for x in xs], "symbol string, et_date date, et_min int")
    got = [(r.side, r.a_min, r.b_min) for r in mg.match_alerts(mk(a), mk(b), ["symbol"]).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_score_bounds(spark):
    df = spark.createDataFrame([(None, 1), (0.0, 3), (1.25, 1), (9.0, 9)], "r double, n int").select(ru.score(F.col("r"), F.col("n")).alias("s"))
    assert [r.s for r in df.collect()] == [55, 65, 57, 95]


def test_strength_against_each_symbols_own_sector(spark):
    """One sector for all symbols is the single-benchmark form; with two sectors each symbol has the strength against its own."""
    from barwright.operators import relative as rel
    from barwright.plans.tables import tables
    t = tables(spark, "/root/testdata/sf0.001")
    key = lambda df: {(r.symbol, r.et_date, r.slot): r.rrs_m5 for r in df.where("rrs_m5 is not null").collect()}
    symbols = t.sessions.select("symbol").distinct()
    one, other = key(rel.rrs_intraday(t.candles, "S01")), key(rel.rrs_intraday(t.candles, "S02"))
    assert key(rel.rrs_against(t.candles, symbols.withColumn("sector", F.lit("S01")))) == one
    odd = F.substring("symbol", 2, 2).cast("int") % 2 == 1
    both = key(rel.rrs_against(t.candles, symbols.withColumn("sector", F.when(odd, "S02").otherwise("S01"))))
    want = {k: v for src, side in ((other, 1), (one, 0)) for k, v in src.items() if int(k[0][1:]) % 2 == side}
    assert both == want and want


def test_values_still_warming_up_pass_every_operator(spark):
    setups = ru.setups_table(spark, [(op, "or", "all", None, ["rth"], 0, 5, 2, [("a", "", 1, 0)], [("c", op, 1.0)], "up_all") for op in ("gte", "lte", "gt", "lt")])
    rows = spark.createDataFrame([(op, "X", D, m) for op in ("gte", "lte", "gt", "lt") for m in (600, 601, 602)], "setup string, symbol string, et_date date, et_min int")
    values = spark.createDataFrame([("X", D, 600, float("nan")), ("X", D, 601, None), ("X", D, 602, 1.0)], "symbol string, et_date date, et_min int, c double")
    got = {(r.setup, r.et_min): r.ok for r in ru.with_verdict(rows, values, setups, ["c"]).collect()}
    assert all(got[op, 600] and not got[op, 601] for op in ("gte", "lte", "gt", "lt")) and [got[op, 602] for op in ("gte", "lte", "gt", "lt")] == [True, True, False, False]


def test_published_alerts_are_accepted_once(spark, monkeypatch):
    """The numbers are those of the accepted alerts in order, and the plan that numbers them holds no acceptance: it reads stored rows."""
    from barwright.plans import q_rules, q_sources  # noqa: F401
    from barwright.plans.registry import QUERIES
    from barwright.plans.tables import tables
    t = tables(spark, "/root/testdata/sf0.001")
    want = sorted((r.et_date, r.et_min, r.setup, r.symbol) for r in q_rules.alerts(t).collect())
    p = QUERIES["alerts_published"](t)
    assert not [x for x in ("MapInArrow", "aggregate(", "bw_state") if x in p._jdf.queryExecution().executedPlan().toString()]
    got = [(r.et_min, r.setup, r.symbol, r.seq) for r in p.orderBy("seq").collect()]
    assert got == [(m, s, x, 1001 + n) for n, (_, m, s, x) in enumerate(want)] and got


def test_acceptance_of_odd_rows():
    """Two rows of a minute, a missing repeat time, nothing but early hits, no window and evidence that ran out unseen while bars were missing."""
    hit = lambda i, side="long", repeat=0: (i, f"t{i}", side, repeat)
    run = lambda rows, *how: [x[:3] + x[4:6] for x in ru.acceptance(rows, *how, 300)]
    assert run([(600, True, [hit(0, repeat=None)]), (600, True, [hit(0)])], "or", None, None, None, 1) == [(600, "sent", "long", 1, ""), (600, "repeat", "long", 1, "feed cooldown")]
    early = [(600, True, [hit(0, repeat=600)]), (606, True, [hit(0, repeat=600)]), (610, True, [hit(0, repeat=600)])]
    assert run(early, "or", 0, 5, 1, 1) == [(600, "sent", "long", 1, ""), (606, "repeat", "long", 1, "trigger repeat"), (610, "sent", "long", 1, "")]
    pair = [(600, True, [hit(0)]), (605, None, [hit(1)]), (606, True, ()), (607, True, ())]
    assert run(pair, "and", 600, 5, 2, 2) == [(600, "waiting", "long", 1, "combination"), (605, "blocked", "long", 2, "screen")]
    assert run([(600, True, [hit(0)]), (620, True, [hit(1)])], "and", 0, 5, 2, 2) == [(600, "waiting", "long", 1, "combination"), (620, "waiting", "long", 1, "combination")]
    assert run([(600, False, [hit(0)]), (601, True, ())], "atleast", 0, None, 1, 1) == [(600, "blocked", "long", 1, "screen")]

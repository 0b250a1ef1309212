"""Corpus operators against plain models and on awkward rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from barwright.llm import decontam, language_id, lm_score, near_dedup, packing, quality, substring_dedup, toxicity, url_filter, warc
from barwright.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def vocabulary(seed, n=400):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]


def awkward():
    """Copies, near copies, shared and repeated passages, short, empty, null and very long texts."""
    r, words = random.Random(5), vocabulary(1)
    text = lambda n: [r.choice(words) for _ in range(n)]
    base, shared = text(120), text(30)
    rows = [(k, " ".join(base)) for k in (7, 3, 11)]
    for k in range(20, 60):
        own = list(base)
        for _ in range(r.randint(0, 7)):
            own[r.randrange(len(own))] = r.choice(words)
        rows.append((k, " ".join(own)))
    rows += [(100 + k, " ".join(text(40) + shared + text(40))) for k in range(8)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "One two"), (204, "one TWO"), (205, "ä ö ü ß é"), (206, " ".join(base[:40] * 6)), (207, " ".join(text(20_000))), (208, "x" * 300_000)]
    rows += [(210, " ".join(base[:19])), (211, " ".join(base[:20])), (3, " ".join(base))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None if d == 205 else "en", None if d == 203 else f"s{d % 3}", len(t or "")) for d, t in rows], DOCS).repartition(5)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_substring_dedup_equals_plain_model(spark):
    out = substring_dedup.repeats_removed(frame(spark, awkward()).select("doc_id", "text")).select("doc", "n_words", "n_removed", "kept")
    assert collected(out) == sorted(brute.substring_dedup(awkward()), key=repr)


def test_substring_dedup_keeps_columns_and_rows(spark):
    docs = frame(spark, awkward()).withColumn("rest", F.lit(1)).withColumn("kept", F.lit("k"))
    out = substring_dedup.remove_passages(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("doc_id = 11").first()["text"] == "" and out.where("doc_id = 203").first()["text"] == "One two"


def test_near_groups_equal_plain_model(spark):
    assert collected(near_dedup.near_groups(frame(spark, awkward()))) == sorted(brute.near_dedup(awkward()), key=repr)


def test_near_groups_of_a_chain_around_the_threshold(spark):
    """Documents that shift word by word: neighbours are linked, the ends are far apart; blocks of the rest are met."""
    words = vocabulary(3, 900)
    rows = [(k, " ".join(words[4 * k:4 * k + 60])) for k in range(200)]
    near_dedup.BLOCK, block = 16, near_dedup.BLOCK
    try:
        got = collected(near_dedup.near_groups(frame(spark, rows)))
    finally:
        near_dedup.BLOCK = block
    assert got == sorted(brute.near_dedup(rows), key=repr)


def test_posterior_bounds_grow_and_keep_similar_pairs():
    least = near_dedup.least_matches(0.75)
    assert least == sorted(least) and least[-1] < 0.75 * near_dedup.HASHES


def test_near_dedup_keeps_one_of_each_group(spark):
    out = near_dedup.near_dedup(frame(spark, awkward()).withColumn("comp", F.lit(0)))
    ids = [r["doc_id"] for r in out.collect()]
    want = {r[0] for r in brute.near_dedup(awkward()) if r[3]}
    assert sorted(ids) == sorted(want) and "comp" in out.columns


def test_a_repeated_id_does_not_take_its_group_along(spark):
    """Id 2 bears two texts: the one keeps a group of its own, the other is a copy of a smaller id's."""
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a), (2, a), (2, b), (3, b)]
    kept = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["text"] for r in kept} == {a, b} and 3 not in {r["doc_id"] for r in kept}


def test_capitals_are_counted_over_the_whole_text():
    for t in ("", "Ab", "aB" * 5000, "\u0130stanbul \u03a3\u0391\u03a3 xY", "\u00c9t\u00e9 " * 2000):
        assert toxicity.capitals(t, t.lower()) == sum(c != c.lower() for c in t)


def test_texts_that_differ_in_outer_blanks_are_one_cluster(spark):
    docs = spark.createDataFrame([(k, t, f"s{k}") for k, t in enumerate([" one two", "one two\n", "ONE  two", "one\ttwo "])], "doc_id bigint, text string, source string")
    bins = packing.pack(docs, capacity=100).collect()
    assert len({(r["shard"], r["bin"]) for r in bins}) == 4


def test_quality_counts_equal_plain_model():
    texts = [t for _, t in awkward()] + ["a b\na b\n\na b \n", "\n\n", "#*$ <x> | %", "one " * 9, "A\x0bB\x0cC\r\nA\x0bB"]
    got = list(zip(*[c.tolist() for c in quality.counts(pa.array(texts, pa.string()))[:5]]))
    assert got == [brute.quality_counts(t) for t in texts]


def test_quality_rules_follow_the_data(spark):
    r, words = random.Random(2), vocabulary(2)
    rows = [(k, " ".join(r.choice(words) for _ in range(60)), "en", "s") for k in range(300)]
    rows += [(1000 + k, " ".join(r.choice(words) + "$$$" for _ in range(60)), "en", "s") for k in range(30)] + [(2000, None, None, None), (2001, "few words", "en", "s")]
    out, _, v = quality.quality_verdicts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    kept = {x["doc_id"] for x in out.where(f"{v}.kept").collect()}
    assert kept == set(range(300)) and out.count() == len(rows)


def test_quality_cuts_differ_between_groups_with_different_levels(spark):
    """A fifth of source m carries markup as a matter of course, source j is junk in most of its rows; the same texts elsewhere are judged by their own source."""
    r, words = random.Random(5), vocabulary(5)
    plain = lambda: " ".join(r.choice(words) for _ in range(40))
    marked = lambda n: plain() + " " + "<> " * n
    lines = lambda n: "\n".join([plain()] + [f"short line {k % (10 - n)}" for k in range(9)])
    rows = [(k, plain(), "en", "p") for k in range(600)] + [(600, marked(4), "en", "p")]
    rows += [(1000 + k, marked(4) if k % 5 == 0 else plain(), "en", "m") for k in range(300)]
    rows += [(2000 + k, marked(60) if k % 10 else plain(), "en", "j") for k in range(150)]
    rows += [(3000 + k, lines(k % 3 + 1) if k % 4 == 0 else plain(), "en", "d") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    cut = {x["source"]: x for x in quality.limits(quality.sketches(quality.measure(docs, into="q"), "q")).where("level = 0").collect()}
    assert cut["p"]["symbols"] < cut["m"]["symbols"] < cut["j"]["symbols"] and cut["p"]["dup_lines"] < cut["d"]["dup_lines"]
    out, _, v = quality.quality_verdicts(docs)
    kept = {x["doc_id"] for x in out.where(f"{v}.kept").collect()}
    assert 600 not in kept and {1000 + k for k in range(300)} <= kept
    assert kept & set(range(2000, 2150)) == {2000 + k for k in range(0, 150, 10)}


def test_quality_thresholds_are_quantiles(spark):
    rows = [(k, "a" * (k % 10) + "B" * (10 - k % 10) + " x" * 25, "en", "s") for k in range(500)]
    measured = quality.measure(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), into="q")
    cut = quality.limits(quality.sketches(measured, "q")).where("level = 0").first()
    share = sorted((10 - k % 10) / 35 for k in range(500))
    mid, low = share[249], share[49]
    assert abs(cut["capitals"] - (mid + 8 * (mid - low) + 0.1)) < 0.05


def test_url_filter_handles_odd_urls_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.org/es/x?q"), (5, "https://a.b.com/fr/1#t"), (6, "ftp://www.bad.net/p.html"), (7, "http://bad.net/p/"), (8, "http://x.net"), (8, "http://x.net"),
            (9, "a://b://c/d"), (10, "http://example.org/en/12"), (11, "http://notexample.org/es/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("old")).withColumn("_bits", F.lit(0))
    out = url_filter.filter_urls(pages, spark.createDataFrame([("http://m.bad.net/p",), (None,)], "url string"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert out.count() == len(rows) and got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("example.org", "/es/x", "example.org/es/", "block") and got[5][2:] == ("com/fr/", "allow")
    assert got[6][3] == got[7][3] == "block" and got[8][3] == "allow" and got[9][:2] == ("b:", "//c/d")
    assert got[10][2:] == ("example.org/en/1", "block") and got[11][2:] == ("org/", "allow")
    assert url_filter.filter_urls(pages.limit(0), pages.select("url").limit(0)).count() == 0


def test_url_filter_false_positives_are_removed(spark):
    """With two bits per URL most probes are possible hits; the exact join leaves the listed ones."""
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://h', id % 50, '.net/p', id) as url")
    out = url_filter.filter_urls(pages, pages.where("page_id % 3 = 0").select("url"), rules=(("none", "/", "allow"),), bits_per_url=2)
    assert out.where("(page_id % 3 = 0) <> (verdict = 'block')").count() == 0


def test_warc_round_trip(spark):
    rows = [(k, f"http://h/{k}\r\nX: 1" if k == 5 else f"http://h/{k}", f"<p>{'text é ' * (k % 7)}</p>") for k in range(300)] + [(900, None, None), (901, "u", ""), (902, "u", "z" * 200_000), (5, "http://h/5", f"<p>{'text é ' * 5}</p>")]
    path = warc.write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4))
    got = sorted(tuple(r) for r in warc.read_archive(spark, path).drop("payload", "url").collect())
    first = {}
    for p, _, h in rows:
        first[h or ""] = min(first.get(h or "", p), p)
    want = sorted((p, len((h or "").encode()), warc.digest((h or "").encode()), "response" if first[h or ""] == p else "revisit", None if first[h or ""] == p else first[h or ""]) for p, _, h in rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archive(spark, path).where("record_type = 'response'").collect()}
    assert all(payloads[p] == (h or "") for p, _, h in rows if p in payloads)
    assert warc.read_archive(spark, warc.write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"))).count() == 0


def test_warc_file_starts_with_its_dictionary(spark, tmp_path):
    path = warc.write_archive(spark.createDataFrame([(k, f"http://h/{k}", "<p>" + "same words over and over %d " % k * 40) for k in range(200)], "page_id bigint, url string, html string").coalesce(1), str(tmp_path / "w"))
    data = next((tmp_path / "w").glob("part-*")).read_bytes()
    magics = [m for m, _, _ in warc.frames(data)]
    assert magics[0] == warc.DICTIONARY_FRAME and magics.count(warc.FRAME) == 200 and path


def packed_ok(rows, docs, capacity=packing.CAPACITY, per_source=packing.PER_SOURCE):
    bins, seen = {}, {}
    for r in rows:
        seen.setdefault(r["doc_id"], []).append(r)
        if r["bin"] is not None:
            bins.setdefault((r["shard"], r["bin"]), []).append(r)
    for b in bins.values():
        b.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in b:
            assert r["bin_offset"] == at
            at += r["n_words"]
        assert at <= capacity
        sources = [docs[r["doc_id"]][1] for r in b if docs[r["doc_id"]][1] is not None]
        assert all(sources.count(s) <= per_source for s in sources)
        texts = [brute.WORD.findall(brute.lower(docs[r["doc_id"]][0])) for r in b]
        assert len({tuple(t) for t in texts}) == len(texts)
    return seen, bins


def test_packing_respects_capacity_and_conflicts(spark):
    rows = [r for r in awkward() if r[0] != 3] + [(3, awkward()[1][1])]
    docs = frame(spark, rows)
    out = packing.pack(docs, capacity=256).collect()
    seen, bins = packed_ok(out, {r["doc_id"]: (r["text"] or "", r["source"]) for r in docs.collect()}, 256)
    for d, t in rows:
        assert sum(r["n_words"] for r in seen[d]) == len(brute.WORD.findall(t or ""))
    assert packing.pack(docs.limit(0)).count() == 0 and packing.pack(docs.unionByName(docs), capacity=256).count() == 2 * len(out)


def test_packing_takes_the_tightest_compatible_bin():
    bins = packing.Bins(10, 1)
    assert [bins.put(7, 1, 0)[0], bins.put(6, 2, 0)[0], bins.put(3, 1, 0)[0], bins.put(3, 2, 0)[0], bins.put(1, 4, 0)[0]] == [0, 1, 1, 0, 1]
    assert bins.tightest(1, 0, 0) is None


def test_decontamination_finds_edited_items(spark):
    r, words = random.Random(9), vocabulary(4, 3000)
    text = lambda n: [r.choice(words) for _ in range(n)]
    items = [(k, text(r.randint(15, 60))) for k in range(30)]
    docs, want = [], set()
    for d in range(300):
        own = text(r.randint(5, 200))
        if d % 2:
            k, item = items[r.randrange(30)]
            item = list(item)
            for _ in range(int(0.1 * len(item))):
                item[r.randrange(len(item))] = r.choice(words)
            own[len(own) // 2:len(own) // 2] = item
            want.add((d, k))
        docs.append((d, " ".join(own).upper() if d % 5 == 0 else " ".join(own)))
    docs += [(900, None), (901, ""), (902, " ".join(items[0][1])), (902, " ".join(items[0][1])), (903, " ".join(text(30_000) + items[1][1]))]
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items] + [(50, None), (51, ""), (52, "two words"), (53, " ".join(items[2][1]))], "item_id bigint, text string")
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {(x["doc_id"], x["item_id"]) for x in decontam.find_items(table, bench).collect()}
    assert len(want & got) >= 0.95 * len(want) and {(902, 0), (903, 1)} <= got
    assert {x for x in got if x[1] != 53} - want <= {(902, 0), (903, 1)}
    assert decontam.find_items(table, bench.limit(0)).count() == 0
    assert decontam.decontaminate(table.withColumn("_hit", F.lit(1)), bench).columns == [*table.columns, "_hit"]
    left = {x["doc_id"] for x in decontam.decontaminate(table, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in got}


@pytest.mark.parametrize("m", [4, 5, 6, 8, 10, 11, 12, 13, 15, 17, 20, 23, 27, 34, 45, 60, 130])
def test_decontamination_recall_at_the_tolerance(m):
    """Items of m words with floor(0.2 * m) replaced, inserted and deleted words."""
    r, n = random.Random(m), 150
    text = lambda k: ["".join(r.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(k)]
    items, docs = [text(m) for _ in range(n)], []
    for item in items:
        own = list(item)
        for _ in range(int(decontam.TOLERANCE * m)):
            at, kind = r.randrange(len(own)), r.randrange(3)
            own[at:at + (kind != 1)] = text(1) if kind < 2 else []
        docs.append(" ".join(text(r.randint(5, 40)) + own + text(20)))
    held = decontam.index(list(range(n)), [" ".join(t) for t in items])
    got = {(row, item) for row, item, *_ in decontam.found_in(pa.array(docs), held, decontam.TOLERANCE)}
    assert sum((k, k) in got for k in range(n)) > 0.95 * n


def test_null_ids_and_untyped_columns(spark):
    """Null ids, and tables whose text, language and source are all null or empty."""
    text = " ".join(vocabulary(11, 60))
    rows = [(None, text, "en", "s"), (None, text, "en", "s"), (2**60 + 1, text, None, None), (2**60, "x " + text, None, "s"), (5, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert sorted((r["doc_id"], r["kept"]) for r in near_dedup.near_groups(docs).collect()) == [(5, True), (2**60, True), (2**60 + 1, False)]
    assert near_dedup.near_dedup(docs).where("doc_id is not null").count() == 2
    out = {(r["doc"], r["n_removed"]) for r in substring_dedup.repeats_removed(docs).collect()}
    assert out == {(None, 60), (2**60, 0), (2**60 + 1, 60), (5, 0)}
    assert {r["doc_id"] for r in packing.pack(docs).collect()} == {None, 2**60, 2**60 + 1, 5} and packing.pack(docs).count() == 5
    bench = spark.createDataFrame([(1, " ".join(text.split()[10:40]))], "item_id bigint, text string")
    assert decontam.find_items(docs, bench).count() == 4 and [r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()] == [5]
    assert quality.quality_filter(docs).count() == 4
    model = language_id.train(docs.where(~language_id.held_out("doc_id")))
    assert language_id.predict(docs, model).count() == lm_scores_count(docs) == 5
    blank = docs.withColumn("text", F.lit(None)).withColumn("lang", F.lit(None)).withColumn("source", F.lit(None))
    assert quality.quality_filter(blank).count() == 0 and packing.pack(blank).where("bin is null").count() == 5
    assert decontam.decontaminate(blank, bench).count() == 5 and substring_dedup.remove_passages(blank).count() == 5
    assert lm_scores_count(blank) == 5 and language_id.predict(blank, model).where("lang_pred = 'und'").count() == 5


def lm_scores_count(docs):
    return lm_score.lm_scores(docs, language_id.held_out("doc_id", 10, 0)).count()


def test_edit_distance_is_that_of_the_best_stretch():
    a = np.array([1, 2, 3, 4, 5], np.uint64)
    for stretch, want in (([9, 9, 1, 2, 3, 4, 5, 9], (0, 7)), ([1, 2, 7, 4, 5], (1, 5)), ([1, 2, 4, 5], (1, 4)), ([1, 2, 3, 3, 4, 5], (1, 6)), ([], (5, 0))):
        assert decontam.edit_distance(a, np.array(stretch, np.uint64)) == want


def test_language_of_known_and_unknown_words(spark):
    r = random.Random(3)
    make = {"aa": lambda: "".join(r.choice("abcde") for _ in range(5)), "bb": lambda: "".join(r.choice("vwxyz") for _ in range(5)), "cc": lambda: "".join(r.choice("klmno") for _ in range(5))}
    rows = [(k, " ".join(make[g]() for _ in range(30)), g) for k in range(150) for g in [list(make)[k % 3]]]
    labelled = spark.createDataFrame(rows + [(500, "abcde", None), (501, None, "aa")], "doc_id bigint, text string, lang string")
    model = language_id.train(labelled)
    asked = spark.createDataFrame([(1, "edcba", 0), (2, "zyxwv zz", 0), (3, "klmno!", 0), (4, None, 0), (5, "12 34 --", 0), (6, "ABCDE " * 5000, 0), (6, "ABCDE " * 5000, 0)], "doc_id bigint, text string, score int")
    got = [(x["doc_id"], x["lang_pred"], x["score"]) for x in language_id.predict(asked, model).collect()]
    assert [g[1] for g in sorted(got)] == ["aa", "bb", "cc", "und", "und", "aa", "aa"] and all(0 <= g[2] <= 1 for g in got)
    assert language_id.predict(asked, language_id.train(labelled.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_language_id_is_accurate_on_held_out_rows(spark):
    got = QUERIES["op6_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and n_chars > 100").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_toxicity_learns_words_and_beginnings(spark):
    r, words = random.Random(4), vocabulary(6)
    rows, labels = [], []
    for k in range(600):
        own = [r.choice(words) for _ in range(40)]
        toxic = k % 6 == 0
        if toxic:
            own[3:3] = [r.choice(("vile", "rotten", "grimble" + r.choice("abc")))for _ in range(3)]
        rows.append((k, " ".join(own)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "VILE!!"), (903, "grimblez " * 3 + " ".join(words[:30]))], "doc_id bigint, text string")
    table = spark.createDataFrame(labels + [(77, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs.where("doc_id % 4 <> 2"), table.where("doc_id % 4 <> 2"))
    got = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    held = [k for k in range(600) if k % 4 == 2]
    assert np.mean([got[k]["predicted"] == int(k % 6 == 0) for k in held]) >= 0.97
    assert got[903]["predicted"] == 1 and got[900]["predicted"] == got[901]["predicted"] == 0 and all(0 <= x["score"] <= 1 for x in got.values())
    plain = toxicity.train(docs, table.limit(0))
    assert {round(x["score"], 6) for x in toxicity.score(docs, plain).collect()} == {0.5}


def test_label_model_recovers_accuracies():
    r = np.random.default_rng(0)
    y = (r.random(4000) < 0.2).astype(int)
    rates = np.array([[0.02, 0.7], [0.05, 0.6], [0.01, 0.5], [0.1, 0.4]])
    votes = r.random((4000, 4)) < rates[:, 0] + (rates[:, 1] - rates[:, 0]) * y[:, None]
    post, fires = toxicity.label_model(votes, np.where(np.arange(4000) < 800, y, -1))
    assert np.mean((post > 0.5) == y) > 0.93 and np.abs(fires.T - rates).max() < 0.1


@pytest.mark.parametrize("known", [1 << 20, 30])
def test_word_model_equals_plain_model(spark, monkeypatch, known):
    monkeypatch.setattr(lm_score.frequent, "__defaults__", (known,))
    rows = awkward()[3:]
    rows = [x for x in rows if x[0] not in (207, 208)]
    out = lm_score.lm_scores(frame(spark, rows), F.col("doc_id") % 3 == 0).collect()
    want = brute.word_model(rows, lambda d: d % 3 != 0)
    for r in out:
        tokens, seen, n, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, seen, n) and r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0
    assert len(out) == len(rows)


def test_bit_model_is_a_distribution_and_learns():
    words = vocabulary(8, 50)
    r = random.Random(1)
    texts = [" ".join(r.choice(words) for _ in range(80)) for _ in range(60)]
    sample = pa.array(texts[:40])
    counts = np.ones(256, np.int64)
    for data, *_ in lm_score.texts_of(sample):
        counts += np.bincount(data, minlength=256)
    code = lm_score.huffman(counts)
    n = np.zeros((2, lm_score.CONTEXTS << lm_score.SLOT_BITS), np.int64)
    for part in lm_score.count_bits(iter([pa.RecordBatch.from_arrays([sample], names=["t"])]), code):
        n[0][part[0].to_numpy()] += part[1].to_numpy()
        n[1][part[0].to_numpy()] += part[2].to_numpy()
    model = lm_score.fit_gates(code, n[0].reshape(lm_score.CONTEXTS, -1), n[1].reshape(lm_score.CONTEXTS, -1), sample)
    bits = model.bits_of(pa.array(texts[40:]))
    assert bits.sum() / sum(map(len, texts[40:])) < 2.2  # eight for plain bytes, about 4 for the code
    # the probabilities of all one-byte continuations of a text add up to one
    total = sum(2.0 ** -b for b in model.bits_of(pa.array(["the" + chr(c) for c in range(1, 128)])))
    stop = 2.0 ** -model.bits_of(pa.array(["the"]))[0]
    assert 0 < total + stop <= 1.0
    whole = " ".join(texts)
    assert model.bits_of(pa.array([whole * 40]))[0] > model.bits_of(pa.array([whole]))[0]


def test_lm_scores_without_rows(spark):
    assert lm_score.lm_scores(frame(spark, awkward()).limit(0), F.lit(False)).count() == 0


def test_pipeline_equals_its_stages_on_plain_models(spark):
    import corpus_pipeline
    docs, names = spark.read.parquet(f"{SF}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "repeated_passages", "benchmark_leaks", "packed_bins"]
    columns = docs.columns
    bench = [(r["item_id"], brute.WORD.findall(brute.lower(r["text"]))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SF)
        if name != "packed_bins":
            assert out.columns == columns
        rows, ids = out.collect(), {r["doc_id"] for r in before}
        kept = {r["doc_id"] for r in rows}
        texts = [(r["doc_id"], r["text"]) for r in before]
        if name == "near_duplicates":
            assert kept == {r[0] for r in brute.near_dedup(texts) if r[3]}
        if name == "repeated_passages":
            want = {d: (n, h) for d, _, n, h in brute.substring_dedup(texts)}
            assert kept == ids
            for r in rows:
                assert hashlib.sha256(" ".join(brute.WORD.findall(r["text"] or "")).encode()).hexdigest() == want[r["doc_id"]][1]
        if name == "benchmark_leaks":
            joined = {d: " " + " ".join(brute.WORD.findall(brute.lower(t or ""))) + " " for d, t in texts}
            assert not any(" " + " ".join(w) + " " in joined[d] for d in kept for _, w in bench)
        if name == "packed_bins":
            seen, _ = packed_ok(rows, {r["doc_id"]: (r["text"] or "", r["source"]) for r in before})
            assert set(seen) == ids
        docs = spark.createDataFrame(rows, out.schema) if name != "packed_bins" else None


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


def test_gates_are_fitted_on_every_training_document(spark):
    """Each document has a letter of its own, so the branches towards it are met in that document alone."""
    rows = [(i, ("the same words " + chr(0x400 + i) * 30 + " ") * 4) for i in range(60)]
    model = lm_score.train(frame(spark, rows).select("doc_id", "text"), rows=10)
    code = model.code
    for b in range(0x80, 0x80 + 60):
        last = code.nodes[code.start[b] + code.size[b] - 1]
        assert (model.by_node[last] != np.float32(0.35)).any(), b
    again = lm_score.train(frame(spark, rows[::-1]).select("doc_id", "text").repartition(7), rows=10)
    assert np.allclose(model.by_node, again.by_node, atol=1e-6) and np.allclose(model.refined, again.refined, atol=1e-6)


def test_gates_do_not_depend_on_what_is_grouped(spark):
    r = random.Random(4)
    words = vocabulary(8, 60)
    rows = [(i, None if i == 5 else " ".join(r.choice(words) for _ in range(30 + i))) for i in range(40)]
    one, many = (lm_score.train(frame(spark, rows).select("doc_id", "text").repartition(p), rows=n) for p, n in ((1, 40), (5, 3)))
    for a, b in ((one.packed, many.packed), (one.by_node, many.by_node), (one.by_seen, many.by_seen), (one.refined, many.refined)):
        assert np.array_equal(a, b)


def test_evidence_counts_every_bit_without_itself():
    r = random.Random(5)
    words = vocabulary(8, 40)
    texts = pa.array([" ".join(r.choice(words) for _ in range(n)) for n in (40, 1, 90)] + [None, "", "x" * 70000])
    counts = np.ones(256, np.int64)
    for data, *_ in lm_score.texts_of(texts):
        counts += np.bincount(data, minlength=256)
    code, batch = lm_score.huffman(counts), pa.record_batch([texts], names=["text"])
    n = np.zeros((2, lm_score.CONTEXTS << lm_score.SLOT_BITS), np.int64)
    for part in lm_score.count_bits(iter([batch]), code):
        n[:, part.column(0).to_numpy()] = [part.column(1).to_numpy(), part.column(2).to_numpy()]
    n = n.reshape(2, lm_score.CONTEXTS, -1)
    evidence, want = lm_score.Evidence(*n), {}
    base = np.cumsum([0, *[len(c) + 1 for c in evidence.CUTS]])
    for data, _, place, skip in lm_score.texts_of(texts):
        _, at, slots = lm_score.bit_events(code, data, place, skip)
        for j, i in enumerate(at):
            cell, y = int(code.nodes[i]), int(code.bits[i])
            for k, s in enumerate(slots):
                a, b = n[0, k, s[j]] - (y == 0), n[1, k, s[j]] - (y == 1)
                step = 0 if a + b < 1 else 1 if a + b < 4 else 2 if a + b < 24 else 3
                cell = cell * lm_score.LEVELS + base[step] + sum(np.log((b + 0.3) / (a + 0.3)) > c for c in evidence.CUTS[step])
            want[cell * 2 + y] = want.get(cell * 2 + y, 0) + 1
    found = {c: m for part in lm_score.count_evidence(iter([batch]), code, evidence) for c, m in zip(part.column(0).to_pylist(), part.column(1).to_pylist())}
    assert found == want

"""Operators without SQL against models written plainly from their rules: all pairs of edit distances, word backoff, best fit bin by bin, bits one by one."""
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from barwright.llm import decontam, language_id, lm_score, packing


def made(seed, n=300, letters="abcdefghijklmnop"):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(n)]


def edited(r, words, edits, vocabulary):
    out = list(words)
    for _ in range(edits):
        at, way = r.randrange(len(out)), r.randrange(3)
        if way == 0:
            out[at] = r.choice(vocabulary)
        elif way == 1:
            out.insert(at, r.choice(vocabulary))
        elif len(out) > 1:
            del out[at]
    return out


def least_edits(item, words):
    """Word edits between the item and its best stretch of the words, cell by cell."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_leaks_equal_all_pairs_of_edit_distances(spark):
    r, vocabulary = random.Random(8), made(2)
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, text(r.choice([4, 7, 11, 15, 20, 33, 60]))) for k in range(30)]
    docs = [(k, text(r.randint(0, 90))) for k in range(40)]
    for k in range(40, 160):
        words = r.choice(items)[1]
        docs.append((k, text(r.randint(0, 40)) + edited(r, words, r.randint(0, int(0.3 * len(words)) + 1), vocabulary) + text(r.randint(0, 40))))
    docs += [(160, []), (161, items[3][1]), (162, items[4][1][1:])]
    long_item = (99, text(420))
    items.append(long_item)
    # an item over 300 words whose beginning is lost: more words than the largest window reaches
    docs.append((163, long_item[1][70:] + text(20)))
    expected = {}
    for d, words in docs:
        for i, item in items:
            edits = least_edits(item, words)
            if edits <= int(0.2 * len(item)):
                expected[d, i] = edits
    d = spark.createDataFrame([(k, " ".join(w).upper() if k % 2 else " ".join(w)) for k, w in docs] + [(200, None)], "doc_id bigint, text string").coalesce(2)
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(100, None), (101, ""), (102, "one two three")], "item_id bigint, text string")
    rows = decontam.find_items(d, b).collect()
    found = {(x["doc_id"], x["item_id"]): x["edits"] for x in rows}
    assert len(found) == len(rows) and set(found) <= set(expected)
    assert all(expected[k] <= found[k] <= int(0.2 * len(dict(items)[k[1]])) for k in found)
    assert {k for k, edits in expected.items() if edits == 0} <= set(found)
    assert len(found) >= 0.95 * len(expected) and len(expected) > 60
    assert (163, 99) in found and {k for k in expected if k[0] in (161, 162)} <= set(found)
    kept = {x["doc_id"] for x in decontam.decontaminate(d, b).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _ in found} | {200}


def plain_language(rows):
    """A function text -> (language, score), from (lang, text) rows, by the rule of the docstring."""
    counts = {}
    for lang, text in rows:
        for word in language_id.letters(text):
            features = [(0, word)] + [(n, f"<{word}>"[i:i + n]) for n in range(2, 6) for i in range(len(word) + 3 - n)] + [(1, c) for c in word]
            for feature in features:
                counts.setdefault(feature, Counter())[lang] += 1
    langs = sorted({lang for lang, _ in rows})
    known = {f: c for f, c in counts.items() if f[0] == 1 or sum(c.values()) >= 2}
    sizes = Counter(f[0] for f in known)
    totals = Counter()
    for (n, _), c in known.items():
        for lang in langs:
            totals[n, lang] += c[lang]

    def value(feature):
        logs = [math.log((known[feature][lang] + 0.5) / (totals[feature[0], lang] + 0.5 * sizes[feature[0]])) for lang in langs]
        return [x - sum(logs) / len(logs) for x in logs]

    def of_word(word):
        if (0, word) in known:
            return value((0, word))
        for n in range(5, 0, -1):
            parts = list(word) if n == 1 else [f"<{word}>"[i:i + n] for i in range(len(word) + 3 - n)]
            parts = [value((n, p)) for p in parts if (n, p) in known]
            if parts:
                return [sum(c) / len(parts) for c in zip(*parts)]
        return [0.0] * len(langs)

    def of_text(text):
        words = language_id.letters(text)
        if not words:
            return "und", 0.0
        total = [sum(c) for c in zip(*(of_word(w) for w in words))]
        best = max(range(len(langs)), key=lambda k: (total[k], -k))
        return langs[best], 1 / sum(math.exp(max(x - total[best], -700)) for x in total)

    return of_text


def test_language_equals_plain_backoff(spark):
    r = random.Random(4)
    spoken = {"aa": made(11, 60, "abcdefgh"), "bb": made(12, 60, "efghijkl"), "cc": made(13, 60, "abcdijklü")}
    learned = [(k, lang, " ".join(r.choice(spoken[lang]) for _ in range(r.randint(1, 12)))) for k, lang in enumerate(r.choice(sorted(spoken)) for _ in range(80))]
    fresh = made(14, 60, "abcdefghijklmnü")
    asked = [(k, " ".join(r.choice(spoken[r.choice(sorted(spoken))] + fresh) for _ in range(r.randint(1, 6)))) for k in range(120)]
    asked += [(200, None), (201, ""), (202, "12 + 3"), (203, "ß"), (204, "ABC" * 50), (205, "abc " * 5000)]
    model = language_id.train(spark.createDataFrame([*learned, (900, None, "abc")], "doc_id bigint, lang string, text string"))
    plain = plain_language([(lang, text) for _, lang, text in learned])
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.predict(spark.createDataFrame(asked, "doc_id bigint, text string"), model).collect()}
    assert set(got) == {k for k, _ in asked}
    for k, text in asked:
        lang, score = plain(text)
        assert got[k][1] == pytest.approx(score, rel=1e-2, abs=1e-6)
        assert got[k][0] == lang or score < 0.501


def plain_bins(pieces, capacity, per_source):
    """(bin, offset) per piece (n_words, source, cluster), every open bin tried; of bins with equal room the one that has had it longest."""
    bins, out = [], []
    for time, (size, source, cluster) in enumerate(pieces):
        free = [(b["room"], b["since"], k) for k, b in enumerate(bins)
                if b["room"] >= size and (source is None or b["sources"][source] < per_source) and (cluster is None or cluster not in b["clusters"])]
        if free:
            k = min(free)[2]
        else:
            k = len(bins)
            bins.append({"room": capacity, "since": time, "sources": Counter(), "clusters": set()})
        out.append((k, capacity - bins[k]["room"]))
        bins[k]["room"] -= size
        bins[k]["since"] = time
        bins[k]["sources"][source] += 1
        bins[k]["clusters"].add(cluster)
    return out


@pytest.mark.parametrize("per_source", [1, 2, 3])
def test_packing_equals_plain_best_fit(per_source):
    r = random.Random(per_source)
    rows = [(f"{k:04}", 0, 1, 0, r.randint(1, 100), r.choice([None, "a", "a", "a", "b", "c", f"s{k}"]), r.choice([None, "x", f"c{k % 40}", f"c{k}"]), 0) for k in range(400)]
    rows.sort(key=lambda x: (-x[4], x[0]))
    frame = pd.DataFrame(rows, columns=["doc_id", "piece", "copy", "first_word", "n_words", "source", "cluster", "shard"])
    got = packing.pack_shard(frame.sample(frac=1, random_state=1), 100, per_source).sort_values("doc_id")
    expected = dict(zip((x[0] for x in rows), plain_bins([x[4:7] for x in rows], 100, per_source)))
    assert [tuple(x) for x in got[["bin", "bin_offset"]].to_numpy().tolist()] == [expected[d] for d in got["doc_id"]]


def plain_bits(model, text):
    """Code length of one text, bit by bit, in doubles."""
    data = np.frombuffer((text or "").encode() + b"\0", np.uint8)
    places = np.arange(len(data))
    before = [lm_score.slot_of(h) for h in lm_score.contexts(data, places)]
    weights = [0.0] * lm_score.CONTEXTS
    total, sums, n, part = 0.0, [0.0] * lm_score.CONTEXTS, 0, 0
    for i, byte in enumerate(data):
        now = max(0, math.ceil(math.log2(i // lm_score.SEGMENT + 1))) if i >= lm_score.SEGMENT else 0
        if now != part:
            weights = [w + model.rate / 4 * s / (n + 256) for w, s in zip(weights, sums)]
            sums, n, part = [0.0] * lm_score.CONTEXTS, 0, now
        for at in range(model.code.start[byte], model.code.start[byte] + model.code.size[byte]):
            cells = [int(model.packed[k][before[k][i] ^ model.code.salt[at]]) for k in range(lm_score.CONTEXTS)]
            node, seen = int(model.code.nodes[at]), 0
            for c in cells:
                seen = seen * 4 + (c & 3)
            x = [(c >> 2) / 64 for c in cells]
            mixed = sum((float(model.by_node[node, k]) + float(model.by_seen[seen, k]) + weights[k]) * x[k] for k in range(lm_score.CONTEXTS))
            cell = int(np.rint(min(16, max(-16, mixed * 2)))) + 16
            y = 1 if model.code.bits[at] else -1
            z = min(14, max(-14, y * (mixed + float(model.refined[node * 33 + cell]))))
            total += math.log2(1 + math.exp(-z))
            miss = y / (1 + math.exp(z))
            sums = [s + miss * v for s, v in zip(sums, x)]
            n += 1
    return total


def test_mixed_bits_equal_a_bit_by_bit_model():
    r, vocabulary = random.Random(6), made(3, 150)
    texts = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (60, 3, 400, 90, 700, 1, 250)]
    learned = pa.array(texts[:5])
    counts = np.ones(256, np.int64)
    for data, *_ in lm_score.texts_of(learned):
        counts += np.bincount(data, minlength=256)
    code = lm_score.huffman(counts)
    n = np.zeros((2, lm_score.CONTEXTS << lm_score.SLOT_BITS), np.int64)
    for batch in lm_score.count_bits(iter([pa.record_batch([learned], names=["text"])]), code):
        n[:, batch.column(0).to_numpy()] = [batch.column(1).to_numpy(), batch.column(2).to_numpy()]
    assert n.sum() == lm_score.CONTEXTS * sum(int(code.size[b]) for t in texts[:5] for b in t.encode() + b"\0")
    model = lm_score.fit_gates(code, n[0].reshape(lm_score.CONTEXTS, -1), n[1].reshape(lm_score.CONTEXTS, -1), learned)
    asked = texts + [None, "", "ä ö ü", "x" * 3000, *texts[2:4]]
    got = model.bits_of(pa.array(asked, pa.string()))
    assert got == pytest.approx([plain_bits(model, t) for t in asked], rel=2e-3)
    # a text's length does not depend on its neighbours
    assert got == pytest.approx([model.bits_of(pa.array([t], pa.string()))[0] for t in asked], rel=1e-6)

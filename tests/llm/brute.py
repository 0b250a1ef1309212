"""Plain models of the corpus operators, for small inputs."""
import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def substring_dedup(rows, size=20):
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        for i in range(len(w) - size + 1):
            k = tuple(w[i:i + size])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] < (d, i):
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def quality_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    n = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    repeated = {i + j for i in range(len(w) - 7) if n[tuple(w[i:i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def near_dedup(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= 75 * large and 100 * (n := len(sets[a] & sets[b])) >= 75 * (small + large - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d, _ in rows)


def word_model(rows, learned):
    """doc_id to (n_tokens, n_known, N, base score); ``learned(doc_id)`` tells the training rows."""
    from math import log10
    tokens = {d: [*WORD.findall(lower(t or "")), None] for d, t in rows}
    c = Counter(x for d in tokens if learned(d) for x in tokens[d])
    n = sum(c.values())
    return {d: (len(w), sum(c[x] > 0 for x in w), n, sum(log10((c[x] + 0.1) / (n + 0.1 * (len(c) + 1))) for x in w)) for d, w in tokens.items()}


def resampled(rows, target, buckets=10_000, percent=10, least=20, seed=2024, sizes=(1, 1)):
    """doc_id to (n_words, n_features, weight, score, rank)."""
    import math
    import zlib
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def feats(t):
        w = word.findall(lower(t or ""))
        return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(sizes[0], sizes[1] + 1) for i in range(len(w) - k + 1)]
    docs = [(d, *feats(t)) for d, t in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in feats(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    out = []
    for d, n, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0]))
    rank = {id(x): k + 1 for k, x in enumerate(able[:percent * len(able) // 100])}
    return sorted((*x, rank.get(id(x))) for x in out)


def simhash(text, size=3):
    import xxhash
    w = WORD.findall(lower(text or ""))
    grams = [" ".join(w[i:i + size]) for i in range(max(len(w) - size + 1, 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, values, near):
    """The smallest id of each row's component; all pairs are looked at."""
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if near(values[i], values[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, d in enumerate(ids):
        low[root(i)] = min(low.get(root(i), d), d)
    return [low[root(i)] for i in range(len(ids))]


def collocations(rows, longest=3, least=10, share=50, per_lang=2000):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    able = [p for p, a in f.items() if len(p) > 2 and a >= least]
    inside = lambda p, q: any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = []
    for p in able:
        a, w = f[p], p[1:]
        if any(len(q) > len(p) and q[0] == p[0] and 100 * f[q] >= share * a and inside(w, q[1:]) for q in able):
            continue
        cuts = [(10**6 * a * a // (f[p[:k + 1]] * f[(p[0], *w[k:])]), k, f[p[:k + 1]], f[(p[0], *w[k:])]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.append((p[0], -score, -a, " ".join(w).encode(), left, right))
    out.sort()
    seen, rows = Counter(), []
    for lang, score, a, phrase, left, right in out:
        seen[lang] += 1
        if seen[lang] <= per_lang:
            rows.append((lang, seen[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return rows

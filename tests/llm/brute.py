"""Plain versions of the operators, one text after another."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

NONE = -(1 << 63)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def order(i):
    return NONE if i is None else i


def kept_words(docs, window=13):
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < order(i):
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def kept_bytes(docs, length=200, keep_first=False):
    """Rows equal in id and text are one document."""
    places = defaultdict(set)
    for i, t in docs:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            places[raw[k : k + length]].add((order(i), raw, k))
    out = []
    for i, t in docs:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - length + 1):
            of = places[raw[k : k + length]]
            if len(of) > 1 and not (keep_first and min((p[0], p[2]) for p in of) == (order(i), k)):
                gone[k : k + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), runs, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def fingerprint(text, shingle=4):
    w = words(lower(text))
    parts = [" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def component_ids(docs, radius=4):
    prints = np.array([fingerprint(t) for _, t in docs], np.uint64)
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in np.flatnonzero(np.bitwise_count(prints[a] ^ prints) <= radius):
            root[find(a)] = find(int(b))
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, int(prints[k]), least.get(find(k))) for k, (i, _) in enumerate(docs)]


def quality_counts(text):
    w = words(text)
    seen = defaultdict(list)
    for k in range(len(w) - 7):
        seen[tuple(w[k : k + 8])].append(k)
    repeats = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeats)


def alnum(text):
    return [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]


def overlaps(docs, items, masks, span, window, similarity, shortest):
    """Every place of every item laid over every place of every text; short items as a whole."""
    out = defaultdict(list)
    for i, t in docs:
        w = alnum(t)
        for j, u in items:
            v = alnum(u)
            if len(v) < span:
                if len(v) >= shortest:
                    out[i, j] += [len(v)] * sum(w[k : k + len(v)] == v for k in range(len(w)))
                continue
            for k in range(len(w) - span + 1):
                for l in range(len(v) - span + 1):
                    if w[k] != v[l]:  # every mask begins with a word that counts
                        continue
                    same = [0 <= k + x < len(w) and 0 <= l + x < len(v) and w[k + x] == v[l + x] for x in range(span - window, window)]
                    hits = sum(all(same[window - span + x] for x, c in enumerate(m) if c == "1") for m in masks)
                    best = max(sum(same[o : o + window]) for o in range(window - span + 1))
                    if hits and best >= math.ceil(min(window, len(v)) * similarity - 1e-9):
                        out[i, j] += [best] * hits
    return sorted(((i, j, len(b), max(b)) for (i, j), b in out.items() if b), key=str)


def katz(docs, discounts, hot, k=5):
    texts = [(i, words(lower(t)) + ["</s>"], i is None or zlib.crc32(str(i).encode()) % 10 != 0) for i, t in docs]
    one, two, context = Counter(), defaultdict(Counter), Counter()
    for _, w, train in texts:
        if train:
            one.update(w)
            for a, b in zip(["<s>", *w], w):
                two[a][b] += 1
                context[a] += 1
    total, distinct = sum(one.values()), len(one)
    d1 = discounts([sum(c == r for c in one.values()) for r in range(1, k + 2)])
    d2 = discounts([sum(c == r for v in two.values() for c in v.values()) for r in range(1, k + 2)])
    taken = lambda c, d: (d[c] if c <= k else 1) * c
    p = {w: taken(c, d1) / total for w, c in one.items()}
    unknown = 1 - sum(p.values()) if total else 1.0
    if total and unknown <= 1e-12:
        scale, unknown = (1 - 1 / (total + 1)) / sum(p.values()), 1 / (total + 1)
        p = {w: x * scale for w, x in p.items()}
    back = {}
    for v, c in two.items():
        n = context[v] + (context[v] >= hot or all(x > k for x in c.values()))
        back[v] = ((1 - sum(taken(x, d2) for x in c.values()) / n) / (1 - sum(p[w] for w in c)), n)
    sums = [sum(taken(x, d2) for x in c.values()) / back[v][1] + back[v][0] * (unknown + sum(q for w, q in p.items() if w not in c)) for v, c in two.items()]
    out = []
    for i, w, train in texts:
        score = 0.0
        for a, b in zip(["<s>", *w], w):
            c = two[a][b] if a in two and b in two[a] else 0
            score += math.log10(taken(c, d2) / back[a][1] if c else p.get(b, unknown) * (back[a][0] if a in back else 1))
        base = sum(math.log10((one[b] + 0.1) / (total + 0.1 * (distinct + 1))) for b in w)
        out.append((i, not train, len(w), sum(one[b] > 0 for b in w), base, score))
    return out, total, sums


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def winnowed(text, k, window):
    """Chosen (position, hash input) pairs: for every window of k-grams the one of least hash, the last of equal ones."""
    kept = [(c, p) for p, c in enumerate(lower(text)) if c not in " \t\n\v\f\r"]
    grams = ["".join(c for c, _ in kept[j : j + k]) for j in range(max(len(kept) - k + 1, min(len(kept), 1)))]
    hashes = [gram_hash(g) for g in grams]
    chosen = []
    for j in range(max(len(grams) - window, 0) + 1 if grams else 0):
        least = min(range(j, min(j + window, len(grams))), key=lambda x: (hashes[x], -x))
        if not chosen or chosen[-1] != least:
            chosen.append(least)
    return [hashes[x] for x in chosen], [kept[x][1] for x in chosen]


POWERS = [pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(64)]


def gram_hash(gram):
    m = (1 << 64) - 1
    h = sum((ord(c) + 1) * p for c, p in zip(gram, POWERS)) & m
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & m
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & m
    return (h ^ h >> 31) >> 24


def compared_with_edits(docs, k, window):
    distinct = sorted({(order(i), text_order(t), t or "") for i, t in docs}, key=lambda x: (-x[0], x[1]))
    following = {x[:2]: y[2] for x, y in zip(distinct, distinct[1:] + distinct[:1])}
    out = []
    for i, t in docs:
        text = t or ""
        after = following[order(i), text_order(t)]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        prints = [winnowed(x, k, window)[0] for x in (text, edited, after)]
        like = [len(set(prints[0]) & set(x)) / len(set(prints[0]) | set(x)) if prints[0] or x else 1.0 for x in prints[1:]]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *("".join(f"{h:010x}" for h in x) for x in prints[:2]), *like))
    return out


def text_order(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def audited(docs, support, shown=50):
    """``docs``: (lang, source, text) rows."""
    docs = [(a or "", b or "", re.findall("[a-z\x80-\U0010ffff]+", lower(t))) for a, b, t in docs]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(x for d in mine for x in set(d[2]))
        kept = sorted(x for x, n in held.items() if n >= support)
        count = defaultdict(Counter)
        for _, source, terms in mine:
            count[source].update(x for x in terms if held[x] >= support)
        total = sum(count.values(), Counter())

        def share(c):
            n = sum(c.values())
            return {x: 1 + 1_000_000_000 * (c[x] + 5) // (n + 5 * len(kept)) for x in kept}

        p, q = {s: share(c) for s, c in count.items()}, share(total)
        for s in p:
            pairs = [("pair", o, sum(abs(p[s][x] - p[o][x]) for x in kept)) for o in p if o != s]
            over = [("term", x, p[s][x] - q[x]) for x in kept if count[s][x] and p[s][x] > q[x]]
            for rows, most in ((pairs, None), (over, shown)):
                ranked = sorted(rows, key=lambda r: (-r[2], r[1].encode()))[:most]
                out += [(lang, s, *r, k + 1) for k, r in enumerate(ranked)]
    return out

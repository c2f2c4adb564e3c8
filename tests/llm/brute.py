"""Plain versions of the operators, for small tables."""

import re
from collections import Counter

import xxhash


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))


def kept(rows, window=13):
    low = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None:
                low[k] = min(low.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and low[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def hits(rows, items, window=13):
    win = {}
    for i, t in items:
        w = plain_words(t)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            who = win.setdefault(tuple(w[j : j + k]), set())
            if i is not None:
                who.add(str(i))
    out = []
    for d, t in rows:
        w = plain_words(t)
        hit, found = [0] * len(w), set()
        for k in {len(x) for x in win}:
            for j in range(len(w) - k + 1):
                who = win.get(tuple(w[j : j + k]))
                if who is not None:
                    found |= who
                    hit[j : j + k] = [1] * k
        out.append((d, len(w), sum(hit), sorted(found)))
    return out


def fingerprint(t):
    w = words(fold(t))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(codes, radius=3):
    """(id, code) rows: the smallest id reachable."""
    parent = {c: c for _, c in codes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    low = {}
    for d, c in codes:
        if d is not None:
            low[find(c)] = min(low.get(find(c), d), d)
    return [(d, c, low.get(find(c))) for d, c in codes]


def trigrams(texts):
    tri = Counter()
    for t in texts:
        x = ["<s>", "<s>", *words(fold(t)), "</s>"]
        tri.update(tuple(x[i - 2 : i + 1]) for i in range(2, len(x)))
    return tri

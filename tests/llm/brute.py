"""Brute-force versions that several tests share."""

import collections
import re


def grams(text, n):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(ids, texts, n, num, den):
    sets = {}
    for i, t in zip(ids, texts):
        sets.setdefault(i, []).append(grams(t, n))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and len(x & y) * den >= num * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in sets}


def brute_windows(texts, items):
    """Every item-sized window of every text, by weighted Jaccard similarity of five-word shingles."""
    def shingles(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    out = set()
    for k, item in items:
        a = shingles(item)
        if not a:
            continue
        whole = collections.Counter(a)
        for i, t in texts:
            s = shingles(t)
            for start in range(max(0, len(s) - len(a)) + 1) if s else ():
                b = s[start : start + len(a)]
                same = sum((whole & collections.Counter(b)).values())
                if 5 * same >= 4 * (len(a) + len(b) - same):
                    out.add((i, k, start, same))
    return out

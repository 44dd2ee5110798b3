"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

SPACES, WORD = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(text):
    return SPACES.sub(" ", text or "")


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(AZ))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near_groups(docs):
    """[(id, text)] -> {position: position that stands for its group}"""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and find(i) != find(j):
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    return {i: find(i) for i in range(len(docs))}


def without_repeats(docs, width=20):
    """{id: (words, removed, digest of what stays)}; ids are distinct."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            key = tuple(w[s:s + width])
            if key in seen:
                gone[s:s + width] = [True] * width
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def hits(text, items, width=10):
    """(words, words hit, items that occur)"""
    w = ALNUM.findall((text or "").translate(AZ))
    hit, who = set(), set()
    windows = defaultdict(set)
    for item, t in items:
        v = ALNUM.findall((t or "").translate(AZ))
        n = min(width, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            windows[tuple(v[i:i + n])].add(item)
    for n in {len(k) for k in windows}:
        for i in range(len(w) - n + 1):
            if (owners := windows.get(tuple(w[i:i + n]))):
                hit.update(range(i, i + n))
                who |= owners
    return len(w), len(hit), who

"""Prices of group pairs and terms against a direct computation; trees that share nodes."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from tidemark.llm.divergence import Forest, gap, shares, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _direct(rows, least=3, top=200):
    """[(text, lang, source)] -> set of result rows"""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(AZ))
        groups[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = {(s, t): 1 + 10**9 * (counts[lang, s][t] + 1) // (n[s] + len(kept)) for s in sources for t in kept}
        for s in sources:
            pairs = [(-sum((share[s, t] - share[o, t]) ** 2 // share[o, t] for t in kept), o) for o in sources - {s}]
            for i, (v, o) in enumerate(sorted(pairs, key=lambda x: (x[0], x[1].encode())), 1):
                out.add((lang, s, "pair", o, -v, i))
            terms = []
            for t in kept:
                every = sum(counts[lang, o][t] for o in sources)
                q = 1 + 10**9 * (every + 1) // (sum(n.values()) + len(kept))
                if counts[lang, s][t] and share[s, t] > q:
                    terms.append((-((share[s, t] - q) ** 2 // q), t))
            for i, (v, t) in enumerate(sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top], 1):
                out.add((lang, s, "term", t, -v, i))
    return out


def _rows(df):
    rows = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "AbcÄéж" for b in "xyZöab"] + ["a1b2", "don't", "中文", "\U0001f600"]
    out = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s1", "s2", "S3", "é", None])
        out.append((i, rng.choice([None, "", "42 -"]) if rng.random() < .1 else
                    " ".join(rng.choice(vocab[:rng.randrange(2, len(vocab))]) for _ in range(rng.randrange(1, 60))),
                    lang, source, 1))
    return out


def test_against_direct_prices(table_of):
    for seed in (1, 2):
        rows = _corpus(seed) + [(1000, "only here", "fr", "s1", 1), (1001, None, "fr", "s2", 1), (1002, "9", "fr", None, 1)]
        want = _direct([r[1:4] for r in rows])
        assert any(r[0] == "fr" and r[4] == 0 for r in want)
        assert _rows(source_divergence(table_of(rows))) == want
        assert _rows(source_divergence(table_of(rows), block_terms=1)) == want  # at least 64 terms share a block
        assert _rows(source_divergence(table_of(rows), top=3)) == _direct([r[1:4] for r in rows], top=3)


def test_many_blocks(table_of):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(3))}"
                         for _ in range(200)), "en", f"s{rng.randrange(7)}", 1) for i in range(120)]
    assert _rows(source_divergence(table_of(rows), block_terms=64)) == _direct([r[1:4] for r in rows])


def test_edges(edge_docs, edge_rows):
    assert _rows(source_divergence(edge_docs)) == _direct([r[1:4] for r in edge_rows])
    assert source_divergence(edge_docs.limit(0)).count() == 0


def test_equal_node_pairs_are_priced_once():
    rng = np.random.default_rng(5)
    counts = np.zeros((3, 5000), np.int64)
    counts[:2, :40] = rng.integers(0, 3, (2, 40))
    counts[2] = counts[0]
    forest = Forest(counts)
    assert forest.roots[0] == forest.roots[2] != forest.roots[1]
    assert sum(len(first) for first, _ in forest.levels) < 200  # of 3 * 8191 nodes
    asked = []

    def leaf(pair, a, b):
        asked.extend(zip(pair.tolist(), a.tolist(), b.tolist()))
        return np.stack([gap(a + 1, b + 1), gap(b + 1, a + 1)])
    got = forest.price(np.array([0, 0]), np.array([1, 2]), leaf)
    assert len(asked) == len(set(asked)) <= 12
    assert got.tolist() == [[int(gap(counts[0] + 1, counts[i] + 1).sum()) for i in (1, 2)],
                            [int(gap(counts[i] + 1, counts[0] + 1).sum()) for i in (1, 2)]]


def test_shares_beyond_a_long():
    big = [0, 1, 10**12, 9 * 10**15]
    assert shares(big, sum(big), 4).tolist() == [1 + 10**9 * (c + 1) // (sum(big) + 4) for c in big]
    assert shares([0, 5], np.array([0, 5]), 2).tolist() == [1 + 10**9 // 2, 1 + 6 * 10**9 // 7]

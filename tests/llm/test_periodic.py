"""Runs by internal pattern matching against a search of every period."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm.periodic import LEAST, WaveletTree, periodic_runs, runs_of
from tidemark.llm.queries import op11_periodic_runs, with_period


def _runs(words, least=LEAST, repeats=3):
    n, out = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, repeats * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def _text(rng):
    """Nested, cut and overlapping periods over few words."""
    k, w = rng.choice([1, 2, 2, 3, 5, 50]), []
    for _ in range(rng.randrange(8)):
        kind = rng.random()
        if kind < .3 or not w:
            w += [str(rng.randrange(k)) for _ in range(rng.randrange(30))]
        elif kind < .8:
            p = [str(rng.randrange(k)) for _ in range(rng.randrange(1, rng.choice([3, 12, 40])))]
            if rng.random() < .5:
                p = p * rng.randrange(1, 5) + [str(rng.randrange(k))] * rng.randrange(3)
            x = p * rng.randrange(1, 9)
            w += x[:len(x) - rng.randrange(len(p) + 1)]
        else:
            w += w[rng.randrange(len(w)):] * rng.randrange(1, 4)
        if len(w) > 400:
            break
    return w


def test_range_successor():
    rng = np.random.default_rng(4)
    values = rng.permutation(300)[:200].astype(np.int64)
    tree = WaveletTree(values, 300)
    lo, x = rng.integers(0, 200, 500), rng.integers(0, 301, 500)
    hi = np.minimum(200, lo + rng.integers(0, 60, 500))
    want = [min((v for v in values[a:b].tolist() if v >= y), default=-1) for a, b, y in zip(lo, hi, x)]
    assert tree.successor(lo, hi, x).tolist() == want


def test_every_run_is_found():
    rng = random.Random(9)
    for _ in range(300):
        w = _text(rng)
        ids = np.array([*map(int, w), -1], np.int64)
        got = [(s, e - s, q) for s, e, q in runs_of(ids).tolist()]
        assert got == _runs(w), w


def test_shorter_runs_are_refused():
    with pytest.raises(ValueError):
        runs_of(np.array([1, -1]), least=10)


def test_texts_share_a_chunk(table_of):
    rng = random.Random(5)
    rows = [(i, "\t ".join(_text(rng)), None, None, 1) for i in range(60)]
    for chunk in (1, 500, 1 << 17):
        got = {r["doc_id"]: r for r in periodic_runs(table_of(rows), chunk_words=chunk).collect()}
        for i, text, *_ in rows:
            w = text.split()
            runs, r = _runs(w), got[i]
            assert [tuple(x) for x in r["runs"]] == runs and r["n_words"] == len(w)
            gone = {k for s, n, q in runs for k in range(s + q, s + n)}
            assert r["collapsed"] == " ".join(x for k, x in enumerate(w) if k not in gone)
            if runs:
                assert tuple(r["best"]) == max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]))
            else:
                assert r["best"] is None


def test_edges(edge_docs, edge_rows, lspark):
    got = periodic_runs(edge_docs).collect()
    assert len(got) == len(edge_rows) and {len(r["runs"]) for r in got} == {0}
    assert sorted((r["doc_id"] or 0, r["n_words"], r["collapsed"]) for r in got) == sorted(
        (i or 0, len((t or "").split()), " ".join((t or "").split())) for i, t, *_ in edge_rows)
    assert periodic_runs(edge_docs.limit(0)).count() == 0


def test_long_text_and_changed_rows(table_of):
    line = "one two three four five six seven"
    docs = table_of([(1, " ".join([line] * 30_000) + " x", None, None, 1), (2, line, None, None, 1),
                     (None, line, None, None, 1)])
    got = {r["doc_id"]: r for r in periodic_runs(docs, edit=lambda i, w: w * 9 if i == 2 else w).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 210_000, 7)] and got[1]["collapsed"] == line + " x"
    assert [tuple(r) for r in got[2]["runs"]] == [(0, 63, 7)] and got[2]["collapsed"] == line
    assert got[None]["runs"] == []


def test_query_rows(lspark, tmp_path, table_of):
    rng = random.Random(8)
    rows = [(i, " ".join(_text(rng)), None, None, 1) for i in range(200)] + [(None, "a " * 40, None, None, 1),
                                                                            (900, None, None, None, 1)]
    table_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op11_periodic_runs(lspark, str(tmp_path)).collect()}
    assert sum(with_period(i, t.encode().split()) != t.encode().split() for i, t, *_ in rows[:-1]) > 5
    for i, text, *_ in rows:
        w = [x.decode() for x in with_period(i, (text or "").encode().split())]
        runs = _runs(w)
        said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert (got[i]["n_runs"], got[i]["runs_sha256"]) == (len(runs), hashlib.sha256(said.encode()).hexdigest())
        if runs:
            s, n, q = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]))
            assert tuple(got[i][c] for c in ("start", "length", "period", "exponent_milli")) == (s, n, q, 1000 * n // q)
        else:
            assert got[i]["start"] is got[i]["exponent_milli"] is None

"""Nearest vectors against brute force: exact at factor one, recall above it, unusable and repeated vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructField, StructType

from tidemark.llm.common import table
from tidemark.llm.vptree import Dealer, Space, Tree, VpIndex, Walk

VECS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())),
                   StructField("h", StringType()), StructField("leaf", StringType())])


def _use(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def _direct(rows, wanted, k):
    """{(query, rank): (vec_id, score)}"""
    dim = max((len(v) for _, v, *_ in rows if v is not None), default=0)
    good = {(i, tuple(v)): np.array([*v, *[0.0] * (dim - len(v))], np.float32).astype(float)
            for i, v, *_ in rows if i is not None and _use(v)}
    out = {}
    for (q, _), x in good.items():
        if wanted(q):
            near = sorted((-float(np.add.accumulate(x * y)[-1]), i) for (i, _), y in good.items() if i != q)[:k]
            out |= {(q, n): (i, -s) for n, (s, i) in enumerate(near, 1)}
    return out


def _found(df):
    rows = df.collect()
    out = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows}
    assert len(out) == len(rows)
    return out


def _clusters(seed, n, dim=12, lengths=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * .5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths:
        x *= rng.uniform(.1, 5, (n, 1))
    return [(i, [float(v) for v in row], "h", "l") for i, row in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("lengths", [False, True])
def test_factor_one_is_exact(table_of, lengths):
    rows = _clusters(3, 700, lengths=lengths)
    vectors = table_of(rows, VECS)
    index = VpIndex(vectors, most_k=9, shard_points=64)
    assert index.trees.count() > 8
    got = _found(index.search(vectors.where("vec_id % 20 = 0"), 9, factor=1))
    want = _direct(rows, lambda q: q % 20 == 0, 9)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-14) for k in want)


def test_recall_and_pruning_of_larger_factors():
    x = np.array([v for _, v, *_ in _clusters(5, 6000)], float)
    space = Space(12, float((x * x).sum(1).max()), float(np.abs(x).max()))
    tree, q = Tree.build(x, [[i] for i in range(len(x))], space), x[::20]
    best = [set(o) for o in np.argsort(-(q @ x.T), axis=1)[:, :20].tolist()]
    seen, recall = [], []
    for factor in (1.0, 1.5, 4.0):
        walk = Walk(tree, q, np.full(len(q), np.inf), 20, factor, space)
        recall.append(sum(len(b & {i for i, _ in a}) for a, b in zip(walk.answers(), best)) / 20 / len(q))
        seen.append(walk.seen / len(q) / len(x))
    assert recall[0] == 1 and recall[1] > .95
    assert seen[0] < .7 and seen[2] < seen[1] < seen[0]


def test_dealer_bounds_hold():
    x = np.array([v for _, v, *_ in _clusters(6, 2000, lengths=True)], float)
    space = Space(12, float((x * x).sum(1).max()), float(np.abs(x).max()))
    p, q = space.points(x), space.queries(x[::50])
    dealer = Dealer(p[::3], 13, space)
    leaf, bound = dealer.leaf(p), dealer.bounds(q)
    assert bound.shape == (40, 16) and len(np.unique(leaf)) == 16
    assert (space.distance(q @ p.T) >= bound[:, leaf] - space.epsilon).all()


def test_recall_of_the_given_table(lspark, sf_small):
    vectors = table(lspark, sf_small, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    want = _direct(rows, lambda q: q % 20 == 0, 20)
    got = _found(VpIndex(vectors).search(vectors.where("vec_id % 20 = 0")))
    pairs = [{(q, i) for (q, _), (i, _) in m.items()} for m in (want, got)]
    assert len(pairs[0] & pairs[1]) >= .9 * len(pairs[0])


def test_edges(table_of):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], None, "x") for i in range(120)]
    rows += [(200, None, "h", "l"), (201, [], "h", "l"), (202, [0.0, -0.0, 0.0, 0.0], "h", "l"),
             (203, [1.0, None, 0.0, 0.0], "h", "l"), (204, [float("nan"), 1.0, 1.0, 1.0], "h", "l"),
             (205, [float("inf"), 1.0, 1.0, 1.0], "h", "l"), (None, [1.0, 1.0, 1.0, 1.0], "h", "l"),
             (206, [2.0, 1.0], "h", "l"), (207, [3e38, 3e38, 0.0, 1.0], "h", "l")]
    rows += [(0, rows[0][1], "h", "l"), (20, [1.0, 2.0, 3.0, 4.0], "h", "l")]       # an id twice, and with two vectors
    copies = [(i, [1.0, 0.5, 0.25, 2.0], "h", "l") for i in range(1000, 1300)]       # one very common vector
    ties = [(2000 + i, [0.0, 0.0, 0.0, 1.0 + (i % 3)], "h", "l") for i in range(60)]
    vectors = table_of(rows + copies + ties, VECS)
    for shard in (16, 8192):
        index = VpIndex(vectors, most_k=20, shard_points=shard)
        got = _found(index.search(vectors.where("vec_id % 20 = 0 AND vec_id <> 20"), 20, factor=1))
        want = _direct(rows + copies + ties, lambda q: q % 20 == 0 and q != 20, 20)
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(got[k][1] == pytest.approx(want[k][1], rel=1e-12) for k in want)
        twice = index.search(vectors.where("vec_id = 20"), 3, factor=1).collect()
        assert sorted(r["rank"] for r in twice) == [1, 1, 2, 2, 3, 3]
    few = table_of(rows[:3], VECS)
    assert sorted(_found(VpIndex(few).search(few, 20))) == [(q, n) for q in range(3) for n in (1, 2)]
    assert VpIndex(few.limit(0)).search(few).count() == 0
    assert VpIndex(few).search(few.limit(0)).count() == 0
    with pytest.raises(ValueError):
        VpIndex(few).search(few, 21)
    with pytest.raises(ValueError):
        VpIndex(few).search(few, 2, factor=.5)

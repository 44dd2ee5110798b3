"""Nearest vectors by inner product with vantage-point trees, one for each shard.

Inner products become distances: a vector x gets one more component,
sqrt(M^2 - |x|^2) with M the largest norm, a query is stretched to norm M and
gets a zero there; then d(q, x)^2 = 2 M^2 - 2 q.x, and the nearest point has
the largest product. All of it is a metric space, so the triangle inequality
holds: of the points at distance at most r from a vantage point v none is
nearer to q than d(q, v) - r, of those at r or more none than r - d(q, v).

A tree over a bounded sample deals all points to leaves; a leaf with many
points is dealt on by hash. Each shard gets a tree of its own. A query searches
the shards of its own leaf first, which bounds the distance of its k-th
neighbour, then those other leaves that the same inequality does not rule out.
``factor`` multiplies every lower bound before it is compared with that
distance: 1 rules out only what cannot hold a neighbour, so results are exact;
a larger factor rules out more and may lose some.

Equal vectors are one point, with the least ids that an answer can name, and
equal queries are one search, so a vector with very many copies is no group.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, written

FACTOR = 3.0            # see the README for the recall measured with it
SHARD_POINTS = 8192     # points of a tree, on average at most
LEAF_POINTS = 32
QUERY_BLOCK = 1024      # queries that one task walks through one tree at once
SAMPLE_ROWS = 16_384    # points from which the dealing tree is built, at most
SAMPLE_VALUES = 1 << 22  # and their components
_SLACK = 4              # points kept beyond the answer until their products are computed in order
_SEED = 11


class Space:
    """The lifted metric space: ``scale`` divides components beyond the range of squares."""

    def __init__(self, dim: int, norm2: float, largest: float):
        usable = 1e-200 < norm2 < 1e200
        self.dim, self.scale = dim, 1.0 if usable else largest
        self.norm2 = norm2 if usable else float(dim)

    def points(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        rest = np.sqrt(np.maximum(0.0, self.norm2 - np.einsum("ij,ij->i", x, x)))
        return np.concatenate([x, rest[:, None]], axis=1)

    def queries(self, x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x * (np.sqrt(self.norm2) / np.linalg.norm(x, axis=1, keepdims=True))
        return np.concatenate([x, np.zeros((len(x), 1))], axis=1)

    def distance(self, product: np.ndarray) -> np.ndarray:
        """Distance of points (or a query and a point) by their product in the lifted space."""
        return np.sqrt(np.maximum(0.0, 2 * self.norm2 - 2 * product))

    @property
    def epsilon(self) -> float:  # rounding of a distance, generously
        return 1e-7 * float(np.sqrt(self.norm2))


def _vantage(points: np.ndarray, rng, space: Space) -> int:
    """Of a few points the one whose distances to others spread most."""
    some = rng.choice(len(points), min(len(points), 8), replace=False)
    others = points[rng.choice(len(points), min(len(points), 64), replace=False)]
    return int(some[np.argmax(space.distance(points[some] @ others.T).std(axis=1))])


class Dealer:
    """A vantage-point tree of a few levels whose leaves receive points."""

    def __init__(self, sample: np.ndarray, leaves: int, space: Space):
        rng = np.random.default_rng(_SEED)
        depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        inner = (1 << depth) - 1
        self.depth, self.space = depth, space
        self.points = np.zeros((inner, space.dim + 1))
        self.radii = np.zeros(inner)
        held = {0: sample}
        for node in range(inner):  # node i has the children 2i + 1 (inside) and 2i + 2
            mine = held.pop(node)
            if len(mine):
                self.points[node] = mine[_vantage(mine, rng, space)]
                d = space.distance(mine @ self.points[node])
                self.radii[node] = np.median(d)
                inside = d <= self.radii[node]
            else:
                inside = np.zeros(0, bool)
            held[2 * node + 1], held[2 * node + 2] = mine[inside], mine[~inside]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        """The leaf, counted from 0, that holds each point (or is nearest to each query)."""
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            d = self.space.distance(np.einsum("ij,ij->i", points, self.points[node]))
            node = 2 * node + 1 + (d > self.radii[node])
        return node - len(self.radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and leaf a distance below which the leaf has no point."""
        d = self.space.distance(queries @ self.points.T)
        bound = np.zeros((len(queries), 1))
        for level in range(self.depth):
            at = slice((1 << level) - 1, (1 << level + 1) - 1)
            beyond = d[:, at] - self.radii[at]
            bound = np.maximum(np.repeat(bound, 2, axis=1),
                               np.stack([beyond, -beyond], axis=2).reshape(len(queries), -1))
        return bound


class Tree:
    """A vantage-point tree as arrays: the first point of a range is its vantage point, the rest by distance to it."""

    def __init__(self, points, ids, ends, inside, outside):
        self.points, self.ids, self.ends = points, ids, ends  # ids of point i end at ends[i]
        self.inside, self.outside = inside, outside           # by vantage point: largest distance within, least beyond

    @classmethod
    def build(cls, x: np.ndarray, ids: list[list[int]], space: Space) -> Tree:
        rng = np.random.default_rng(_SEED)
        points = space.points(x)
        order, n = np.arange(len(x)), len(x)
        inside, outside = np.zeros(n), np.full(n, np.inf)
        ranges = [(0, n)]
        while ranges:
            lo, hi = ranges.pop()
            if hi - lo <= LEAF_POINTS:
                continue
            mine = order[lo:hi]
            v = _vantage(points[mine], rng, space)
            mine[[0, v]] = mine[[v, 0]]
            d = space.distance(points[mine[1:]] @ points[mine[0]])
            by = np.argsort(d, kind="stable")
            order[lo + 1:hi], d = mine[1:][by], d[by]
            mid = cls.middle(lo, hi)
            inside[lo], outside[lo] = d[mid - lo - 2], d[mid - lo - 1]
            ranges += [(lo + 1, mid), (mid, hi)]
        flat = [i for p in order.tolist() for i in ids[p]]
        return cls(x[order], np.array(flat, np.int64), np.cumsum([len(ids[p]) for p in order.tolist()]), inside, outside)

    @staticmethod
    def middle(lo: int, hi: int) -> int:
        return (lo + 1 + hi) // 2

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, points=self.points, ids=self.ids, ends=self.ends, inside=self.inside, outside=self.outside)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as z:
            return cls(*(z[c] for c in ("points", "ids", "ends", "inside", "outside")))

    def search(self, x: np.ndarray, within: np.ndarray, k: int, factor: float, space: Space):
        """The k nearest (id, product) of each query, as lists; those beyond distance ``within`` may be missing.

        All queries go down the tree together; a node is entered with those of them that its bounds do not rule out.
        """
        return Walk(self, x, within, k, factor, space).answers()


class Walk:
    """One search of many queries in one tree."""

    def __init__(self, tree: Tree, x: np.ndarray, within: np.ndarray, k: int, factor: float, space: Space):
        self.tree, self.x, self.space, self.k, self.factor = tree, x, space, k, factor
        self.points, self.q = space.points(tree.points), space.queries(x)
        self.least_id = tree.ids[np.append(0, tree.ends[:-1])]
        self.keep = k + _SLACK
        self.best = np.full((len(x), self.keep), -np.inf)       # products in the lifted space
        self.who = np.full((len(x), self.keep), -1, np.int64)
        self.reach = within.copy()                              # distance of the k-th found, or what is known of it
        self.seen = 0                                           # products computed
        n = len(tree.points)
        fresh = np.isinf(within)
        if fresh.any():  # a first bound: the leaf next to the query
            self._descend(np.flatnonzero(fresh), 0, n)
        self._walk(np.arange(len(x)), n)

    def _children(self, active, lo, hi):
        """Distance of the vantage point beyond either child's bound: what a neighbour there has at least."""
        d = self.space.distance(self.q[active] @ self.points[lo])
        return d - self.tree.inside[lo], self.tree.outside[lo] - d

    def _descend(self, active, lo, hi):
        if hi - lo <= LEAF_POINTS:
            trial = self.best[active], self.who[active]
            self._offer(active, lo, hi)
            # the leaf is met again on the walk: its points would be there twice
            self.best[active], self.who[active] = trial
            return
        inner, outer = self._children(active, lo, hi)
        mid = Tree.middle(lo, hi)
        for some, a, b in ((active[inner <= outer], lo + 1, mid), (active[inner > outer], mid, hi)):
            if len(some):
                self._descend(some, a, b)

    def _walk(self, everyone, n):
        todo = [(everyone, 0, n, np.zeros(len(everyone)))]
        while todo:
            active, lo, hi, bound = todo.pop()
            active = active[self.factor * bound <= self.reach[active] + self.space.epsilon]
            if not len(active):
                continue
            if hi - lo <= LEAF_POINTS:
                self._offer(active, lo, hi)
                continue
            self._offer(active, lo, lo + 1)
            inner, outer = self._children(active, lo, hi)
            mid = Tree.middle(lo, hi)
            children = [(active, mid, hi, outer), (active, lo + 1, mid, inner)]
            if (inner > outer).sum() * 2 > len(active):  # the child that is nearer to most goes first
                children.reverse()
            todo += children

    def _offer(self, active, lo, hi):
        """Points lo to hi as neighbours of the active queries."""
        product = self.q[active] @ self.points[lo:hi].T
        self.seen += product.size
        rows = np.flatnonzero((product >= self.best[active, -1:]).any(axis=1))
        if not len(rows):
            return
        at = active[rows]
        best = np.concatenate([self.best[at], product[rows]], axis=1)
        who = np.concatenate([self.who[at], np.broadcast_to(np.arange(lo, hi), (len(rows), hi - lo))], axis=1)
        tie = np.where(who >= 0, self.least_id[who], np.iinfo(np.int64).max)
        order = np.lexsort((tie, -best), axis=-1)[:, :self.keep]
        self.best[at] = np.take_along_axis(best, order, 1)
        self.who[at] = np.take_along_axis(who, order, 1)
        last = self.space.distance(self.best[at, self.k - 1])
        self.reach[at] = np.minimum(self.reach[at], np.where(self.who[at, self.k - 1] >= 0, last, np.inf))

    def answers(self) -> list[list[tuple[int, float]]]:
        found = self.who >= 0
        who, row = self.who[found], np.nonzero(found)[0]
        score = np.zeros(len(who))
        for i in range(self.x.shape[1]):  # component by component: the same sum for the same vectors, wherever they are
            score += self.x[row, i] * self.tree.points[who, i]
        out: list[list] = [[] for _ in range(len(self.x))]
        starts = np.append(0, self.tree.ends)
        for r, p, s in zip(row.tolist(), who.tolist(), score.tolist()):
            out[r] += [(i, s) for i in self.tree.ids[starts[p]:starts[p + 1]].tolist()]
        return [sorted(o, key=lambda e: (-e[1], e[0]))[:self.k] for o in out]


def _matrix(column, dim: int) -> np.ndarray:
    """A column of lists of doubles as rows, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(column)), lengths), np.arange(int(lengths.sum())) - np.repeat(
        np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _dealt(dealer: Dealer, as_queries: bool):
    """Rows with a vector -> the same with the leaf that holds it, or is nearest to it as a query."""
    def work(batches):
        lift = dealer.space.queries if as_queries else dealer.space.points
        for batch in batches:
            if batch.num_rows:
                leaf = dealer.leaf(lift(_matrix(batch.column("vec"), dealer.space.dim)))
                yield batch.append_column("leaf", pa.array(leaf, pa.int64()))
    return work


def _others(dealer: Dealer, factor: float):
    """Queries with their leaf and the distance of their k-th neighbour there -> the other leaves to search."""
    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"), dealer.space.dim)
            reach = _reach(batch.column("kth").to_numpy(zero_copy_only=False), x, dealer.space)
            go = factor * dealer.bounds(dealer.space.queries(x)) <= reach[:, None] + dealer.space.epsilon
            go[np.arange(len(x)), batch.column("leaf").to_numpy()] = False
            row, leaf = np.nonzero(go)
            kept = batch.drop_columns(["leaf"]).take(pa.array(row))
            yield kept.append_column("leaf", pa.array(leaf, pa.int64()))
    return work


def _reach(kth: np.ndarray, x: np.ndarray, space: Space) -> np.ndarray:
    """Distance that belongs to the product ``kth`` with the query as it is; infinite where there is none."""
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.abs(x).max(axis=1)
        norm = norm * np.linalg.norm(x / norm[:, None], axis=1)
        d = space.distance(kth.astype(float) / space.scale / norm * np.sqrt(space.norm2))
    return np.where(np.isnan(d), np.inf, d)


def _build(space: Space):
    def work(key, shard):
        shard = shard.sort_by([("h", "ascending")])  # the same tree on every run
        tree = Tree.build(_matrix(shard["vec"], space.dim), shard["ids"].to_pylist(), space)
        return pa.table([pa.array([k.as_py()], pa.int64()) for k in key] + [pa.array([tree.pack()], pa.binary())],
                        names=["leaf", "part", "tree"])
    return work


def _search(space: Space, k: int, factor: float):
    """A tree and a block of queries -> the k best of that shard for each query."""
    entry = pa.list_(pa.struct([("id", pa.int64()), ("score", pa.float64())]))

    def work(batches):
        last = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                place = batch.column("leaf")[i].as_py(), batch.column("part")[i].as_py()
                if place != last[0]:
                    last = place, Tree.unpack(batch.column("tree")[i].as_py())
                asked = batch.column("asked")[i].values
                x = _matrix(asked.field("vec"), space.dim)
                kth = asked.field("kth").to_numpy(zero_copy_only=False).astype(float)
                found = last[1].search(x, _reach(kth, x, space), k, factor, space)
                yield pa.RecordBatch.from_arrays(
                    [asked.field("h"), asked.field("q"),
                     pa.array([[{"id": a, "score": s} for a, s in f] for f in found], entry)], ["h", "q", "found"])
    return work


def usable(vec):
    """True for vectors that take part: not null, no null or non-finite component, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


class VpIndex:
    """Vantage-point trees over all vectors of a table, written to the shared folder."""

    def __init__(self, vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", most_k: int = 20,
                 shard_points: int = SHARD_POINTS, sample_rows: int = SAMPLE_ROWS):
        """``most_k``: the largest k that will be asked for; ids of equal vectors beyond what it needs are not kept."""
        self.spark, self.most_k = vectors.sparkSession, most_k
        rows = self._rows(vectors, id_col, vec_col)
        by_id = Window.partitionBy("h", "vec").orderBy("id")
        points = written(
            rows.dropDuplicates(["h", "vec", "id"]).withColumn("nth", F.row_number().over(by_id))
            .where(F.col("nth") <= most_k + 1).groupBy("h", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids")),
            scratch(self.spark, "points"))
        square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
        n, dim, norm2, largest = points.agg(
            F.count("*"), F.max(F.size("vec")), F.max(square),
            F.max(F.array_max(F.transform("vec", F.abs)))).first()
        self.count = n
        if not n:
            return
        self.space = Space(dim, norm2, largest)
        sample_rows = max(1, min(sample_rows, SAMPLE_VALUES // dim))
        leaves = min(-(-n // shard_points), max(1, sample_rows // 16))
        few = points.select("vec", F.xxhash64("h").alias("o")).orderBy("o").limit(sample_rows if leaves > 1 else 1)
        sample = np.zeros((0, dim))
        if leaves > 1:  # bounded by sample_rows
            sample = np.array([r["vec"] + [0.0] * (dim - len(r["vec"])) for r in few.select("vec").collect()], float)
        self.dealer = Dealer(self.space.points(sample), leaves, self.space)
        placed = written(points.select("h", "vec", "ids").mapInArrow(
            _dealt(self.dealer, False), "h long, vec array<double>, ids array<long>, leaf long"), scratch(self.spark, "placed"))
        # one row a leaf, so at most sample_rows / 8 rows
        self.parts = written(placed.groupBy("leaf").agg(F.ceil(F.count("*") / shard_points).cast("long").alias("parts")),
                             scratch(self.spark, "parts"))
        shards = placed.join(F.broadcast(self.parts), "leaf").withColumn("part", F.pmod(F.col("h"), F.col("parts")))
        self.trees = written(shards.select("leaf", "part", "h", "vec", "ids").groupBy("leaf", "part").applyInArrow(
            _build(self.space), "leaf long, part long, tree binary"), scratch(self.spark, "trees"))

    @staticmethod
    def _rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        """id, vec, h of the rows that take part; -0.0 as 0.0."""
        rows = df.select(df[f"`{id_col}`"].cast("long").alias("id"), df[f"`{vec_col}`"].cast("array<double>").alias("vec"))
        rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
        rows = rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
        return rows.withColumn("h", F.xxhash64("vec"))

    def _in_shards(self, asked: DataFrame, k: int, factor: float) -> DataFrame:
        """h, q, found for each query (h, q, vec, kth, leaf) and each shard of its leaf."""
        asked = written(asked.join(F.broadcast(self.parts), "leaf").select(
            "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).drop("parts"),
            scratch(self.spark, "asked"))
        # one row a shard
        sizes = asked.groupBy("leaf", "part").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("long").alias("blocks"))
        blocks = asked.join(sizes, ["leaf", "part"]).groupBy(
            "leaf", "part", F.pmod(F.xxhash64("h", "q"), F.col("blocks")).alias("block")).agg(
            F.collect_list(F.struct("h", "q", "vec", "kth")).alias("asked"))
        return written(blocks.join(self.trees, ["leaf", "part"]).select("leaf", "part", "tree", "asked").mapInArrow(
            _search(self.space, k, factor), "h long, q long, found array<struct<id:long,score:double>>"),
            scratch(self.spark, "found"))

    def search(self, queries: DataFrame, k: int = 20, *, factor: float = FACTOR, id_col: str = "vec_id",
               vec_col: str = "embedding") -> DataFrame:
        """query_id, rank, vec_id, score: the k vectors of other ids with the largest inner product with each query.

        Nearest first, ties to the smaller id; all of them, if fewer. The score
        is the product of the vectors as they are, in double precision, summed
        in order. Rows with a null id take no part, as those whose vector is
        null, zero or holds null or non-finite components. A query's own id is
        no neighbour of it; rows that repeat both id and vector count once, an
        id with several vectors counts with each. A shorter vector is as one
        filled up with zeros. Empty tables give an empty result; other columns
        are not read. A vector with very many copies is searched once.
        """
        if not 1 <= k <= self.most_k:
            raise ValueError(f"the index answers up to {self.most_k} neighbours")
        if factor < 1:
            raise ValueError("a factor below one would widen nothing: one is exact")
        asked = self._rows(queries, id_col, vec_col)
        if not self.count:
            return asked.where("false").select(F.col("id").alias("query_id"), F.lit(1).alias("rank"),
                                               F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
        dim = self.space.dim
        asked = asked.withColumn("vec", F.slice("vec", 1, dim))  # all vectors are zero beyond
        asked = written(asked.dropDuplicates(["id", "h"]).withColumn("q", F.min("id").over(Window.partitionBy("h", "vec"))),
                        scratch(self.spark, "queries"))
        once = asked.where("id = q").select("h", "q", "vec", F.lit(None).cast("double").alias("kth"))
        ddl = "h long, q long, vec array<double>, kth double, leaf long"
        home = written(once.mapInArrow(_dealt(self.dealer, True), ddl), scratch(self.spark, "homes"))
        best = Window.partitionBy("h", "q").orderBy(F.col("e.score").desc(), "e.id")

        def nearest(found):
            return (found.select("h", "q", F.explode("found").alias("e")).withColumn("nth", F.row_number().over(best))
                    .where(F.col("nth") <= k + 1))
        first = self._in_shards(home, k + 1, factor)
        kth = nearest(first).where(F.col("nth") == k + 1).select("h", "q", F.col("e.score").alias("score"))
        ahead = home.drop("kth").join(kth, ["h", "q"], "left").select(
            "h", "q", "vec", F.col("score").alias("kth"), "leaf").mapInArrow(_others(self.dealer, factor), ddl)
        found = first.unionByName(self._in_shards(ahead, k + 1, factor))
        answers = nearest(found).groupBy("h", "q").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("nth", "e"))), lambda x: x["e"]).alias("found"))
        mine = asked.select("id", "h", "q").join(answers, ["h", "q"])
        others = F.slice(F.filter("found", lambda e: e["id"] != F.col("id")), 1, k)
        return mine.select(F.col("id").alias("query_id"), F.posexplode(others).alias("pos", "e")).select(
            "query_id", (F.col("pos") + 1).alias("rank"), F.col("e.id").alias("vec_id"), F.col("e.score").alias("score"))

"""How the sources of a language differ in their words, by hash-consed segment trees.

Each (lang, source) group and each lang has a segment tree over the ids of the
lang's kept terms; a leaf is a count, a node its two children. The ids are
dealt to blocks by a hash of the term, so a tree is a root over many block
trees, and one task builds the trees of all groups over one block: equal
subtrees, of one group or of several, are one node there. Two trees are priced
by going down both at once. A pair of nodes is met once for each pair of
groups, however often it occurs, and its price is the sum of its children's;
the empty subtrees of rare terms are one chain of nodes. Block prices of a pair
of groups are added up by Spark. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, utf8, written

SCALE = 1_000_000_000   # parts into which a group's words are shared
LEAST_DOCS = 3          # documents of the lang that hold a kept term
TOP_TERMS = 200
BLOCK_TERMS = 4096      # terms of a block, fewer where a lang has very many sources
BLOCK_CELLS = 1 << 20   # terms times sources of a block
SMALL_LANGS = 10_000    # rows up to which the table of langs is sent to every executor
_HELD = 400_000         # different terms that a task counts before it passes them on
_DOCS = 24              # bits of its documents in such a count
#: ASCII other than letters parts words; A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _count_terms(batches) -> Iterator[pa.RecordBatch]:
    """Texts -> counts of a term and of its documents by group, added up in the task; each group once with no term."""
    groups: dict[tuple, dict[bytes, int]] = {}  # occurrences << _DOCS | documents
    held = docs = 0

    def flush():
        for (lang, source), found in groups.items():
            both = np.array(list(found.values()), np.int64) if max(found.values(), default=0) < 1 << 63 else \
                np.array(list(found.values()), object)
            size = len(found)
            terms = pa.array([None, *found], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, size + 1), pa.repeat(source, size + 1), terms,
                 *(pa.array(np.append(0, c).astype(np.int64)) for c in (both >> _DOCS, both & (1 << _DOCS) - 1))],
                ["lang", "source", "term", "n", "docs"])
        groups.clear()
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(),
                                      utf8(batch.column("text"))):
            found = groups.setdefault((lang, source), {})
            before = len(found)
            for term, n in Counter((text or b"").translate(_FOLD).split()).items():
                found[term] = found.get(term, 0) + (n << _DOCS | 1)
            held += len(found) - before
            docs += 1
            if held > _HELD or docs >> _DOCS:
                yield from flush()
                held = docs = 0
    yield from flush()


class Forest:
    """Hash-consed segment trees of equal width, one for each row of a matrix of counts."""

    def __init__(self, counts: np.ndarray):
        rows, n = counts.shape
        width = 1 << max(0, int(n - 1).bit_length())
        self.counts, ids = np.unique(counts, return_inverse=True)
        self.absent = len(self.counts)  # the leaf beyond the last term
        ids = np.concatenate([ids.reshape(rows, n), np.full((rows, width - n), self.absent)], axis=1)
        self.leaves = ids
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from the leaves up: children of each node
        size = self.absent + 1
        while ids.shape[1] > 1:
            nodes, inverse = np.unique(ids[:, ::2] * size + ids[:, 1::2], return_inverse=True)
            self.levels.append((nodes // size, nodes % size))
            ids, size = inverse.reshape(rows, -1), len(nodes)
        self.roots = ids[:, 0]

    def price(self, left: np.ndarray, right: np.ndarray, leaf) -> np.ndarray:
        """For each pair of trees: the price of their roots, the sum over leaf pairs.

        ``leaf(pair, a, b)`` prices the counts a and b of trees ``left[pair]``, ``right[pair]``, as rows of longs.
        """
        pair, u, v = np.arange(len(left)), self.roots[left], self.roots[right]
        up = []
        for first, second in reversed(self.levels):
            size = int(max(first.max(), second.max())) + 1
            code = np.concatenate([(pair * size + a[u]) * size + a[v] for a in (first, second)])
            code, inverse = np.unique(code, return_inverse=True)
            up.append(inverse.reshape(2, -1))
            pair, u, v = code // (size * size), code // size % size, code % size
        there = u != self.absent          # the last leaves are absent from every tree alike
        cost = leaf(pair[there], self.counts[u[there]], self.counts[v[there]])
        price = np.zeros((len(cost), len(u)), np.int64)
        price[:, there] = cost
        for first, second in reversed(up):
            price = price[:, first] + price[:, second]
        return price


def shares(counts, words, kinds) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (words + kinds)), exactly."""
    counts, total = np.asarray(counts, np.int64), np.asarray(words, np.int64) + kinds
    if counts.size and int(counts.max()) >= (1 << 63) // SCALE - 1:  # beyond the range of a long
        return np.array((SCALE * (counts.astype(object) + 1)) // total + 1, np.int64)
    return 1 + SCALE * (counts + 1) // total


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / q); the shares are at most SCALE + 1, their squares fit a long."""
    return (p - q) * (p - q) // q


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, list[str]]:
    """A column as indices into its values in order."""
    codes = pc.dictionary_encode(column.combine_chunks())
    values = codes.dictionary.to_pylist()
    order = sorted(range(len(values)), key=values.__getitem__)
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    return rank[codes.indices.to_numpy()], [values[i] for i in order]


def _audit_block(top: int):
    """Counts of one block of a lang's terms -> prices of each pair of its groups, terms that set a group apart."""
    def work(key, block):
        heads = block.filter(pc.is_null(block["term"]))
        cells = block.filter(pc.is_valid(block["term"]))
        sources = heads["source"].to_pylist()
        words = np.array(heads["n"].to_pylist(), np.int64)
        row_of = {s: i for i, s in enumerate(sources)}
        kinds, all_words = heads["kinds"][0].as_py(), heads["words"][0].as_py()
        out: tuple[list, ...] = ([], [], [], [])

        def emit(part, source, items, values):
            for column, more in zip(out, ([part] * len(items), [source] * len(items), items, values)):
                column.extend(more)
        (term, terms), (group, held) = (_coded(cells[c]) for c in ("term", "source"))
        if terms:
            counts = np.zeros((len(sources) + 1, len(terms)), np.int64)
            counts[np.array([row_of[s] for s in held])[group], term] = cells["n"].to_numpy()
            counts[-1] = counts.sum(axis=0)
            order = np.argsort(-counts[-1], kind="stable")  # alike counts side by side: more equal subtrees
            counts, terms = counts[:, order], [terms[i] for i in order.tolist()]
            forest = Forest(counts)
        step = max(1, (1 << 19) // max(1, len(terms)))  # group pairs that are walked together
        for a, source in enumerate(sources):
            for lo in range(a + 1, len(sources), step):
                b = np.arange(lo, min(lo + step, len(sources)))
                values = np.zeros((2, len(b)), np.int64)
                if terms:
                    def both_ways(pair, x, y):
                        p, q = shares(x, words[a], kinds), shares(y, words[b[pair]], kinds)
                        return np.stack([gap(p, q), gap(q, p)])
                    values = forest.price(np.full(len(b), a), b, both_ways)
                others = [sources[i] for i in b.tolist()]
                emit("pair", source, others, values[0].tolist())
                for other, value in zip(others, values[1].tolist()):
                    emit("pair", other, [source], [value])
        everyone = len(sources)
        size = forest.absent + 1 if terms else 1
        for a, source in enumerate(sources if terms else []):
            has = np.flatnonzero(counts[a])
            codes, inverse = np.unique(forest.leaves[a, has] * size + forest.leaves[everyone, has], return_inverse=True)
            p = shares(forest.counts[codes // size], words[a], kinds)
            q = shares(forest.counts[codes % size], all_words, kinds)
            value, above = gap(p, q)[inverse], (p > q)[inverse]
            best = sorted(zip((-value[above]).tolist(), (terms[i].encode() for i in has[above].tolist())))[:top]
            emit("term", source, [t.decode() for _, t in best], [-v for v, _ in best])
        lang = key[0].as_py()
        return pa.table([pa.array([lang] * len(out[0]), pa.string()), *(pa.array(c, pa.string()) for c in (out[1], out[0], out[2])),
                         pa.array(out[3], pa.int64())], names=["lang", "source", "part", "item", "value"])
    return work


def source_divergence(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                      least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` prices a group against each other source of its lang over
    all kept terms, ``term`` names up to ``top`` terms of which the group has a larger share than the lang.

    Null text, lang and source are empty strings. A group without terms is
    priced like any other; a lang without kept terms prices every pair 0. Equal
    values rank by item in UTF-8 order; repeated rows count as often as they
    occur. A very long text is counted whole. An empty table gives an empty
    result; other columns are not read. Every ordered pair of a lang's sources
    is a row of the result, so that part grows with the square of the sources.
    """
    spark = docs.sparkSession
    src = docs.select(*[F.coalesce(docs[f"`{c}`"].cast("string"), F.lit("")).alias(n)
                        for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = written(src.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
                      .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
                      scratch(spark, "term-counts"))
    of_term = Window.partitionBy("lang", "term")
    kept = written(counted.where("term IS NOT NULL").withColumn("docs", F.sum("docs").over(of_term))
                   .where(F.col("docs") >= least_docs).select("lang", "source", "term", "n"), scratch(spark, "terms"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = (counted.where("term IS NULL").select("lang", "source")
              .join(sizes, ["lang", "source"], "left").fillna(0, ["n"]))
    in_lang = (kept.groupBy("lang", "term").agg(F.sum("n").alias("n"))
               .groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("n").alias("words")))
    per_block = F.greatest(F.lit(64), F.least(F.lit(block_terms), F.floor(F.lit(BLOCK_CELLS) / F.col("sources"))))
    langs = written(groups.groupBy("lang").agg(F.count("*").alias("sources")).join(in_lang, "lang", "left")
                    .fillna(0, ["kinds", "words"])
                    .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kinds") / per_block)).cast("long"))
                    .drop("sources"), scratch(spark, "langs"))
    if langs.count() <= SMALL_LANGS:
        langs = F.broadcast(langs)
    cells = kept.join(langs, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "n", "kinds", "words")
    heads = groups.join(langs, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
        "source", F.lit(None).cast("string").alias("term"), "n", "kinds", "words")
    # written, as both parts read it
    priced = written(cells.unionByName(heads).groupBy("lang", "block").applyInArrow(
        _audit_block(top), "lang string, source string, part string, item string, value long"), scratch(spark, "priced"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    # a pair of sources has a price in every block
    pairs = priced.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    # a term is in one block: each task passes on its best of a group only
    terms = priced.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)

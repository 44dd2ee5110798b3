"""Near-duplicate groups by MinHash with banding.

1. Each text becomes its set of distinct word shingles (64-bit hashes), from
   which come ``bands * rows`` universal-hash minima, folded into one key per
   band and one byte per minimum (the signature). Texts with the same set form
   one class; only one row of a class goes on.
2. Rows sharing a band key form a bucket. A bucket's rows are compared with
   its pivot (its least row), never all with all.
3. The signature drops pairs far below the threshold; the rest are confirmed
   on the full shingle sets of the whole texts.
4. Connected components join confirmed links. Buckets whose rows are then not
   all in one component are searched again. Inside a task, in blocks of bounded
   size, rows of different components are compared by signature; what leaves
   it is a spanning forest of the pairs that pass, never the pairs. The trees
   that these forests form together hold every candidate pair that is left.
   Each tree is searched in blocks of whole texts: pairs that pass by
   signature and are not yet in one component are confirmed on their sets, and
   again only a forest of links leaves the task. So no candidate is capped.
   What leaves the tasks grows with the size of a group; what goes in does
   not: a row is sent once for each block of its group, so G rows become about
   G^2 / BLOCK with signatures in a bucket that is still open, and
   G^2 / TEXT_BLOCK with whole texts in a tree.

With 60 bands of 5 rows a pair at similarity 0.75 shares no band with
probability 9e-8; the signature cut (0.60) lies six deviations below 0.75.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER_AZ, discard, located, scratch, utf8, written
from tidemark.llm.components import connected_components

SHINGLE = 5
THRESHOLD = 75          # per cent
BANDS, ROWS = 60, 5
SIGNATURE_CUT = 0.60
SEED = 20240229
BLOCK = 1024            # rows of a bucket that one task compares with another such block
TEXT_BLOCK = 256        # the same where the rows carry whole texts
_CACHE_WORDS = 400_000  # word hashes a worker remembers (a cache: clearing it changes nothing)


def _odd_constants(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**64, size=n, dtype=np.uint64, endpoint=False) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Distinct 64-bit shingle hashes of a text, sorted."""

    def __init__(self, width: int = SHINGLE):
        self.width = width
        self.factors = _odd_constants(width, SEED)
        self.words: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").translate(LOWER_AZ).split()
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        known, digest = self.words, xxhash.xxh64_intdigest
        if len(known) > _CACHE_WORDS:
            known.clear()
        ids = np.empty(n, np.uint64)
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w)
            out.append(h)
        ids[:] = out
        if n < self.width:  # the whole sequence is the one shingle
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)], np.uint64)
        m = n - self.width + 1
        h = ids[:m] * self.factors[0]
        for i in range(1, self.width):
            h += ids[i:i + m] * self.factors[i]
        return np.unique(_mix(h))


class Minima:
    """Universal-hash minima of a shingle set: h_i(x) = (a_i x + b_i) mod 2^64."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows = bands, rows
        k = bands * rows
        self.a = _odd_constants(k, SEED + 1)[:, None]
        self.b = _odd_constants(k, SEED + 2)[:, None]
        self.fold = _odd_constants(rows, SEED + 3)
        self.band_no = _odd_constants(bands, SEED + 4)
        self.room = np.empty((k, 256), np.uint64)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 256):
            x = shingles[i:i + 256]
            room = self.room[:, :len(x)]
            np.multiply(self.a, x[None, :], out=room)
            np.add(room, self.b, out=room)
            np.minimum(least, room.min(axis=1), out=least)
        return least

    def keys(self, least: np.ndarray) -> np.ndarray:
        per_band = (least.reshape(self.bands, self.rows) * self.fold).sum(axis=1, dtype=np.uint64)
        return _mix(per_band ^ self.band_no).view(np.int64)

    @staticmethod
    def signature(least: np.ndarray) -> bytes:
        return (_mix(least) & np.uint64(255)).astype(np.uint8).tobytes()


_FEATURES = ("doc_id long, _file string, _row long, n_shingles long, set_digest binary, "
             "signature binary, bands array<long>")


def _featurise(width: int, bands: int, rows: int, threshold: int):
    # a set of n is closest to one of n + 1 that holds it: n / (n + 1), at 0.75 from n = 3 on
    least_set = next((n for n in range(1, 100) if 100 * n >= threshold * (n + 1)), 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, minima = Shingler(width), Minima(bands, rows)
        for batch in batches:
            n, digest, signature, keys = [], [], [], []
            for text in utf8(batch.column("text")):
                s = shingler(text)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s) < least_set:  # such a set reaches the threshold with its equal only
                    signature.append(None)
                    keys.append(None)
                else:
                    least = minima(s)
                    signature.append(minima.signature(least))
                    keys.append(minima.keys(least))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_file"), batch.column("_row"),
                 pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(signature, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "_file", "_row", "n_shingles", "set_digest", "signature", "bands"])
    return run


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity that byte signatures suggest; chance agreement (1 in 256) is taken off."""
    return ((x == y).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _sizes_fit(n: np.ndarray, m: np.ndarray, threshold: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= threshold * np.maximum(n, m)


def _signature_filter(threshold: int, cut: float):
    """Rows a, b, n_a, n_b, signature_a, signature_b -> the pairs that may reach the threshold."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("signature_a").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            y = np.frombuffer(b"".join(batch.column("signature_b").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            ok = _sizes_fit(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), threshold)
            ok &= _alike(x, y) >= cut
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))
    return run


def _confirm(width: int, threshold: int):
    """Rows a, text_a, text_b -> those whose full shingle sets reach the threshold."""
    def run(batches):
        shingler = Shingler(width)
        last, mine = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), utf8(batch.column("text_a")),
                                 utf8(batch.column("text_b"))):
                if a != last:
                    last, mine = a, shingler(ta)
                other = shingler(tb)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * both >= threshold * (len(mine) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["u", "v"]).filter(
                pa.array(keep, pa.bool_()))
    return run


class _Forest:
    """Components of positions 0 .. n-1, relabelled as edges come in."""

    def __init__(self, labels: np.ndarray):
        self.root = np.unique(labels, return_inverse=True)[1].astype(np.int64)

    def join(self, i: int, others: np.ndarray) -> np.ndarray:
        """Unite i with ``others``; the positions in ``others`` of one edge for each component that is new to i."""
        roots = self.root[others]
        fresh, at = np.unique(roots, return_index=True)
        at = at[fresh != self.root[i]]
        if len(at):
            self.root[np.isin(self.root, roots[at])] = self.root[i]
        return at


def _two_blocks(key, rows):
    """The rows of one block, or of two one below the other, and where the second starts (None: a block is missing)."""
    import pandas as pd
    if key[1] == key[2]:
        return rows.reset_index(drop=True), 0
    first = rows["block"] == key[1]
    second = int(first.sum())
    both = pd.concat([rows[first], rows[~first]], ignore_index=True)
    return both, second if 0 < second < len(rows) else None


def _candidates(rows, second: int, threshold: int, cut: float):
    """(i, positions j > i) of rows in different components that sizes and signatures allow."""
    sig = np.frombuffer(b"".join(rows["signature"]), np.uint8).reshape(len(rows), -1)
    n, comp = rows["n"].to_numpy(), rows["component"].to_numpy()
    for i in range(second or len(rows)):
        start = max(second, i + 1)
        at = start + np.flatnonzero((comp[start:] != comp[i]) & _sizes_fit(n[i], n[start:], threshold))
        if len(at):
            at = at[_alike(sig[at], sig[i]) >= cut]
        if len(at):
            yield i, at


def _across(threshold: int, cut: float):
    """One pair of blocks of a bucket -> a spanning forest of the pairs that signatures allow."""
    def run(key, rows):
        import pandas as pd
        out = []
        rows, second = _two_blocks(key, rows)
        if second is not None:
            forest = _Forest(np.arange(len(rows)))
            ids = rows["uid"].to_numpy()
            for i, at in _candidates(rows, second, threshold, cut):
                out += [(ids[i], ids[j]) for j in at[forest.join(i, at)]]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")
    return run


def _confirm_blocks(width: int, threshold: int, cut: float):
    """One pair of blocks of a tree, with texts -> a spanning forest of the confirmed links."""
    def run(key, rows):
        import pandas as pd
        out = []
        rows, second = _two_blocks(key, rows)
        if second is not None:
            shingler = Shingler(width)
            sets = [None if t is None else shingler(t.encode()) for t in rows["text"]]
            forest = _Forest(rows["component"].to_numpy())
            ids = rows["uid"].to_numpy()
            for i, at in _candidates(rows, second, threshold, cut):
                for j in at:
                    if forest.root[i] != forest.root[j]:
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                            forest.join(i, np.array([j]))
                            out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")
    return run


def _in_blocks(rows: DataFrame, group: str, columns: list[str], size: int, run) -> DataFrame:
    """Apply ``run`` to every pair of blocks of at most about ``size`` rows of each group."""
    counts = rows.groupBy(group).agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    dealt = rows.join(counts, group).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block",
                        *columns).groupBy(group, "i", "j").applyInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                    threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
                    cut: float = SIGNATURE_CUT) -> DataFrame:
    """One row per row of ``docs``: doc_id, _file, _row, n_shingles, component_id, kept, class_uid.

    ``class_uid`` is the row that stands for the texts with the same shingle
    set. A null or empty text has no shingles, is linked with nothing and is its
    own component. A repeated row (same id, same text) joins its copies; of
    rows that share the least id, one is kept. Null ids count as largest; a
    group of null ids only has a null component_id and keeps one row.
    """
    spark = docs.sparkSession
    src = located(docs, id_col, text_col).toDF("doc_id", "text", "_file", "_row")
    src = src.withColumn("doc_id", F.col("doc_id").cast("long"))
    home = scratch(spark, "minhash")

    feats = written(src.mapInArrow(_featurise(width, bands, rows, threshold), _FEATURES)
                    .withColumn("uid", F.monotonically_increasing_id()), f"{home}/features")
    # one row of each class of equal sets goes on
    classes = written(feats.where("set_digest is not null").groupBy("set_digest").agg(
        F.min("uid").alias("class_uid")), f"{home}/classes")
    reps = feats.where("bands is not null").join(
        classes.select(F.col("class_uid").alias("uid")), "uid", "left_semi")
    bucket = Window.partitionBy("bucket")
    shared = written(reps.select("uid", F.explode("bands").alias("bucket")).withColumn(
        "pivot", F.min("uid").over(bucket)).withColumn("n", F.count("*").over(bucket)).where("n > 1"),
        f"{home}/buckets")
    sizes = feats.select("uid", F.col("n_shingles").alias("n"), "signature")

    # whole texts of every row that shares a bucket
    places = feats.select("uid", "_file", "_row").join(shared.select("uid").distinct(), "uid")
    texts = written(src.select("_file", "_row", "text").join(places.hint("merge"), ["_file", "_row"]).select(
        "uid", "text"), f"{home}/texts")

    stars = shared.where("uid <> pivot").select(F.col("pivot").alias("a"), F.col("uid").alias("b")).distinct()
    wide = (stars.join(sizes.toDF("a", "n_a", "signature_a"), "a")
            .join(sizes.toDF("b", "n_b", "signature_b"), "b"))
    passed = wide.mapInArrow(_signature_filter(threshold, cut), "a long, b long")
    both = (passed.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
            .select("a", "b", "text_a", "text_b"))
    links = written(both.mapInArrow(_confirm(width, threshold), "u long, v long"), f"{home}/links")
    found = written(connected_components(links), f"{home}/components-1")

    # buckets whose rows are not all in one component yet
    seated = shared.where("n > 2").select("bucket", "uid").join(
        found.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    mixed = seated.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where(
        "lo <> hi").select("bucket")
    open_rows = written(seated.join(mixed, "bucket").join(sizes, "uid"), f"{home}/open")
    forest = written(_in_blocks(open_rows, "bucket", ["uid", "component", "n", "signature"], BLOCK,
                                _across(threshold, cut)).distinct(), f"{home}/forest")
    trees = connected_components(forest).toDF("uid", "tree")
    carried = written(trees.join(found.withColumnRenamed("node", "uid"), "uid", "left").withColumn(
        "component", F.coalesce("component", "uid")).join(sizes, "uid").join(texts, "uid"), f"{home}/trees")
    more = written(_in_blocks(carried, "tree", ["uid", "component", "n", "signature", "text"], TEXT_BLOCK,
                              _confirm_blocks(width, threshold, cut)), f"{home}/links-2")
    if not more.isEmpty():
        found = written(connected_components(links.unionByName(more)), f"{home}/components-2")
    discard(spark, *(f"{home}/{x}" for x in ("buckets", "texts", "open", "forest", "trees")))

    # class members -> component -> least id
    ids = feats.select("uid", "doc_id", "_file", "_row", "n_shingles", "set_digest")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("uid").alias("uid"))
    by_class = classes.join(found.select(F.col("node").alias("class_uid"), "component"), "class_uid", "left").select(
        "set_digest", "class_uid", F.coalesce("component", "class_uid").alias("component"))
    class_first = ids.where("set_digest is not null").groupBy("set_digest").agg(F.min(rank).alias("first"))
    seats = by_class.join(class_first, "set_digest")
    heads = seats.groupBy("component").agg(F.min("first").alias("head"))
    seats = seats.select("set_digest", "class_uid", "component").join(heads, "component").select(
        "set_digest", "class_uid", "head")
    placed = ids.join(seats, "set_digest", "left")
    return placed.select(
        "doc_id", "_file", "_row", "n_shingles",
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.id")).alias("component_id"),
        F.coalesce(F.col("uid") == F.col("head.uid"), F.lit(True)).alias("kept"),
        F.coalesce("class_uid", "uid").alias("class_uid"))

"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is ``width`` consecutive words. Its minimiser is the run of ``m``
words in it with the least hash. Consecutive windows with the same minimiser
travel together as one packed string, the words they span, to the bucket of
that minimiser; equal windows have equal minimisers, so they meet in one
bucket. There the windows are sorted by hash, document and start, equal ones
are confirmed word for word, and all but the first are reported.

Before the shuffle a task keeps only the first of the identical packed strings
it meets: the windows of the others are repeats for certain, and are reported
at once. A passage or text with very many copies so sends one string per task
to its bucket. Packed strings of one bucket share compressed blocks of bounded
size, their places beside them as compressed columns. A bucket is read block by block; identical strings of different tasks
are combined on arrival in the same way.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import located, utf8

WIDTH = 20
MINIMISER = 4
SEED = 77
BUCKET_BYTES = 12 << 20   # packed text a bucket should hold, on average
BLOCK_BYTES = 1 << 18     # packed text of one compressed block
_CACHE_WORDS = 300_000
_PLACE = ("rank", "tie", "start", "stop")  # document order (id, then a tie-break), first window, end of windows
_CUT = "bucket long, block binary, places binary"
_LAST = (1 << 63) - 1     # rank of null ids


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64, size=n, dtype=np.uint64, endpoint=False) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in a logarithmic number of passes."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def _columns(places: list[tuple]) -> bytes:
    """Places as four columns of longs, the stop as its distance from the start: long runs of equal bytes."""
    a = np.array(places, "<i8").reshape(-1, 4)
    a[:, 3] -= a[:, 2]
    return a.T.tobytes()


def _places(columns: bytes) -> list[tuple]:
    """The inverse of ``_columns``."""
    rank, tie, start, length = np.frombuffer(columns, "<i8").reshape(4, -1)
    return list(zip(rank.tolist(), tie.tolist(), start.tolist(), (start + length).tolist()))


class Cutter:
    """Cuts a text into super-k-mers."""

    def __init__(self, width: int, m: int):
        self.width, self.m = width, m
        self.factors = _constants(m, SEED)
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(minimiser hash, first window, end of windows) of each run of windows."""
        n = len(words)
        windows = n - self.width + 1
        if windows < 1:
            return
        known, digest = self.known, xxhash.xxh64_intdigest
        if len(known) > _CACHE_WORDS:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w)
            out.append(h)
        ids = np.array(out, np.uint64)
        k = n - self.m + 1
        grams = ids[:k] * self.factors[0]
        for i in range(1, self.m):
            grams += ids[i:i + k] * self.factors[i]
        least = sliding_min(_mix(grams), self.width - self.m + 1)
        cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
        starts = [0, *cuts.tolist()]
        yield from zip(least[starts].tolist(), starts, [*starts[1:], windows])


def _cut(width: int, m: int, buckets: int):
    """Texts -> blocks of super-k-mers by bucket, and repeats found inside the task (bucket -1)."""
    def run(batches):
        cutter = Cutter(width, m)
        packer = zstandard.ZstdCompressor(level=3)
        first: dict[bytes, list] = {}  # identical strings of the task: earliest place
        repeats: list[tuple[int, int, int, int]] = []
        size = 0

        def flush():
            piles = defaultdict(list)
            for text, (bucket, place) in first.items():
                piles[bucket].append((text, place))
            out: tuple[list, list, list] = ([], [], [])

            def emit(bucket, strings, places):
                for column, value in zip(out, (bucket, packer.compress(strings), packer.compress(_columns(places)))):
                    column.append(value)
            for bucket, pile in piles.items():
                at = used = 0
                for i, (text, _) in enumerate(pile, 1):
                    used += len(text) + 1
                    if used >= BLOCK_BYTES or i == len(pile):
                        emit(bucket, b"\n".join(t for t, _ in pile[at:i]), [p for _, p in pile[at:i]])
                        at, used = i, 0
            for i in range(0, len(repeats), 10_000):  # passed on by any bucket
                emit(-1 - repeats[i][0] % buckets, b"", repeats[i:i + 10_000])
            first.clear()
            repeats.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), *(pa.array(o, pa.binary()) for o in out[1:])], ["bucket", "block", "places"])

        for batch in batches:
            for rank, tie, text in zip(batch.column("rank").to_pylist(), batch.column("tie").to_pylist(),
                                       utf8(batch.column("text"))):
                words = (text or b"").split()
                if len(words) < width:
                    continue
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()
                for minimiser, start, stop in cutter(words):
                    packed = joined[ends[start - 1] if start else 0:ends[stop + width - 2] - 1]
                    place = (rank, tie, start, stop)
                    seen = first.get(packed)
                    if seen is None:
                        first[packed] = [minimiser % buckets, place]
                        size += len(packed) + 200
                    elif seen[1] <= place:
                        repeats.append(place)
                    else:
                        repeats.append(seen[1])
                        seen[1] = place
                if size > 40 << 20 or len(repeats) > 200_000:
                    yield flush()
                    size = 0
        yield flush()
    return run


def _later_windows(strings: list[bytes], places: list[tuple], width: int) -> Iterator[tuple[int, int, int, int]]:
    """Runs of windows (rank, tie, start, stop) of the packed strings that some earlier window equals."""
    if not strings:
        return
    words: dict[bytes, int] = {}
    lengths, flat = [], []
    for s in strings:
        ws = s.split()
        lengths.append(len(ws))
        flat += [words.setdefault(w, len(words)) for w in ws]
    ids = np.array(flat, np.int64)
    lengths = np.array(lengths, np.int64)
    base = np.cumsum(lengths) - lengths
    per = lengths - width + 1
    total = int(per.sum())
    which = np.repeat(np.arange(len(strings)), per)
    offset = np.arange(total) - np.repeat(np.cumsum(per) - per, per)
    at = base[which] + offset
    factors = _constants(width, SEED + 1)
    h = np.zeros(total, np.uint64)
    spread = _mix((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    for i in range(width):
        h += spread[at + i] * factors[i]
    place = np.array(places, np.int64)
    rank, tie, start = place[which, 0], place[which, 1], place[which, 2] + offset
    order = np.lexsort((start, tie, rank, h))
    same_hash = h[order][1:] == h[order][:-1]
    if not same_hash.any():
        return
    # only windows that share a hash go on; they are compared word for word with their neighbour
    shares = np.zeros(total, bool)
    shares[1:] |= same_hash
    shares[:-1] |= same_hash
    order = order[shares]
    grid = ids[at[order][:, None] + np.arange(width)] if len(order) * width < 1 << 23 else None

    def equal(a, b):  # positions in order
        if grid is not None:
            return (grid[a] == grid[b]).all(axis=1)
        ok = np.ones(len(a), bool)
        for i in range(width):
            ok &= ids[at[order[a]] + i] == ids[at[order[b]] + i]
        return ok
    k = np.arange(1, len(order))
    hashed = h[order]
    alike = (hashed[1:] == hashed[:-1])
    true = equal(k - 1, k)
    if (alike & ~true).any():  # different windows under one hash: order those by their words
        rows = [ids[at[order] + i] for i in range(width)]
        again = np.lexsort([start[order], tie[order], rank[order], *rows[::-1], hashed])
        order = order[again]
        grid = None
        true = equal(k - 1, k) & (h[order][1:] == h[order][:-1])
    else:
        true &= alike
    dup = order[1:][true]
    if not len(dup):
        return
    r, t, s = rank[dup], tie[dup], start[dup]
    by = np.lexsort((s, t, r))
    r, t, s = r[by], t[by], s[by]
    new = np.flatnonzero((r[1:] != r[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1] + 1)) + 1
    lo = np.concatenate([[0], new])
    hi = np.concatenate([new, [len(s)]]) - 1
    yield from zip(r[lo].tolist(), t[lo].tolist(), s[lo].tolist(), (s[hi] + 1).tolist())


def _sort_buckets(width: int):
    """Blocks in order of their bucket -> repeated windows as runs (rank, tie, start, stop)."""
    def frame(rows):
        a = np.array(rows, np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array(a[:, i]) for i in range(4)], list(_PLACE))

    def run(batches):
        opener = zstandard.ZstdDecompressor()
        first: dict[bytes, tuple] = {}
        out: list[tuple] = []
        now = None

        def done():
            strings, places = list(first), list(first.values())
            first.clear()
            return _later_windows(strings, places, width)
        for batch in batches:
            for bucket, block, columns in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "places"))):
                if bucket != now:
                    out.extend(done())
                    now = bucket
                places = _places(opener.decompress(columns))
                if bucket < 0:
                    out.extend(places)
                else:
                    for packed, at in zip(opener.decompress(block).split(b"\n"), places):
                        seen = first.get(packed)
                        if seen is None:
                            first[packed] = at
                        elif seen <= at:
                            out.append(at)
                        else:
                            out.append(seen)
                            first[packed] = at
                if len(out) > 100_000:
                    yield frame(out)
                    out = []
        out.extend(done())
        yield frame(out)
    return run


def _apply(width: int):
    """Rows with their repeated windows (runs of starts) -> counts and the words that stay."""
    def run(batches):
        for batch in batches:
            n_words, removed, kept = [], [], []
            for text, runs in zip(utf8(batch.column("text")), batch.column("runs").to_pylist()):
                words = (text or b"").split()
                gone = np.zeros(len(words), bool)
                for r in runs or ():
                    gone[r["start"]:r["stop"] + width - 1] = True
                n_words.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if runs
                            else b" ".join(words))
            names = [n for n in batch.schema.names if n not in ("text", "runs")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [
                    pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array([k.decode() for k in kept], pa.string()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                names + ["n_words", "n_removed", "kept_text", "kept_sha256"])
    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                   m: int = MINIMISER, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text, kept_sha256.

    Null and empty texts have no words; texts shorter than a window lose
    nothing. Documents are ordered by id, null last; rows that repeat an id by
    a hash of their place in the files. An empty table gives an empty result.
    """
    src = located(docs, id_col, text_col).toDF("doc_id", "text", "_file", "_row")
    doc_id = F.col("doc_id").cast("long")
    src = src.select(doc_id.alias("doc_id"), "text", F.coalesce(doc_id, F.lit(_LAST)).alias("rank"),
                     F.xxhash64("_file", "_row").alias("tie"))
    # a super-k-mer repeats up to width - 1 words: about 3.2 times the text is packed
    packed_bytes = 3.2 * (src.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    buckets = max(8, int(packed_bytes / bucket_bytes))
    cut = src.select("rank", "tie", "text").mapInArrow(_cut(width, m, buckets), _CUT)
    runs = (cut.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(_sort_buckets(width), "rank long, tie long, start long, stop long"))
    by_doc = runs.groupBy("rank", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    return src.join(by_doc, ["rank", "tie"], "left").select("doc_id", "text", "runs").mapInArrow(
        _apply(width), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")

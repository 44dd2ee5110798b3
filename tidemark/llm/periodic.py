"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with least period q, three periods and ``least``
words long or more, that no neighbouring word continues. A run of period q
holds an aligned (dyadic) block of 8 words, or of the largest power of two up
to q, and that block again q words later. So for every aligned block of B
words that recurs, its occurrences that start within the next 2B words are
asked of a wavelet tree over the suffix array: the block's suffixes are one
interval there, and the next occurrence after a place is a range successor.
Three or more occurrences in a window of B starts form one progression with
the block's own period d as step; the period of a longer run through the block
is then the distance at which the d-periodic stretches around the block and
around its recurrence begin, or end, and no member of the progression has to
be tried. Every candidate is extended both ways with the class tables of the
suffix sorting and kept if it is long enough, so nothing rests on a hash.

Work is near-linear: texts of about ``chunk_words`` words together are sorted
by prefix doubling, of which only repeated blocks take further part.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import utf8

LEAST = 24            # words of the shortest run
REPEATS = 3           # periods of the shortest run
CHUNK_WORDS = 1 << 17  # words of the texts that are sorted together
_LOW = 3              # the smallest blocks have 2 ** _LOW words
_RUN = "struct<start:long,length:long,period:long>"
Edit = Callable[[int | None, list[bytes]], list[bytes]]


class WaveletTree:
    """Range successor over an array of non-negative integers, for many questions at once."""

    def __init__(self, values: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ranks, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            one = ((values >> b) & 1).astype(bool)
            rank = np.zeros(len(values) + 1, np.int64)
            np.cumsum(~one, out=rank[1:])
            self.ranks.append(rank)
            self.zeros.append(int(rank[-1]))
            values = np.concatenate([values[~one], values[one]])

    def _below(self, lo, hi, x):
        """How many values of [lo, hi) are less than x."""
        n = np.zeros(len(lo), np.int64)
        for i, (rank, zeros) in enumerate(zip(self.ranks, self.zeros)):
            one = (x >> (self.bits - 1 - i)) & 1 == 1
            zl, zh = rank[lo], rank[hi]
            n += np.where(one, zh - zl, 0)
            lo, hi = np.where(one, zeros + lo - zl, zl), np.where(one, zeros + hi - zh, zh)
        return n

    def successor(self, lo, hi, x):
        """The least value of [lo, hi) that is not less than x; -1 where there is none. x is at most ``top``."""
        nth = self._below(lo, hi, x)
        some = np.flatnonzero(nth < hi - lo)
        out = np.full(len(lo), -1, np.int64)
        nth, lo, hi = nth[some], lo[some], hi[some]
        value = np.zeros(len(some), np.int64)
        for rank, zeros in zip(self.ranks, self.zeros):
            zl, zh = rank[lo], rank[hi]
            one = nth >= zh - zl
            nth = np.where(one, nth - (zh - zl), nth)
            value = value << 1 | one
            lo, hi = np.where(one, zeros + lo - zl, zl), np.where(one, zeros + hi - zh, zh)
        out[some] = value
        return out


class Blocks:
    """Classes of equal blocks of 2 ** k words, named by where their suffixes begin in the suffix array.

    The last word and every separator must occur once only.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        order = np.argsort(words, kind="stable")
        self.names = [np.empty(n, np.int32)]  # by level: the block's place in the suffix array
        self.aligned: list[tuple] = []        # by level: repeated blocks at multiples of their length, interval
        at, key = order, words[order]
        base = np.zeros(n, np.int64)          # where the old class begins, and how far into it we are
        first = np.arange(n)
        name, now = self.names[0], None
        self.repeated = None                  # positions whose smallest block recurs
        level = 0
        while True:
            new = np.empty(len(at), bool)
            if len(at):
                new[0], new[1:] = True, key[1:] != key[:-1]
            heads = np.flatnonzero(new)
            sizes = np.diff(np.append(heads, len(at)))
            lo = (base + first)[heads]        # place of each new class in the suffix array
            name[at] = np.repeat(lo, sizes)
            size = np.repeat(sizes, sizes)
            more = size > 1
            at, size = at[more], size[more]
            if level == _LOW:
                self.repeated = np.sort(at)
            if level >= _LOW:
                on = at & ((1 << level) - 1) == 0
                p = at[on]
                self.aligned.append((p, name[p].astype(np.int64), name[p] + size[on]))
            if not len(at):
                break
            old = name[at].astype(np.int64)
            key = old * n + name[at + (1 << level)]
            order = np.argsort(key, kind="stable")
            at, key, old = at[order], key[order], old[order]
            heads = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
            base, first = old, np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
            name = name.copy()
            self.names.append(name)
            level += 1
        if self.repeated is None:
            self.repeated = np.empty(0, np.int64)

    def forward(self, i, j):
        """Number of equal words from i and from j on (i < j)."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.names) - 1, -1, -1):
            same = self.names[k][i] == self.names[k][j]
            step = same.astype(np.int64) << k
            i, j = i + step, j + step
        return i - start

    def backward(self, i, j):
        """Number of equal words up to i and up to j, both included (i < j; i may be -1)."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.names) - 1, -1, -1):
            a = i + 1 - (1 << k)
            ok = a >= 0
            a = np.where(ok, a, 0)
            same = ok & (self.names[k][a] == self.names[k][np.where(ok, j + 1 - (1 << k), 0)]) & ok
            step = same.astype(np.int64) << k
            i, j = i - step, j - step
        return start - i


def _candidates(blocks: Blocks, n: int):
    """(block, period) pairs among which every run has one."""
    rank_of = blocks.names[-1]                       # all different: the inverse suffix array
    place = np.sort(rank_of[blocks.repeated])        # the part of the suffix array that holds recurring blocks
    suffixes = np.empty(len(place), np.int64)
    suffixes[np.searchsorted(place, rank_of[blocks.repeated])] = blocks.repeated
    tree = WaveletTree(suffixes, n)
    for k, (p, lo, hi) in enumerate(blocks.aligned, _LOW):
        if not len(p):
            continue
        size = 1 << k
        lo, hi = np.searchsorted(place, lo), np.searchsorted(place, hi)
        if k == _LOW:                                # periods shorter than the smallest block
            near = tree.successor(lo, hi, p + 1)
            ok = (near >= 0) & (near - p < size)
            yield p[ok], (near - p)[ok]

        def following(x, some):
            out = np.full(len(p), -1, np.int64)
            out[some] = tree.successor(lo[some], hi[some], np.minimum(x[some], n))
            return np.where(out < p + 2 * size, out, -1)
        one = following(p + size, np.arange(len(p)))
        two = following(one + 1, np.flatnonzero(one >= 0))
        three = following(two + 1, np.flatnonzero(two >= 0))
        few = (one >= 0) & (three < 0)
        yield p[few], (one - p)[few]
        few &= two >= 0
        yield p[few], (two - p)[few]
        many = np.flatnonzero(three >= 0)            # a progression of step d
        at, there, d = p[many], one[many], (two - one)[many]
        ends = [x + d + blocks.forward(x, x + d) for x in (at, there)]
        yield at, ends[1] - ends[0]
        starts = [x - blocks.backward(x - 1, x + d - 1) for x in (at, there)]
        yield at, starts[1] - starts[0]


def runs_of(words: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """Rows (start, end, period) of all runs; the last word and each separator occur once in ``words``.

    ``repeats`` >= 3 and ``least`` >= 3 * 2 ** 3 words, on which the choice of blocks rests.
    """
    if least < LEAST or repeats < REPEATS:
        raise ValueError(f"runs need {LEAST} words and {REPEATS} periods at least")
    n = len(words)
    blocks = Blocks(words)
    found = []
    if len(blocks.repeated):
        for p, q in _candidates(blocks, n):
            ok = (q > 0) & (p + q < n)
            p, q = p[ok], q[ok]
            end = p + q + blocks.forward(p, p + q)
            start = p - blocks.backward(p - 1, p + q - 1)
            ok = end - start >= np.maximum(least, repeats * q)
            found.append(np.stack([start[ok], end[ok], q[ok]], 1))
    rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):  # one stretch: its least period
        rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))]
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows


def _analyse(texts: list[list[bytes]], least: int, repeats: int) -> list[np.ndarray]:
    """Runs (start, end, period) of each text."""
    known: dict[bytes, int] = {}
    flat: list[int] = []
    begins = []
    for words in texts:
        begins.append(len(flat))
        flat += [known.setdefault(w, len(known)) for w in words]
        flat.append(-1 - len(begins))  # a separator of its own
    rows = runs_of(np.array(flat, np.int64), least, repeats)
    which = np.searchsorted(np.array(begins), rows[:, 0], "right") - 1
    rows = rows - np.array(begins, np.int64)[which][:, None] * np.array([1, 1, 0])
    cut = np.searchsorted(which, np.arange(len(texts) + 1))
    return [rows[cut[i]:cut[i + 1]] for i in range(len(texts))]


def _best(rows: np.ndarray) -> dict | None:
    """The run of greatest length / period; of equals the first, then the one of least period."""
    best = None
    for start, end, period in rows.tolist():  # by start, then period: the first of equals stays
        power = Fraction(end - start, period)
        if best is None or power > best[0]:
            best = power, {"start": start, "length": end - start, "period": period}
    return best and best[1]


def _worker(least: int, repeats: int, chunk_words: int, edit: Edit | None):
    names = ["doc_id", "n_words", "runs", "best", "collapsed"]
    run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def finish(ids, texts):
        long = [i for i, w in enumerate(texts) if len(w) >= least]
        found = dict(zip(long, _analyse([texts[i] for i in long], least, repeats))) if long else {}
        none = np.empty((0, 3), np.int64)
        runs, best, collapsed = [], [], []
        for i, words in enumerate(texts):
            rows = found.get(i, none)
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, rows[:, 0] + rows[:, 2], 1)
            np.add.at(gone, rows[:, 1], -1)
            gone = np.cumsum(gone)[:-1] > 0
            runs.append([{"start": s, "length": e - s, "period": q} for s, e, q in rows.tolist()])
            best.append(_best(rows))
            collapsed.append((b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                              if len(rows) else b" ".join(words)).decode())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(w) for w in texts], pa.int64()),
             pa.array(runs, pa.list_(run_type)), pa.array(best, run_type), pa.array(collapsed, pa.string())], names)

    def work(batches):
        ids: list = []
        texts: list = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
                words = (text or b"").split()
                if edit is not None:
                    words = edit(doc_id, words)
                ids.append(doc_id)
                texts.append(words)
                held += len(words) + 1
                if held >= chunk_words:
                    yield finish(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield finish(ids, texts)
    return work


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                  repeats: int = REPEATS, chunk_words: int = CHUNK_WORDS, edit: Edit | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (by start, then period), best, collapsed.

    ``collapsed`` is the text without the words that some run covers beyond its
    first period, joined by one space. ``edit`` may change the words of a row,
    given its id, before they are searched. A row is worked on alone, so null
    and repeated ids, ties and repeated rows need no rule; a null or empty text
    has no words, no run, a null ``best`` and an empty ``collapsed``. An empty
    table gives an empty result; other columns are not read. A very long text
    is searched whole: memory follows ``chunk_words`` or the longest text, about
    4 bytes a word for each doubling of the longest repeat, and about 250 more.
    """
    src = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    return src.mapInArrow(_worker(least, repeats, chunk_words, edit),
                          f"doc_id long, n_words long, runs array<{_RUN}>, best {_RUN}, collapsed string")


def runs_text(runs):
    """``start,length,period`` and a line feed for each run."""
    line = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return F.array_join(line, "")

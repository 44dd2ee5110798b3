"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``width`` consecutive words of a test item (the whole
item where it has fewer). Patterns of one length are searched together: a
shift table over blocks of three words tells how far the search may jump, a
block that can end a pattern selects the few patterns that end in it, and
these are compared with the text word for word. A block that occurs in no
pattern skips ``length - 2`` words at once.

The patterns go to every task as a broadcast of bounded size: test items are
dealt into groups of at most ``group_words`` words besides their longest item,
and the corpus is scanned once per group, so a test set of any size works. Only
the hits of a row, never its text, meet between groups.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import located, scanned, scratch, utf8, written

WINDOW = 10
GROUP_WORDS = 200_000
BLOCK = 3
ITEM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A-Z to lower case; every other ASCII byte that is no digit or lower-case letter becomes a space.
FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
             for c in range(256))


def item_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Searcher:
    """Wu-Manber tables for one pattern length."""

    def __init__(self, length: int, patterns: dict[tuple[int, ...], int], base: int):
        self.length, self.base, self.block = length, base, min(BLOCK, length)
        self.default = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.ends: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
        for words, number in patterns.items():
            for end in range(self.block, length + 1):
                key = self.key(words, end)
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.ends[self.key(words, length)].append((list(words), number))

    def key(self, words, end: int) -> int:
        k = 0
        for w in words[end - self.block:end]:
            k = k * self.base + w
        return k

    def find(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of every occurrence, left to right."""
        n, length, default, shift, ends = len(ids), self.length, self.default, self.shift, self.ends
        base, block, end = self.base, self.block, self.length
        while end <= n:
            if block == 3:
                k = (ids[end - 3] * base + ids[end - 2]) * base + ids[end - 1]
            else:
                k = self.key(ids, end)
            step = shift.get(k, default)
            if step:
                end += step
                continue
            here = ids[end - length:end]
            for words, number in ends[k]:
                if words == here:
                    yield end - length, number
            end += 1


class Patterns:
    """All windows of a group of items, ready to search."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
        self.owners: list[set] = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in item_words(text)]
            if not ids:
                continue
            length = min(width, len(ids))
            for i in range(len(ids) - length + 1):
                number = by_length[length].setdefault(tuple(ids[i:i + length]), len(self.owners))
                if number == len(self.owners):
                    self.owners.append(set())
                self.owners[number].add(item)
        base = len(self.vocabulary) + 1
        self.searchers = [Searcher(n, p, base) for n, p in sorted(by_length.items())]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of words (start, end) inside any occurrence, merged; ids of the items that occur."""
        known = self.vocabulary
        ids = [known.get(w, 0) for w in words]
        spans, numbers = [], set()
        if any(ids):
            for s in self.searchers:
                for start, number in s.find(ids):
                    spans.append((start, start + s.length))
                    numbers.add(number)
        return merge(spans), set().union(*(self.owners[k] for k in numbers)) if numbers else set()


def merge(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


_READY: dict[str, Patterns] = {}  # tables of the last broadcast, kept by a reused worker


def _scan(shared, width: int):
    name = uuid.uuid4().hex

    def run(batches):
        if name not in _READY:
            _READY.clear()
            _READY[name] = Patterns(shared.value, width)
        patterns = _READY[name]
        for batch in batches:
            n, spans, items = [], [], []
            for text in utf8(batch.column("text")):
                words = item_words(text)
                at, who = patterns.hits(words)
                n.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in at])
                items.append(sorted(who, key=lambda x: (x is None, x)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_file"), batch.column("_row"), pa.array(n, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(items, pa.list_(pa.int64()))],
                ["doc_id", "_file", "_row", "n_words", "spans", "items"])
    return run


_SCANNED = ("doc_id long, _file string, _row long, n_words long, spans array<struct<start:long,end:long>>, "
            "items array<long>")


def _merge_parts(batches):
    """Hits of a row from several groups of items -> its merged spans and the items in order."""
    for batch in batches:
        spans = [merge([(s["start"], s["end"]) for part in row for s in part]) for row in batch.column("spans").to_pylist()]
        items = [sorted({x for part in row for x in part}, key=lambda x: (x is None, x))
                 for row in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_file"), batch.column("_row"),
             pa.array([[{"start": a, "end": b} for a, b in s] for s in spans],
                      pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
             pa.array(items, pa.list_(pa.int64()))], ["_file", "_row", "spans", "items"])


def item_groups(items: DataFrame, id_col: str, text_col: str, group_words: int) -> Iterator[list]:
    """Yield lists of different (id, text bytes), one list at a time on the driver.

    A list holds ``group_words`` words at most besides its longest item: the
    items are dealt to buckets by hash, and inside a bucket cut by the running
    sum of their words.
    """
    spark = items.sparkSession
    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).distinct()
    rows = rows.withColumn("n", F.coalesce(F.regexp_count("text", F.lit(ITEM_WORD)), F.lit(0)).cast("long"))
    buckets = max(1, -(-int(rows.agg(F.sum("n")).first()[0] or 0) // group_words))
    before = Window.partitionBy("bucket").orderBy("item", "text").rowsBetween(Window.unboundedPreceding, -1)
    dealt = written(
        rows.withColumn("bucket", F.pmod(F.xxhash64("item", "text"), F.lit(buckets)))
        .withColumn("part", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / group_words)).drop("n"),
        scratch(spark, "items"))
    groups = dealt.select("bucket", "part").distinct().orderBy("bucket", "part").collect()  # two numbers a group
    for bucket, part in groups:
        yield [(r["item"], None if r["text"] is None else r["text"].encode())
               for r in dealt.where((F.col("bucket") == bucket) & (F.col("part") == part)).select("item", "text").collect()]


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW,
                  group_words: int = GROUP_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, _file, _row, n_words, spans (merged word spans hit), items.

    Null and empty texts have no words and no hits; an item without words
    matches nothing; with no items nothing is hit. An item with a null id is
    searched like any other and listed as null, last. Repeated documents are
    handled alike, repeated items count once. A very long text is searched
    whole. An empty table of documents gives an empty result.

    Items of more than ``group_words`` words together are searched group by
    group: one scan and one broadcast at a time, of which only rows with hits
    are kept and joined to the documents.
    """
    spark = docs.sparkSession
    docs = scanned(docs, id_col, text_col)
    src = located(docs, id_col, text_col).toDF("doc_id", "text", "_file", "_row")
    src = src.withColumn("doc_id", F.col("doc_id").cast("long"))
    groups = item_groups(items, item_col, item_text_col, group_words)
    group, following = next(groups, []), next(groups, None)
    if following is None:
        return src.mapInArrow(_scan(spark.sparkContext.broadcast(group), width), _SCANNED)
    hits = None
    while group is not None:
        shared = spark.sparkContext.broadcast(group)
        found = written(src.mapInArrow(_scan(shared, width), _SCANNED).where(F.size("spans") > 0)
                        .select("_file", "_row", "spans", "items"), scratch(spark, "item-hits"))
        shared.unpersist()
        hits = found if hits is None else hits.unionByName(found)
        group, following = following, next(groups, None)
    merged = hits.groupBy("_file", "_row").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    merged = merged.mapInArrow(_merge_parts, "_file string, _row long, spans array<struct<start:long,end:long>>, items array<long>")
    counted = src.mapInArrow(_scan(spark.sparkContext.broadcast([]), width), _SCANNED).drop("spans", "items")
    none = F.array()
    return counted.join(merged, ["_file", "_row"], "left").select(
        "doc_id", "_file", "_row", "n_words", F.coalesce("spans", none.cast("array<struct<start:long,end:long>>")).alias("spans"),
        F.coalesce("items", none.cast("array<long>")).alias("items"))


def n_hit():
    """Words covered by the ``spans`` column."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])

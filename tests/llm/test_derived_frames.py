"""Frames that are no plain file scan give the result of the same rows written out."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate
from tidemark.llm.common import is_scan, scanned
from tidemark.llm.exact_dedup import exact_duplicates
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.superkmer import remove_repeats

LINE = " ".join(f"w{i}" for i in range(40))
OTHER = " ".join(f"v{i}" for i in range(40))


def _frames(docs):
    """The same kind of rows made by an explode, a join, a union and a limit."""
    ids = docs.sparkSession.range(3).select((F.col("id") * 100).alias("more"))
    return {
        "exploded": docs.select("doc_id", F.posexplode(F.split("text", "#")).alias("p", "text")).select(
            (F.col("doc_id") * 10 + F.col("p")).alias("doc_id"), "text"),
        "joined": docs.crossJoin(F.broadcast(ids)).select((F.col("doc_id") + F.col("more")).alias("doc_id"), "text"),
        "unioned": docs.select("doc_id", "text").union(docs.select(F.col("doc_id") + 50, "text")),
        "limited": docs.select("doc_id", "text").orderBy("doc_id").limit(3)}


@pytest.fixture
def frames(table_of):
    rows = [(1, f"{LINE}#two words", None, None, 1), (2, f"{OTHER}#{LINE}", None, None, 1), (3, "a b#a  b#c", None, None, 1),
            (4, None, None, None, 1), (5, OTHER, None, None, 1)]
    return _frames(table_of(rows))


def _items(lspark):
    return lspark.createDataFrame([(7, " ".join(f"W{i}" for i in range(5, 20))), (8, "two words")], "item_id long, text string")


OPERATORS = {
    "exact_dedup": (lambda d, items: exact_duplicates(d), ("doc_id", "keep_id", "group_size", "kept", "text_sha256")),
    "repeats": (lambda d, items: remove_repeats(d), ("doc_id", "n_words", "n_removed", "kept_sha256")),
    "near": (lambda d, items: near_duplicates(d), ("doc_id", "n_shingles", "component_id", "kept")),
    "benchmark": (lambda d, items: decontaminate.contamination(d, items).withColumn("h", decontaminate.n_hit()),
                  ("doc_id", "n_words", "h", "items")),
    "benchmark in groups": (lambda d, items: decontaminate.contamination(d, items, group_words=3).withColumn(
        "h", decontaminate.n_hit()), ("doc_id", "n_words", "h", "items"))}


@pytest.mark.parametrize("kind", ["exploded", "joined", "unioned", "limited"])
@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_same_as_written_out(lspark, frames, tmp_path, name, kind):
    run, columns = OPERATORS[name]
    frame, items = frames[kind], _items(lspark)
    assert not is_scan(frame)
    path = str(tmp_path / "rows")
    frame.write.parquet(path)
    plain = lspark.read.parquet(path)
    assert is_scan(plain) and is_scan(plain.where("doc_id > 1").select("text")) and scanned(plain) is plain
    assert not is_scan(plain.where(F.rand() < 2))

    def rows(df):
        return sorted((tuple(str(r[c]) for c in columns) for r in df.collect()))
    assert rows(run(frame, items)) == rows(run(plain, items))


def test_repeated_items_do_not_enlarge_a_group(lspark):
    text = " ".join(f"w{i}" for i in range(50))
    items = lspark.createDataFrame([(1, text)] * 40 + [(i, f"{text} x{i}") for i in range(2, 9)], "item_id long, text string")
    groups = list(decontaminate.item_groups(items, "item_id", "text", 100))
    assert sorted(i for g in groups for i, _ in g) == list(range(1, 9))
    assert all(sum(len(t.split()) for _, t in g) <= 100 + 51 for g in groups)

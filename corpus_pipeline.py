"""A training-corpus pipeline: five stages over ``documents``, each written as Parquet and reread.

toxicity -> exact deduplication -> near-duplicate removal -> benchmark
decontamination -> mixing. Every stage but the last returns the columns of
``documents``; the last returns the mix, one row per remaining document:
doc_id, source, size, source_size, target, copies, taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate
from tidemark.llm.common import located, prepare, scanned, scratch, table, written
from tidemark.llm.exact_dedup import exact_duplicates
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mix
from tidemark.llm.toxicity import THRESHOLD, ToxicityModel

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words inside benchmark windows from which a document is dropped; any hit counts by default.
LEAST_HIT = 1


def _without(spark: SparkSession, docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose place in the files is not among ``dropped`` (_file, _row).

    The few dropped places are written first: by their size Spark decides whether to send them to the rows, which then
    stay where they are, or to shuffle both.
    """
    gone = written(dropped.select("_file", "_row"), scratch(spark, "dropped"))
    return located(docs, *COLUMNS).join(gone, ["_file", "_row"], "left_anti").select(COLUMNS)


# Every stage: null and empty texts are like empty ones and are kept unless their stage says otherwise; null and repeated
# ids and repeated rows are told apart by their place in the files; very long texts are read whole; an empty table gives
# an empty result; columns beside those of documents are dropped. A frame that is no plain file scan is written first.

def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score at or above the threshold. Without labels of both kinds the score is the lexicon's."""
    prepare(spark)
    model = ToxicityModel.fit(docs, table(spark, sf_dir, "labels"))
    scored = model.score(docs.withColumn("body", F.col("text")), *COLUMNS, text_col="body")
    return scored.where(F.col("score") < THRESHOLD).select(COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the least doc_id stays, null ids last, of equal ids the first in the files; null
    and empty texts are equal, so one of them stays."""
    prepare(spark)
    docs = scanned(docs, *COLUMNS)
    return _without(spark, docs, exact_duplicates(docs).where("NOT kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the least doc_id stays; texts without words stay."""
    prepare(spark)
    docs = scanned(docs, *COLUMNS)
    return _without(spark, docs, near_duplicates(docs).where("NOT kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark window; without items none."""
    prepare(spark)
    docs = scanned(docs, *COLUMNS)
    hits = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(spark, docs, hits.where(decontaminate.n_hit() >= LEAST_HIT))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document that bring its source to its target; texts without words are taken 0 times."""
    prepare(spark)
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("mixing", mixing)]
#: Boosted trees and MinHash groups have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), scratch(spark, f"stage-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)

"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: density and number of lexicon words, share of them
near a second-person word, capitals, punctuation and obfuscation rates. The
lexicon is a short list of common insults plus word beginnings that the
labelled training rows show to mark toxic texts, whatever the language.

The classifier is fitted on at most about ``sample_rows`` labelled rows (picked
by a hash of the id, so the same at every run); a quarter of them fits the
calibration only. Scoring covers every row and whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 12_000
THRESHOLD = 0.7
#: Common insults, the part of the lexicon that needs no labels.
INSULTS = frozenset(
    "idiot idiots stupid moron morons loser losers scum trash garbage clown clowns pathetic worthless disgusting "
    "dumb fool imbecile jerk pig vermin filth hate kill shut freak lunatic coward liar "
    "dumm dummkopf blöd arschloch abschaum widerlich trottel versager "
    "imbécile crétin connard ordure minable débile abruti "
    "estúpido idiota imbécil basura patético asqueroso inútil payaso".split())
SECOND_PERSON = frozenset(
    "you your yours yourself u ur ya du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes vous votre "
    "vos tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
EDGES = re.compile(r"^\W+|\W+$")
INNER = re.compile(r"[\W_]+")
LOUD = re.compile(r"[!?]")
RUNS = re.compile(r"([^\w\s])\1+")
PREFIXES = (4, 5, 6)
NEAR = 5
KNOWN, LEARNT, PERSON, SHOUT, MASKED, MASKED_HIT, SINGLE = 1, 2, 4, 8, 16, 32, 64
FEATURES = ["hits_log", "hit_density", "known_density", "learnt_density", "hit_kinds", "window_hits", "near_person",
            "person_density", "capitals", "shouted", "loud", "punct_runs", "masked", "masked_hits", "words_log",
            "word_length"]
_CACHE = 300_000


def _terms(core: str) -> Iterator[str]:
    """A lower-case word as lexicon terms: itself, and its beginnings (marked by a star)."""
    yield core
    for k in PREFIXES:
        if len(core) >= k:
            yield core[:k] + "*"


class Features:
    def __init__(self, learnt: frozenset[str]):
        self.learnt = learnt
        self.seen: dict[str, int] = {}

    def _bits(self, token: str) -> int:
        core = EDGES.sub("", token)
        low = core.lower()
        bits = 0
        if low in INSULTS:
            bits |= KNOWN
        elif any(t in self.learnt for t in _terms(low)):
            bits |= LEARNT
        if low in SECOND_PERSON:
            bits |= PERSON
        if len(core) > 1 and core.isupper():
            bits |= SHOUT
        if len(core) == 1 and core.isalpha():
            bits |= SINGLE
        if not core.isalpha() and any(c.isalpha() for c in core):
            plain = INNER.sub("", low.translate(LEET))
            bits |= MASKED
            if plain != low and (plain in INSULTS or any(t in self.learnt for t in _terms(plain))):
                bits |= MASKED_HIT
        return bits

    def __call__(self, text: str) -> list[float]:
        tokens = text.split()
        n = len(tokens)
        if not n:
            return [0.0] * len(FEATURES)
        seen = self.seen
        if len(seen) > _CACHE:
            seen.clear()
        codes = []
        for t in tokens:
            b = seen.get(t)
            if b is None:
                b = seen[t] = self._bits(t)
            codes.append(b)
        code = np.array(codes, np.int16)
        masked_hits = int(np.count_nonzero(code & MASKED_HIT))
        single = np.flatnonzero(code & SINGLE)
        if len(single) >= 4:  # letters set apart: "i d i o t"
            for run in np.split(single, np.flatnonzero(np.diff(single) != 1) + 1):
                if len(run) >= 4:
                    word = "".join(EDGES.sub("", tokens[i]) for i in run).lower()
                    if any(x in word for x in INSULTS if len(x) >= 4):
                        masked_hits += 1
                        code[run[0]] |= MASKED_HIT
        at = np.flatnonzero(code & (KNOWN | LEARNT | MASKED_HIT))
        hits = len(at)
        near = window = kinds = 0
        if hits:
            person = np.flatnonzero(code & PERSON)
            if len(person):
                k = np.clip(np.searchsorted(person, at), 1, len(person)) - 1
                gap = np.minimum(np.abs(person[k] - at), np.abs(person[np.minimum(k + 1, len(person) - 1)] - at))
                near = int(np.count_nonzero(gap <= NEAR))
            window = int((np.searchsorted(at, at + 50) - np.arange(hits)).max())
            kinds = len({EDGES.sub("", tokens[i]).lower() for i in at})
        shouted, chars = int(np.count_nonzero(code & SHOUT)), len(text)
        return [float(np.log1p(hits)), 100 * hits / n, 100 * float(np.count_nonzero(code & KNOWN)) / n,
                100 * float(np.count_nonzero(code & LEARNT)) / n, float(kinds), float(window), near / max(hits, 1),
                100 * float(np.count_nonzero(code & PERSON)) / n,
                _capitals(text) / chars, shouted / n, 100 * len(LOUD.findall(text)) / n,
                100 * len(RUNS.findall(text)) / n, 100 * float(np.count_nonzero(code & MASKED)) / n,
                float(masked_hits), float(np.log1p(n)), chars / n]


def _capitals(text: str) -> int:
    raw = np.frombuffer(text.encode(), np.uint8)
    return int(np.count_nonzero((raw >= 65) & (raw <= 90)))


def _featurise(learnt: frozenset[str]):
    def run(batches):
        features = Features(learnt)
        for batch in batches:
            rows = [features(t or "") for t in batch.column("text").to_pylist()]
            keep = [i for i, c in enumerate(batch.schema.names) if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep] + [pa.array(rows, pa.list_(pa.float64()))],
                [batch.schema.names[i] for i in keep] + ["features"])
    return run


def _count_terms(batches):
    """Documents of each label that hold a term, summed over the partition before they are shuffled."""
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            words = {EDGES.sub("", t).lower() for t in set((text or "").split())}
            (toxic if label else clean).update({x for w in words if w for x in _terms(w)})
    every = list(toxic.keys() | clean.keys())
    for i in range(0, len(every), 50_000):
        part = every[i:i + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.string()), pa.array([toxic[t] for t in part], pa.int64()),
             pa.array([clean[t] for t in part], pa.int64())], ["term", "toxic", "clean"])


def learn_lexicon(train: DataFrame) -> frozenset[str]:
    """Terms that mark toxic texts in ``train`` (text, label): at least 4 different toxic texts
    and 1.5 per cent of them, 12 times the clean rate. As each is in that share of the toxic texts, there are
    at most 67 times as many as a toxic text has terms on average."""
    distinct = train.dropDuplicates(["text"])
    total = distinct.agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).first()
    nt, nc = total["t"] or 0, total["c"] or 0
    if not nt or not nc:
        return frozenset()
    counts = distinct.mapInArrow(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    lift = ((F.col("toxic") + 0.5) / (nt + 1)) / ((F.col("clean") + 0.5) / (nc + 1))
    best = (counts.where((F.col("toxic") >= max(4, 0.015 * nt)) & (lift >= 12) & (F.col("clean") <= 0.01 * nc + 1))
            .select("term").collect())
    stems = {r["term"] for r in best if r["term"].endswith("*")}
    # a term that a chosen shorter beginning covers adds nothing
    return frozenset(t for t in (r["term"] for r in best)
                     if not any(t.rstrip("*")[:k] + "*" in stems and t != t.rstrip("*")[:k] + "*" for k in PREFIXES))


def held_out(doc_id: Column) -> Column:
    """Rows no label of which is learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class ToxicityModel:
    """Lexicon, trees and calibration; ``score`` adds them to any table of texts."""

    def __init__(self, learnt: frozenset[str], trees, calibration):
        self.learnt, self.trees, self.calibration = learnt, trees, calibration

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> "ToxicityModel":
        """Learn from rows outside ``held_out``. Null ids, null labels and labels without a document are left out;
        an id with several labels counts as toxic if any says so."""
        usable = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")
                               ).where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        share = int(1_000_000 * min(1.0, sample_rows / max(1, usable.count())))
        sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).groupBy("doc_id").agg(
            F.max("label").alias("label"))
        # the sample is bounded by sample_rows, so its ids are small enough to send to every task
        rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).join(
            F.broadcast(sample), "doc_id").withColumn(
            "fits", F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 3) % 4 != 1).persist()
        ready = None
        try:
            train = rows.where("fits").select("text", "label")
            learnt = learn_lexicon(train)
            ready = rows.mapInArrow(_featurise(learnt), "doc_id long, label int, fits boolean, features array<double>")
            ready = ready.withColumn("vector", array_to_vector("features")).withColumn(
                "label", F.col("label").cast("double")).persist()
            kinds = {(r["fits"], r["label"]) for r in ready.select("fits", "label").distinct().collect()}
            if not {(True, 0.0), (True, 1.0)} <= kinds:
                return cls(learnt, None, None)
            gbt = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=16, maxDepth=3, stepSize=0.3,
                                minInstancesPerNode=3, seed=seed)
            trees = gbt.fit(ready.where("fits"))
            apart = ready.where("not fits") if {(False, 0.0), (False, 1.0)} <= kinds else ready
            judged = trees.transform(apart).select(vector_to_array("probability")[1].alias("raw"), "label")
            calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(judged)
            return cls(learnt, trees, calibration)
        finally:
            rows.unpersist()
            if ready is not None:
                ready.unpersist()

    def score(self, docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
        """``keep`` columns of ``docs`` plus ``score``. Null text counts as empty.

        Without labels of both kinds there are no trees; the score is then the
        share of insults, ten to a hundred words or more being 1.
        """
        named = [docs[c].alias(f"_k{i}") for i, c in enumerate(keep)]
        src = docs.select(*named, docs[text_col].alias("text"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
        ready = src.mapInArrow(_featurise(self.learnt), f"{schema}, features array<double>")
        if self.trees is None:
            density = F.col("features")[FEATURES.index("hit_density")]
            scored = ready.withColumn("score", F.least(F.lit(1.0), density / 10))
        else:
            raw = self.trees.transform(ready.withColumn("vector", array_to_vector("features"))).withColumn(
                "raw", vector_to_array("probability")[1])
            scored = self.calibration.transform(raw)
        bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
        return scored.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], bounded.alias("score"))

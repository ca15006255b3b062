"""Toxicity: gradient-boosted trees over dense features of the text, with isotonic calibration.

A lexicon is induced from labelled rows: beginnings of words and whole words that many toxic and few other documents
have. Features are densities of its entries (plain, weighted, in the densest stretch, near second-person words, after
undoing obfuscation), capitals, punctuation and rates of obfuscation. Spark's trees are fitted on one part of the
labelled rows, their margin is calibrated on the other.

Learning takes at most ``train_rows`` labelled rows, those first in the order of a hash of their id; the lexicon has at
most ``entries`` entries. Scoring is one pass over all rows and whole texts.

Defined cases: as for the quality classifier (null text is empty and has a score; several labels of an id count by
their mean; without two classes the score is the share of ones, 0.5 without labels; empty tables give empty results).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, written
from .quality import labelled_sample

# Second-person words of the languages that the texts are in.
SECOND_PERSON = frozenset("you your yours yourself ya u du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split())
# Letters that digits and symbols stand for in obfuscated words.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})

FEATURES = "words density weighted distinct count burst second_person proximity capitals upper_words exclamations questions punctuation mixed repeated_letters undone".split()
_STRETCH, _NEAR = 50, 5
_EDGES = "\"'`.,;:!?()[]{}<>«»„“”…*#%&$|-_/\\"
_REPEATED = re.compile(r"(\w)\1\1")


def _letters(word: str) -> str:
    return "".join(c for c in word if c.isalpha())


def _entries(text: str) -> set[str]:
    """Beginnings of 4 to 8 letters of a text's words, and the words themselves (with a mark at the end)."""
    found: set[str] = set()
    for w in {_letters(w) for w in text.lower().split()}:
        if len(w) > 2:
            found.update(w[:k] for k in range(4, min(8, len(w)) + 1))
            found.add(w[:40] + "$")
    return found


class Lexicon:
    """Entries with weights; of entries that begin with one another the shortest stands for all."""

    def __init__(self, weights: dict[str, float]):
        self.weights = {e: w for e, w in weights.items() if not any(e[:k] in weights for k in range(3, len(e)))}
        self.lengths = sorted({len(e) for e in self.weights if not e.endswith("$")})
        self.memo: dict[str, str | None] = {}

    def entry(self, word: str) -> str | None:
        """The entry that a lower-case word of letters has."""
        return next((word[:k] for k in self.lengths if word[:k] in self.weights), word + "$" if word + "$" in self.weights else None)

    def find(self, word: str) -> tuple[str | None, bool]:
        """The entry of a word as written in lower case, and if it took undoing obfuscation."""
        memo = self.memo
        if word not in memo:
            if len(memo) > 50_000:
                memo.clear()
            bare = word.strip(_EDGES)
            found = self.entry(bare)
            memo[word] = (found, False)
            if found is None and bare and not bare.isalpha():
                found = self.entry(_letters(bare.translate(LEET)))
                memo[word] = (found, found is not None)
        return memo[word]


def features(text: str, lexicon: Lexicon) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    low = text.lower().split()
    found = [lexicon.find(w) for w in low] if lexicon.weights else []
    at = [i for i, (e, _) in enumerate(found) if e is not None]
    entries = [found[i][0] for i in at]
    burst = start = 0
    for k, i in enumerate(at):
        while at[start] <= i - _STRETCH:
            start += 1
        burst = max(burst, k - start + 1)
    persons = [i for i, w in enumerate(low) if w.strip(_EDGES) in SECOND_PERSON] if not SECOND_PERSON.isdisjoint(low) or at else []
    near = 0
    if persons and at:
        p = np.array(persons)
        a = np.array(at)
        k = np.searchsorted(p, a)
        gap = np.minimum(np.abs(p[np.minimum(k, len(p) - 1)] - a), np.abs(p[np.maximum(k - 1, 0)] - a))
        near = int((gap <= _NEAR).sum())
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(raw, minlength=128)[:128]
    chars = max(1, len(text))
    punctuation = int(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum())
    mixed = 0
    if kinds[48:58].any() or punctuation:
        mixed = sum(not b.isalpha() and any(map(str.isalpha, b)) for w in low if not w.isalpha() and (b := w.strip(_EDGES)))
    return [
        math.log1p(len(words)), len(at) / n, sum(lexicon.weights[e] for e in entries) / n, float(len(set(entries))), math.log1p(len(at)),
        burst / min(n, _STRETCH), len(persons) / n, near / n, float(kinds[65:91].sum()) / chars, sum(map(str.isupper, words)) / n,
        float(kinds[33]) / n, float(kinds[63]) / n, punctuation / chars, mixed / n, len(_REPEATED.findall(text)) / n, sum(found[i][1] for i in at) / n,
    ]


def with_features(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Rows (doc_id, text, ...) with ``text`` replaced by the array ``dense``."""
    at = docs.columns.index("text")
    rest = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"{c} {t}" for c, t in docs.dtypes if c != "text"), "dense array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            dense = [features(t or "", lexicon) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(dense, pa.list_(pa.float64()))], names=[*rest, "dense"])

    return docs.mapInArrow(run, schema)


#: Entries that a task holds before it hands on their counts.
_HELD = 200_000


def _counts(rows: DataFrame) -> DataFrame:
    """(entry, n): how many of the texts have each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["entry", "n"])
        for batch in sliced(batches, 0):
            for t in batch.column(0).to_pylist():
                n.update(_entries(t or ""))
                if len(n) >= _HELD:
                    yield pack()
                    n.clear()
        yield pack()

    return rows.select("text").mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def induce(sample: DataFrame, entries: int = 300, support: int = 5, surprise: float = 25.0) -> Lexicon:
    """A lexicon from rows (text, label): entries that toxic documents have far more often than others.

    All entries that ``support`` toxic documents have are compared. ``surprise`` is the least log-likelihood ratio (of
    both shares against one common share); unlike a test of the odds it also tells apart entries that no other document
    has, from few documents on.
    """
    of = dict(sample.groupBy("label").count().collect())
    some, others = of.get(1.0, 0), of.get(0.0, 0)
    toxic = _counts(sample.filter("label = 1.0")).filter(F.col("n") >= support).withColumnRenamed("n", "a")
    both = toxic.join(_counts(sample.filter("label = 0.0")).withColumnRenamed("n", "b"), "entry", "left").withColumn("b", F.coalesce("b", F.lit(0)))
    a, b = F.col("a"), F.col("b")
    share = (a + b) / (some + others)
    cell = lambda seen, due: F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)
    g = 2 * (cell(a, some * share) + cell(some - a, some * (1 - share)) + cell(b, others * share) + cell(others - b, others * (1 - share)))
    odds = F.log((a + 0.5) / (some + 1)) - F.log((b + 0.5) / (others + 1))
    scored = both.select("entry", odds.alias("odds"), g.alias("g")).filter((F.col("odds") > 1.2) & (F.col("g") >= surprise))
    return Lexicon({r["entry"]: r["odds"] for r in scored.orderBy(F.desc("g"), "entry").limit(entries).collect()})


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    constant: float

    def score(self, docs: DataFrame) -> DataFrame:
        """Rows (doc_id, text, ...) with ``score`` in place of the text."""
        if self.trees is None:
            return docs.drop("text").withColumn("score", F.lit(self.constant))
        scored = _margins(self.trees, with_features(docs, self.lexicon))
        scored = self.calibration.transform(scored)
        # ties of the step function keep the order of the trees
        blended = 0.99 * F.col("calibrated") + 0.01 / (1.0 + F.exp(-2.0 * F.col("margin")))
        return scored.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), blended))).drop("dense", "features", "raw", "margin", "calibrated", "tree_class", "tree_p")


def _margins(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    return trees.transform(rows.withColumn("features", array_to_vector("dense"))).withColumn("margin", vector_to_array("raw")[1])


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, label_col: str = "toxic", train_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text", trees: int = 20, depth: int = 4) -> ToxicityModel:
    sample = written(labelled_sample(docs, labels, label_col, F.lit(True) if train is None else train, train_rows, id_col, text_col), "toxicity-sample")
    n, ones = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    none = ToxicityModel(Lexicon({}), None, None, float(ones) / n if n else 0.5)
    if not n or ones in (0, n):
        return none
    lexicon = induce(sample)
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3))
    rows = written(with_features(sample, lexicon).withColumn("part", part).coalesce(6), "toxicity-train")
    ready = rows.withColumn("features", array_to_vector("dense"))
    grow = ready.filter("part < 2")
    if grow.select("label").distinct().count() < 2 or ready.filter("part = 2").select("label").distinct().count() < 2:
        grow, held = ready, ready  # too few rows to part
    else:
        held = ready.filter("part = 2")
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=5, seed=7).fit(grow.select("label", "features"))
    model.setRawPredictionCol("raw").setPredictionCol("tree_class").setProbabilityCol("tree_p")
    margins = _margins(model, held.select("label", "dense"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(margins.select("label", "margin"))
    return ToxicityModel(lexicon, model, calibration, float(ones) / n)


def classify(docs: DataFrame, model: ToxicityModel, held_out: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return model.score(rows).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

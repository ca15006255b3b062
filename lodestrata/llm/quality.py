"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of the text.

The machine's pairwise weights are products of low-rank factors, so a document is scored in time linear in its features
(half of the square of the sums less the sum of the squares, factor by factor). Spark's own implementation trains and
scores it; words and statistics come from built-in functions, so nothing leaves the JVM.

Training takes at most ``train_rows`` labelled rows, those first in the order of a hash of their id. Scoring takes all
rows and whole texts. Features are the text's own: never language, source, id or label.

Defined cases: null text counts as empty and has a score as any other; rows with a null id are never learnt from and
count as held out if their fold says so (null: not held out); several labels of an id count by their mean, at least
half being 1; with no or only one class to learn from, the score is the share of ones (0.5 if there is no label); an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, written

#: Upper ends of the bins of each statistic; a statistic becomes one indicator a bin.
BINS = {
    "adjacent_repeats": [0.0, 0.02, 0.05, 0.15, 0.4],
    "distinct_sentences": [0.3, 0.6, 0.8, 0.95, 0.999],
    "distinct_lines": [0.3, 0.6, 0.8, 0.95, 0.999],
    "distinct_words": [0.1, 0.3, 0.5, 0.7, 0.9],
    "upper_words": [0.0, 0.02, 0.1, 0.3, 0.6],
    "symbols": [0.0, 0.005, 0.02, 0.05, 0.1],
    "bars": [0.0, 0.05, 0.2, 0.5, 0.9],
    "exclamations": [0.0, 0.05, 0.2, 0.5, 1.0],
    "digits": [0.0, 0.01, 0.05, 0.1, 0.3],
    "word_length": [3.0, 4.5, 6.0, 8.0, 12.0],
    "words": [5.0, 20.0, 60.0, 200.0, 1000.0],
    "characters": [20.0, 100.0, 400.0, 1500.0, 8000.0],
}


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0)).cast("double")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """Structure statistics and metadata of a text; ``words`` is a column of its own, so that it is made once."""
    n = F.size(words)
    chars = F.length(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    sentences = F.filter(F.split(text, r"[.!?]\s"), lambda x: x != "")
    without = lambda c: chars - F.length(F.translate(text, c, ""))
    repeats = F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(n, F.lit(1))), lambda a, b: a == b), lambda x: x))
    return {
        "adjacent_repeats": _share(repeats, n),
        "distinct_sentences": _share(F.size(F.array_distinct(sentences)), F.size(sentences)),
        "distinct_lines": _share(F.size(F.array_distinct(lines)), F.size(lines)),
        "distinct_words": _share(F.size(F.array_distinct(words)), n),
        "upper_words": _share(F.size(F.filter(words, lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1))), n),
        "symbols": _share(without("#$%&*@^~<>{}[]=+_\\/"), chars),
        "bars": _share(without("|"), n),
        "exclamations": _share(without("!"), n),
        "digits": _share(without("0123456789"), chars),
        "word_length": _share(chars, n),
        "words": n.cast("double"),
        "characters": chars.cast("double"),
    }


def _bins(value: Column, ends: list[float]) -> list[Column]:
    low: list[Column] = [F.lit(True), *(value > e for e in ends)]
    high: list[Column] = [*(value <= e for e in ends), F.lit(True)]
    return [(a & b).cast("double") for a, b in zip(low, high, strict=True)]


def with_features(docs: DataFrame, text_col: str = "text", dimensions: int = 4096) -> DataFrame:
    """``docs`` with the vector lodestrata_features: word shares hashed to ``dimensions``, then indicators of the bins."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.withColumn("lodestrata_words", words_of(text))
    named = named.withColumns({f"lodestrata_s_{k}": v for k, v in statistics(text, F.col("lodestrata_words")).items()}).drop("lodestrata_words")
    bits = [b for k, ends in BINS.items() for b in _bins(F.col(f"lodestrata_s_{k}"), ends)]
    out = named.withColumn("lodestrata_w", F.split(F.lower(text), SPACE_CLASS)).withColumn("lodestrata_b", array_to_vector(F.array(*bits)))
    out = HashingTF(inputCol="lodestrata_w", outputCol="lodestrata_h", numFeatures=dimensions).transform(out)
    out = Normalizer(inputCol="lodestrata_h", outputCol="lodestrata_n").transform(out)
    for name, size in (("lodestrata_n", dimensions), ("lodestrata_b", len(bits))):  # else sizes are taken from a first row
        out = VectorSizeHint(inputCol=name, size=size, handleInvalid="optimistic").transform(out)
    out = VectorAssembler(inputCols=["lodestrata_n", "lodestrata_b"], outputCol="lodestrata_features").transform(out)
    return out.drop("lodestrata_w", "lodestrata_b", "lodestrata_h", "lodestrata_n", *(f"lodestrata_s_{k}" for k in BINS))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, train: Column, train_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to ``train_rows`` rows (text, label) of ``docs`` that have a label and satisfy ``train`` (of doc_id)."""
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    own = own.filter(train).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(own), "doc_id").select("doc_id", "text", "label").repartition(12)


@dataclass
class QualityModel:
    """A fitted machine, or the constant to give if there was nothing to tell apart."""

    model: FMClassificationModel | None
    constant: float
    dimensions: int

    def score(self, docs: DataFrame, out: str = "score", text_col: str = "text") -> DataFrame:
        if self.model is None:
            return docs.withColumn(out, F.lit(self.constant))
        scored = self.model.transform(with_features(docs, text_col, self.dimensions))
        return scored.withColumn(out, vector_to_array("lodestrata_p")[1]).drop("lodestrata_p", "lodestrata_r", "lodestrata_y", "lodestrata_features")


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, label_col: str = "quality", train_rows: int = 6000, dimensions: int = 4096, factors: int = 4, iterations: int = 60, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    sample = labelled_sample(docs, labels, label_col, F.lit(True) if train is None else train, train_rows, id_col, text_col)
    rows = written(with_features(sample, "text", dimensions).select("label", F.col("lodestrata_features").alias("features")), "quality-train")
    n, ones = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or ones in (0, n):
        return QualityModel(None, float(ones) / n if n else 0.5, dimensions)
    machine = FMClassifier(featuresCol="features", labelCol="label", factorSize=factors, maxIter=iterations, stepSize=0.05, regParam=1e-5, initStd=0.05, solver="adamW", seed=7)
    model = machine.fit(rows)
    model.setFeaturesCol("lodestrata_features").setProbabilityCol("lodestrata_p").setRawPredictionCol("lodestrata_r").setPredictionCol("lodestrata_y")
    return QualityModel(model, float(ones) / n, dimensions)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def classify(docs: DataFrame, model: QualityModel, held_out: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = model.score(rows)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject."""
    return model.score(docs, "lodestrata_score", text_col).filter(F.col("lodestrata_score") >= threshold).drop("lodestrata_score")

"""Classifiers: held-out accuracy on the whole table, and their defined cases."""

import pytest
from lodestrata.llm import quality, queries, toxicity
from pyspark.sql import functions as F


def auc(pairs):
    ordered = sorted(pairs)
    ones = sum(y for _, y in ordered)
    ranks = sum(k for k, (_, y) in enumerate(ordered) if y)
    return (ranks - ones * (ones - 1) / 2) / (ones * (len(ordered) - ones))


LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, label, least", [("op10_quality", "quality", 0.97), ("op2_toxicity", "toxic", 0.75)])
def test_held_out(spark, name, label, least):
    found = queries.queries()[name](spark, LARGER)
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", label)
    rows = found.join(labels, "doc_id").filter("held_out").select("score", label).collect()
    assert auc([(r[0], r[1]) for r in rows]) >= least
    assert all(0 <= r[0] <= 1 for r in rows)


MODELS = {"quality": quality, "toxic": toxicity}


def labels_of(spark, ones):
    return spark.createDataFrame([(10 * (i + 1), int(i % 2 == 0 and ones), int(i % 2 == 0 and ones)) for i in range(25)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("label", MODELS)
def test_odd_texts_have_scores(spark, edges, edge_rows, label):
    m = MODELS[label]
    model = m.fit(edges, labels_of(spark, True))
    out = m.classify(edges, model, F.lit(False)).collect()
    assert len(out) == len(edge_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)


@pytest.mark.parametrize("label", MODELS)
def test_nothing_to_learn_from(spark, edges, none, label):
    m = MODELS[label]
    zeros = m.fit(edges, labels_of(spark, False))
    assert {r["score"] for r in m.classify(edges, zeros, F.lit(True)).collect()} == {0.0}
    nothing = m.fit(none, labels_of(spark, True))
    assert {r["score"] for r in m.classify(edges, nothing, F.lit(True)).collect()} == {0.5}
    assert m.classify(none, nothing, F.lit(True)).collect() == []


@pytest.mark.parametrize("label", MODELS)
def test_null_and_repeated_ids(spark, nulls, label):
    m = MODELS[label]
    model = m.fit(nulls, labels_of(spark, True))
    assert len(m.classify(nulls, model, quality.fold("doc_id", 5) == 0).collect()) == 6


def test_rare_entries_are_compared_too(spark):
    """A rare word that tells is found behind more frequent words than a driver would list."""
    common = " ".join("q" + "".join(chr(97 + k // 26**p % 26) for p in range(4)) for k in range(12_000))
    rows = [(f"{common} {'grobian' if i < 12 else ''}", 1.0) for i in range(20)] + [(common, 0.0)] * 40
    entries = toxicity.induce(spark.createDataFrame(rows, "text string, label double")).weights
    assert list(entries) == ["grob"]


def test_quality_scores_are_those_of_the_machine(spark):
    """The pairwise sum over factors, written out, gives Spark's score; the statistics are restated in plain Python."""
    import math
    import re

    docs = spark.read.parquet(f"{LARGER}/documents.parquet").filter("doc_id < 60")
    full, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    model = quality.fit(full, labels, dimensions=64, iterations=5)
    m = model.model
    bias, linear, factors = m.intercept, m.linear.toArray(), m.factors.toArray()
    rows = quality.with_features(docs, "text", 64).select("doc_id", "text", "lodestrata_features").collect()
    scores = {r["doc_id"]: r["score"] for r in model.score(docs).select("doc_id", "score").collect()}
    for r in rows:
        x = r["lodestrata_features"].toArray()
        pairs = sum(x[i] * x[j] * float(factors[i] @ factors[j]) for i in range(len(x)) if x[i] for j in range(i + 1, len(x)) if x[j])
        assert abs(scores[r["doc_id"]] - 1 / (1 + math.exp(-(bias + float(linear @ x) + pairs)))) < 1e-6
        text = r["text"] or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        n = len(words)
        share = lambda a, b: a / b if b else 0.0
        values = {
            "adjacent_repeats": share(sum(a == b for a, b in zip(words, words[1:])), n),
            "distinct_words": share(len(set(words)), n),
            "upper_words": share(sum(w.upper() == w and w.lower() != w and len(w) > 1 for w in words), n),
            "bars": share(text.count("|"), n),
            "exclamations": share(text.count("!"), n),
            "digits": share(sum(text.count(c) for c in "0123456789"), len(text)),
            "word_length": share(len(text), n),
            "words": n,
            "characters": len(text),
        }
        at = 64
        for name, ends in quality.BINS.items():
            if name in values:
                want = sum(values[name] > e for e in ends)
                assert x[at : at + len(ends) + 1].tolist() == [float(k == want) for k in range(len(ends) + 1)], (name, r["doc_id"])
            at += len(ends) + 1


def test_toxicity_scores_are_calibrated_margins(spark):
    """Isotonic steps between which one interpolates, restated, and one hundredth of the margin's sigmoid."""
    import math

    import numpy as np

    full, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    model = toxicity.fit(full, labels, trees=5)
    docs = full.filter("doc_id < 200").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    margins = {r["doc_id"]: r["margin"] for r in toxicity._margins(model.trees, toxicity.with_features(docs, model.lexicon)).select("doc_id", "margin").collect()}
    x, y = model.calibration.boundaries.toArray(), model.calibration.predictions.toArray()
    assert (np.diff(y) >= 0).all()
    for r in model.score(docs).collect():
        m = margins[r["doc_id"]]
        assert abs(r["score"] - (0.99 * float(np.interp(m, x, y)) + 0.01 / (1 + math.exp(-2 * m)))) < 1e-6


def test_toxicity_features_of_a_text():
    """Each feature by hand."""
    import math

    lexicon = toxicity.Lexicon({"idio": 2.0, "trash$": 1.0})
    text = "YOU idiots!! are 1di0ts, trash... why? noooo"
    found = dict(zip(toxicity.FEATURES, toxicity.features(text, lexicon), strict=True))
    n, chars = 7, len(text)
    want = {
        "words": math.log1p(n), "density": 3 / n, "weighted": 5 / n, "distinct": 2.0, "count": math.log1p(3), "burst": 3 / n, "second_person": 1 / n, "proximity": 3 / n,
        "capitals": 3 / chars, "upper_words": 1 / n, "exclamations": 2 / n, "questions": 1 / n, "punctuation": 7 / chars, "mixed": 1 / n, "repeated_letters": 1 / n, "undone": 1 / n,
    }
    assert all(abs(found[k] - v) < 1e-9 for k, v in want.items()), {k: (found[k], v) for k, v in want.items() if abs(found[k] - v) >= 1e-9}

"""Reworded texts against a comparison of all pairs."""

import random

import pytest
from lodestrata import plans
from lodestrata.operators import rewording as W
from lodestrata.operators import stewardship as S
from pyspark.sql import functions as F


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[-1]))
    return row[-1]


def ratio(a, b):
    a, b = (" ".join(sorted((x or "").lower().split())) for x in (a, b))
    return round(200 * lcs(a, b) / (len(a) + len(b)), 4) if a or b else 100.0


def mangled(text, rnd, n):
    out = list(text)
    for _ in range(n):
        at = rnd.randrange(len(out) + 1)
        if rnd.random() < 0.5 and out:
            del out[min(at, len(out) - 1)]
        else:
            out.insert(at, rnd.choice("abcdeäß "))
    words = "".join(out).split()
    rnd.shuffle(words)
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    base = ["".join(rnd.choices("abcdefg  ", k=n)).strip() or "x" for n in (1, 2, 3, 5, 8, 9, 10, 12, 19, 20, 40, 41, 90, 200)]
    return [(i % 3, mangled(rnd.choice(base), rnd, rnd.choice([0, 1, 1, 2, 4, 9, 20])), rnd.choice(base)) for i in range(150)] + [(0, None, ""), (1, " ", None), (2, "A  B c", "c b a")]


def test_subsequences():
    rnd = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rnd.choices("abc", k=rnd.randint(0, 12))) for _ in "ab")
        assert W.common_subsequence(a, b) == lcs(a, b)


@pytest.mark.parametrize("least", [90.0, 75.0, 60.0, 100.0])
def test_no_pair_is_missed(spark, texts, least):
    left = spark.createDataFrame([(k, a) for k, a, _ in texts], "k int, text string")
    right = spark.createDataFrame([(k, b) for k, _, b in texts], "k int, text string")
    fold = lambda t: " ".join(sorted((t or "").lower().split()))
    want = {(k, fold(a), fold(b)) for k, a, _ in texts for j, _, b in texts if k == j and fold(a) and fold(b) and ratio(a, b) >= least}
    assert {(r["k"], r["a"], r["b"]) for r in W.reworded_pairs(left, right, ["k"], "text", least).collect()} == want


def test_reworded_texts_are_covered(spark, texts):
    """Free text by likeness, lists as they are, other values by their folded form."""
    text = "Blickfeld builds solid-state lidar sensors for cars and for smart infrastructure"
    pending = [(1, "description", text), (1, "tags", '["a","b"]'), (1, "city", "München"), (2, "description", "another text")]
    proposed = [
        (1, "description", "blickfeld builds solid-state lidar sensors for cars and smart infrastructure."), (1, "description", "Cars get their sensors from this firm"),
        (2, "description", text), (1, "tags", '["b","a"]'), (1, "tags", '["a","b"]'), (1, "city", "munchen"), (1, "city", "Munchem"), (3, "city", "München"), (1, "description", None),
    ]
    schema = "k int, field string, new string"
    got = W.uncovered(spark.createDataFrame(proposed, schema), spark.createDataFrame(pending, schema), "k", ["description"], ["tags"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([proposed[i] for i in (1, 2, 3, 6, 7, 8)], key=str)
    assert W.uncovered(spark.createDataFrame([], schema), spark.createDataFrame(pending, schema), "k", ["description"]).count() == 0
    assert W.uncovered(spark.createDataFrame(proposed, schema), spark.createDataFrame([], schema), "k", ["description"]).count() == len(proposed)


def test_staging_of_texts_is_that_of_going_row_by_row(spark):
    rnd = random.Random(8)
    base = [" ".join(rnd.choices(["solar", "cells", "robots", "for", "farms", "cheap", "new"], k=9)) for _ in range(3)]
    say = lambda: rnd.choice(["", None]) if rnd.random() < 0.1 else mangled(rnd.choice(base), rnd, rnd.choice([0, 1, 2, 5, 9]))
    masters = {m: say() for m in range(10)}
    incoming = [(s, rnd.randrange(10), say()) for s in range(90)]
    pending = [(m, "about", say() or "x") for m in range(0, 10, 2)]
    blank = lambda v: not (v or "").strip()
    asked, live, want = {}, dict(masters), set()
    for m, _, v in pending:
        asked.setdefault(m, []).append(v)
    for seq, m, new in incoming:
        if blank(new):
            continue
        waiting, old = asked.setdefault(m, []), live[m]
        fills = blank(old) and all(v.lower() == new.lower() for v in waiting)
        if fills:
            live[m] = new
            want.add((seq, m, "fill"))
        elif blank(old) or ratio(old, new) < 90:
            covered = any(ratio(v, new) >= 90 for v in waiting)
            want.add((seq, m, "covered" if covered else "conflict"))
            if not covered:
                waiting.append(new)
    got = S.proposals(
        spark.createDataFrame(list(masters.items()), "master_id long, about string"), spark.createDataFrame(incoming, "seq long, master_id long, about string"),
        spark.createDataFrame(pending, "master_id long, field string, new string"), ["about"], ["about"],
    )
    assert {(r["seq"], r["master_id"], r["action"]) for r in got.collect()} == want


def test_query_of_reworded_items(spark, sf_dir):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    own = plans.QUERIES["reworded_coverage"](spark, sf_dir)
    got = {(r["k"], r["variant"], r["item_id"]) for r in own.collect()}
    assert got
    variants = {
        "reordered": lambda t: " ".join(t.split(" ")[::-1]), "shouted": str.upper, "shortened": lambda t: t[: len(t) * 17 // 20], "halved": lambda t: t[: len(t) // 2],
    }
    want = set()
    for item, text in items:
        for name, make in variants.items():
            if not any(ratio(make(text), other) >= 90 for j, other in items if j % 8 == item % 8):
                want.add((item % 8, name, item))
    assert got == want
    assert not own.where(F.col("variant").isin("reordered", "shouted")).count() and own.where("variant = 'halved'").count() == len(items)

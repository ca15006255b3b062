"""Staged writes against a row-by-row restatement."""

import random

from lodestrata.functions import policy
from lodestrata.operators import stewardship as S
from pyspark.sql import functions as F

EMPTY = (None, "", "0", " ")


def serial(masters, incoming, pending):
    """As one goes through the rows in order."""
    live, asked = dict(masters), {}
    for m, f, v in pending:
        asked.setdefault((m, f), set()).add(v.lower())
    out = set()
    for seq, m, values in sorted(incoming):
        for f, new in values.items():
            old = live[m, f]
            if new in EMPTY or (old not in EMPTY and old.lower() == new.lower()):
                continue
            waiting = asked.setdefault((m, f), set())
            if old in EMPTY and not waiting - {new.lower()}:
                out.add((seq, m, f, old, new, "fill"))
                live[m, f] = new
            else:
                out.add((seq, m, f, old, new, "covered" if new.lower() in waiting else "conflict"))
                waiting.add(new.lower())
    return out


def test_proposals_are_those_of_going_row_by_row(spark):
    rnd = random.Random(4)
    value = lambda: rnd.choice(["", None, "0", "A", "a", "B", "C"])
    masters = {(m, f): value() for m in range(12) for f in "xy"}
    incoming = [(s, rnd.randrange(12), {f: value() for f in "xy"}) for s in range(150)]
    pending = [(m, f, rnd.choice("ABC")) for m in range(0, 12, 3) for f in "xy" for _ in range(rnd.randint(0, 2))]
    m = spark.createDataFrame([(i, masters[i, "x"], masters[i, "y"]) for i in range(12)], "master_id long, x string, y string")
    i = spark.createDataFrame([(s, k, v["x"], v["y"]) for s, k, v in incoming], "seq long, master_id long, x string, y string")
    p = spark.createDataFrame(pending, "master_id long, field string, new string")
    found = {tuple(r) for r in S.proposals(m, i, p, ["x", "y"]).select("seq", "master_id", "field", "old", "new", "action").collect()}
    assert found == serial(masters, incoming, pending)


def test_better_text(spark):
    long_en, long_de = "the company is a maker of the best tools and it offers them", "das Unternehmen ist ein Hersteller der besten Werkzeuge und bietet sie auf dem Markt mit Rat an"
    cases = [(None, "new", "new"), ("old", "", None), ("old", None, None), ("good tools for all", "good tools for  all", None), (long_en, long_de, long_en), ("tools", "tools for woodwork and metal", "tools for woodwork and metal"), ("tools for woodwork and metal", "machines", "tools for woodwork and metal")]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    assert [r[0] for r in rows.orderBy("k").select(policy.better_text(F.col("a"), F.col("b"))).collect()] == [c for _, _, c in cases]


def test_torn_lists_are_put_together(spark):
    cases = [(list("['Deeptech', 'KI']"), ["Deeptech", "KI"]), (["AI", " ", "Bio"], ["AI", "Bio"]), (None, []), ([], []), (["a", "b", "c"], ["a", "b", "c"])]
    rows = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(cases)], "k int, a array<string>")
    assert [r[0] for r in rows.orderBy("k").select(policy.string_list(F.col("a"))).collect()] == [c for _, c in cases]


def test_names_that_cannot_be_one(spark):
    bad = ["Sparkasse Ulm", "Industrie 4.0: Wie es geht", "Was nun?", "A, B, C", "10 Startups", "Startups aus Bayern", "Dr. Eva Muster", "Siemens"]
    good = ["Deep Drive", "Alpha, Inc", "", None, "Sparkassenring"]
    rules = {"institutions": ["sparkasse"], "incumbents": ["siemens"], "headline": r"\d+ startups", "collective": r"startups aus", "title": r"\b(?:dr|prof)\. "}
    rows = spark.createDataFrame([(k, n) for k, n in enumerate([*bad, *good])], "k int, n string")
    assert [r[0] for r in rows.orderBy("k").select(policy.implausible_name(F.col("n"), **rules)).collect()] == [True] * len(bad) + [False] * len(good)

"""Numbers, running sums and places in a total order, and the pairs of companies, against plain Python."""

import itertools
import random
import statistics

from lodestrata import config as C
from lodestrata import plans
from lodestrata.operators import matching as M
from lodestrata.operators import ordering as O
from lodestrata.operators import quality as Q
from pyspark.sql import functions as F


def test_numbers_and_running_sums(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.randrange(100)) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    got = sorted(map(tuple, O.running(O.numbered(df, ["v", "k"]), ["v", "k"], {"total": F.col("v")}).select("v", "k", "line", "total").collect()))
    order = sorted((v, k) for k, v in rows)
    assert got == [(v, k, i, t) for (v, k), i, t in zip(order, range(1, 501), itertools.accumulate(v for v, _ in order), strict=True)]
    assert O.numbered(df.limit(0), ["v", "k"]).count() == 0


def test_places_in_groups(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), k, rnd.randrange(9)) for k in range(200)]
    got = O.placed(spark.createDataFrame(rows, "g string, k long, v long"), ["g"], ["v", "k"])
    want = {}
    for g, k, v in rows:
        want.setdefault(g, []).append((v, k))
    assert {r["k"]: (r["place"], r["n"]) for r in got.collect()} == {k: (i, len(x)) for x in want.values() for i, (_, k) in enumerate(sorted(x), 1)}


def test_latency_has_no_window_over_a_group(spark, capsys):
    rnd = random.Random(3)
    rows = [(g, rnd.choice([None, round(rnd.random() * 9, 3)])) for g in "aab" for _ in range(60)] + [("c", 4.0), (None, 1.0), (None, 2.0), ("d", None)]
    got = {r["g"]: r for r in Q.latency(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    for g in ("a", "b", "c", None):
        v = sorted(x for h, x in rows if h == g and x is not None)
        place = max(1.0, min(len(v), 0.9 * (len(v) + 1)))
        low = int(place + 1e-9)
        p90 = v[low - 1] if low == len(v) else v[low - 1] * (1 - place + low) + v[low] * (place - low)
        assert (got[g]["n"], got[g]["least"], got[g]["most"]) == (sum(h == g for h, _ in rows), v[0], v[-1])
        assert abs(got[g]["median"] - statistics.median(v)) < 1e-4 and abs(got[g]["p90"] - p90) < 1e-4
    assert (got["d"]["n"], got["d"]["p90"]) == (1, None)


def test_no_window_without_a_key_sees_all_rows(spark, sf_dir, capsys):
    """What is left of windows in one task has a row a partition."""
    for name in ("review_export", "expectations", "latency_stats", "numbered_sequences"):
        capsys.readouterr()
        plans.QUERIES[name](spark, sf_dir).explain()
        plan = capsys.readouterr().out
        assert "SinglePartition" not in plan or "lode_part" in plan, name


def test_company_pairs_lose_none(spark):
    """All pairs that the rule takes, over names of few letters, generic words and a word that most of them have."""
    rnd = random.Random(4)
    generic = ["group", "gmbh", "tech"]
    words = ["solar", "sun", "ab", "a", "x", "nova", "novar", "works", *generic]
    name = lambda: " ".join(["solar"] * (rnd.random() < 0.5) + rnd.choices(words, k=rnd.randint(1, 3)))
    rows = [(k, name(), rnd.choice(["Ulm", "Bonn", None]), None, None) for k in range(120)]
    df = spark.createDataFrame(rows, "k long, name string, city string, lat double, lon double")
    got = {tuple(r) for r in M.company_pairs(df, "k", "name", "city", "lat", "lon", generic).collect()}
    a = df.select(F.col("k").alias("a"), M.normalize_name(F.col("name")).alias("n"), F.col("city").alias("ca"))
    b = df.select(F.col("k").alias("b"), M.normalize_name(F.col("name")).alias("m"), F.col("city").alias("cb"))
    none = F.lit(None).cast("double")
    place = M.same_place(F.col("ca"), F.col("cb"), none, none, none, none)
    # the rule takes the lesser name first, as the operator does
    least, most = F.least("n", "m"), F.greatest("n", "m")
    want = a.crossJoin(b).where("a < b").where(M.same_company(least, most, place, generic))
    assert got == {(r["a"], r["b"]) for r in want.collect()} and len(got) > 100 and C.SAME_CITY_THRESHOLD < C.FUZZY_THRESHOLD

"""Operators of entity resolution against brute force."""

import random

import pytest
from lodestrata import plans
from lodestrata.operators import matching
from lodestrata.operators import quality as Q
from pyspark.sql import functions as F


def test_candidates(spark):
    """Nearest records and those of the domain, each once; names only where both are empty."""
    schema = "id long, name string, website string, embedding array<float>"
    records = [(i, f"firm {i}", f"https://www.s{i % 4}.com/x", [1.0, i / 10]) for i in range(30)] + [(50, "Alpha Works GmbH", None, None), (51, None, "x.com", None)]
    incoming = [(1, "a", "s1.com", [1.0, 0.0]), (2, "b", None, [0.0, 1.0]), (3, "c", "s2.com", None), (4, "Works Alpha", None, None), (5, None, None, None), (6, "zzz", "https://x.com", None)]
    found = matching.candidates(spark.createDataFrame(records, schema), spark.createDataFrame(incoming, schema)).collect()
    got = {}
    for r in found:
        assert (r["query_id"], r["id"]) not in got
        got[r["query_id"], r["id"]] = r["similarity"]
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 6)
    want = {(3, i): 0.0 for i in range(30) if i % 4 == 2} | {(4, 50): 0.0} | {(1, i): 0.0 for i in range(30) if i % 4 == 1}
    for q, vector in ((1, [1.0, 0.0]), (2, [0.0, 1.0])):
        want |= {(q, i): s for s, i in sorted(((cos(vector, r[3]), r[0]) for r in records if r[3]), key=lambda x: (-x[0], x[1]))[:10]}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)


def test_candidates_of_all_customers(spark, sf_dir):
    """No customer of a nation's site is left out."""
    found = {(r["query_id"], r["id"]) for r in plans.QUERIES["match_candidates"](spark, sf_dir).collect()}
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").collect()
    assert {(r["c_nationkey"], r["c_custkey"]) for r in customers if r["c_nationkey"] % 5} <= found


@pytest.mark.parametrize("order", ["down", "random"])
def test_long_chains_are_one_component(spark, order):
    chain = [1, *range(200, 1, -1)] if order == "down" else random.Random(4).sample(range(1, 201), 200)
    links = spark.createDataFrame([*zip(chain, chain[1:]), (300, 301), (400, 400)], "a long, b long")
    found = {r["node"]: r["component"] for r in matching.connected(links, "a", "b").collect()}
    assert found == {i: 1 for i in range(1, 201)} | {300: 300, 301: 300, 400: 400}


def test_headlines_are_judged_by_the_whole_name(spark):
    names = ["Acme", "a " * 7, "x" * 46, "Acme Works.", "x" * 70 + "!"]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    assert [r[0] for r in rows.orderBy("i").select(Q.headline_like(F.col("name"))).collect()] == [False, True, True, True, True]


def test_greedy_keepers(spark, capsys):
    """As one goes through the rows in order, with ties and NULL; no window over all rows."""
    rnd = random.Random(8)
    rows = [(i, rnd.choice([None, 1, 2, 3])) for i in range(40)]
    links = [tuple(rnd.sample(range(40), 2)) for _ in range(60)]
    keepers = {}
    for i, _ in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[0])):
        near = [k for k in keepers if keepers[k] == k and ((i, k) in links or (k, i) in links)]
        keepers[i] = near[0] if near else i
    found = matching.greedy_keepers(spark.createDataFrame(rows, "id long, v int"), "id", spark.createDataFrame(links, "a long, b long"), "a", "b", [F.col("v")])
    assert {r["id"]: r["keeper"] for r in found.collect()} == keepers
    found.explain()
    assert "Window" not in capsys.readouterr().out


def _ratio(a, b):
    a, b = (" ".join(sorted(x.lower().split())) for x in (a, b))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return round(200 * row[-1] / (len(a) + len(b)), 4)


@pytest.mark.parametrize("least", [88.0, 80.0, 70.0, 95.0])
def test_name_pairs_miss_none(spark, least):
    """All pairs, also such that share no word."""
    rnd = random.Random(11)
    names = ["Deep-Drive", "DeepDrive", "muellermaschinen", "muellermaschinenn", "abcd", "abce", "Alpha Beta", "Beta Alpha"]
    for _ in range(60):
        base = "".join(rnd.choices("abcde ", k=rnd.randint(4, 20))).strip() or "abba"
        names.append(base)
        for _ in range(2):
            x = list(base)
            for _ in range(rnd.randint(1, 4)):
                at = rnd.randrange(len(x) + 1)
                x[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "a", "e"])
            names.append("".join(x))
    names = [n for n in dict.fromkeys(names) if len(" ".join(n.split())) >= 4]
    rows = list(enumerate(" ".join(n.split()) for n in names))
    want = {(i, j): r for i, a in rows for j, b in rows if i < j and (r := _ratio(a, b)) >= least}
    left = spark.createDataFrame(rows, "a long, name string")
    found = {(r["a"], r["b"]): r["ratio"] for r in matching.name_pairs(left, left.withColumnRenamed("a", "b"), "a", "b", "name", least, within=True).collect()}
    assert found == want
    if least == 88.0:
        assert want[0, 1] > 88
        both = {(r["a"], r["b"]) for r in matching.name_pairs(left, left.withColumnRenamed("a", "b"), "a", "b", "name", least).collect()}
        assert both == want.keys() | {(j, i) for i, j in want} | {(i, i) for i, _ in rows}


def test_evidence_of_short_turns(spark, tmp_path):
    """Turns of fewer than three words on either side, against the SQL."""
    import duckdb

    texts = ["one two three", "Auxment éé oitionen.", "one two three four", "one two three", "a b", "", None, "x y z", None]
    turns = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string")
    turns.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = plans.QUERIES["match_evidence"](spark, str(tmp_path)).orderBy("turn").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(f"SELECT turn, overlap FROM ({plans.ORACLES['match_evidence']}) ORDER BY turn").fetchall()
    assert [(r["turn"], r["overlap"]) for r in got] == want
    assert [x for _, x in want] == [None, 0.0, 0.5, None, None, None, 0.0, None]


def test_points_and_buildings_of_one_place_are_looked_at_once(spark):
    """Many rows of few places: the same picks as pair by pair, and equal places are one before the join."""
    from math import asin, cos, radians, sin, sqrt

    rnd = random.Random(3)
    spots = [(48.0 + rnd.randrange(6) * 0.0001, 10.0 + rnd.randrange(4) * 0.0002) for _ in range(40)]
    names = ["Alpha GmbH", "Beta", "alpha", None, ""]
    points = [(i, rnd.choice(names), *rnd.choice(spots)) for i in range(80)] + [(900, "Solo", 49.0, 10.0), (901, "Pair", 50.0, 10.0)]
    buildings = [(1000 + i, rnd.choice(names), *rnd.choice(spots)) for i in range(90)] + [(2000, None, 49.0001, 10.0), (2001, None, 50.0001, 10.0), (2002, None, 50.0001, 10.0)]
    found = matching.spatial_match(spark.createDataFrame(points, "point_id long, name string, lat double, lon double"), spark.createDataFrame(buildings, "osm_id long, building_name string, blat double, blon double"))
    core = lambda n: (n or "").lower().removesuffix(" gmbh")

    def metres(a, b, c, d):
        h = sin((radians(c) - radians(a)) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin((radians(d) - radians(b)) / 2) ** 2
        return 2 * 6371.0 * asin(sqrt(min(h, 1.0))) * 1000

    want = {}
    for i, name, lat, lon in points:
        near = sorted((o, metres(lat, lon, x, y), n) for o, n, x, y in buildings if metres(lat, lon, x, y) <= 40)
        named = [(o, m) for o, m, n in near if core(n) == core(name) != ""]
        if named:
            want[i] = (*named[0], "name_match")
        elif len(near) == 1 and near[0][1] <= 15:
            want[i] = (*near[0][:2], "unambiguous_nearest")
    got = {r["point_id"]: (r["osm_id"], r["distance_m"], r["method"]) for r in found.collect()}
    assert got.keys() == want.keys() and 900 in got and 901 not in got
    assert all(got[i][0] == o and got[i][2] == m and abs(got[i][1] - d) < 0.06 for i, (o, d, m) in want.items())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join", plan.index("distance_m")) < plan.index("Aggregate [lat")  # below the join


def test_scanned_names_are_compared_without_a_fold_for_each_pair(spark):
    """A fold over letters for each pair of names took a hundred times as long (F18)."""
    schema = "id long, name string, website string, embedding array<double>"
    names = spark.createDataFrame([(1, "Gamma Alpha GmbH", None, None), (2, "Alpha Gamma", None, None), (3, "Zz Qq", None, None), (4, None, None, None)], schema)
    found = matching.candidates(names, spark.createDataFrame([(9, "gamma alphas", None, None)], schema))
    assert sorted(map(tuple, found.collect())) == [(9, 1, 0.0), (9, 2, 0.0)]
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()

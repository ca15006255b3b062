"""The inverted-list index against the exact way, and its writes."""

import random

import numpy as np
import pyarrow as pa
import pytest
from lodestrata import plans
from lodestrata.operators import ranking as R
from lodestrata.operators import vector_index as X
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, a third of all rows alike, rows without a direction and of another length."""
    rnd = random.Random(1)
    centres = [[rnd.gauss(0, 1) for _ in range(12)] for _ in range(15)]
    rows = [(i, "ab"[i % 2], [x + rnd.gauss(0, 0.3) for x in centres[i % 15]]) for i in range(600)]
    rows += [(1000 + i, "a", [1.0] * 12) for i in range(300)]
    rows += [(2000, "a", None), (2001, "a", [0.0] * 12), (2002, "b", [1.0]), (2003, None, [1.0] * 12)]
    return spark.createDataFrame(rows, "vec_id long, kind string, embedding array<float>").repartition(4)


def listed(df):
    return sorted(map(tuple, df.collect()))


def test_every_row_is_in_a_list(vectors):
    index = X.build(vectors)
    assert index.rows.count() == vectors.count() and index.lists == round(902**0.5)
    assert {r["vec_id"] for r in index.rows.where("list = -1").collect()} == {2000, 2001, 2002}


def test_all_lists_give_the_exact_neighbours(vectors):
    index = X.build(vectors)
    fit = vectors.where("vec_id not in (2000, 2001, 2002)")
    queries = vectors.where("vec_id % 20 = 0")
    for same in (None, ["kind"]):
        exact = R.nearest(fit, fit.where("vec_id % 20 = 0"), 5, same=same)
        assert listed(X.search(index, queries, 5, probes=index.lists, same=same)) == listed(exact)


def test_few_lists_find_nine_of_ten(vectors):
    index = X.build(vectors)
    fit = vectors.where("vec_id not in (2000, 2001, 2002)")
    q = fit.where("vec_id % 20 = 0")
    exact = R.nearest(fit, q, 10)
    got = X.recall(X.search(index, q, 10, probes=6), exact)
    assert got.count() == q.count() and got.agg(F.avg("recall")).first()[0] >= 0.9
    none = X.recall(X.search(index, q.limit(0), 10), exact)
    assert none.agg(F.max("recall")).first()[0] == 0


def test_query_reports_its_recall(spark, sf_dir):
    found = plans.QUERIES["vector_index_search"](spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 20 = 0").count()
    per = {r["query_id"]: r["recall"] for r in found.collect()}
    assert len(per) == n and sum(per.values()) / n >= 0.9 and found.count() == 10 * n


def test_upsert_moves_only_what_has_a_new_vector(spark, vectors):
    index = X.build(vectors)
    old = {r["vec_id"]: r for r in index.rows.collect()}
    changes = spark.createDataFrame([(1, "c", None), (2, None, [float(x) for x in old[500]["embedding"]]), (5000, "d", [1.0] * 12), (2000, "a", [2.0] * 12)], "vec_id long, kind string, embedding array<float>")
    new = {r["vec_id"]: r for r in X.upsert(index, changes).rows.collect()}
    assert len(new) == len(old) + 1 and (new[1]["kind"], new[1]["embedding"], new[1]["list"]) == ("c", old[1]["embedding"], old[1]["list"])
    assert (new[2]["kind"], new[2]["embedding"], new[2]["list"]) == (old[2]["kind"], old[500]["embedding"], old[500]["list"])
    assert new[5000]["list"] == new[2000]["list"] == old[1000]["list"]
    assert all(new[k] == old[k] for k in old if k not in (1, 2, 2000))
    twice = X.upsert(X.upsert(index, changes), changes)
    assert {r["vec_id"]: (r["kind"], r["embedding"], r["list"]) for r in twice.rows.collect()} == {k: (r["kind"], r["embedding"], r["list"]) for k, r in new.items()}
    labels = X.upsert(index, changes.select("vec_id", "kind"))
    assert labels.rows.where("vec_id = 5000").first()["list"] == X.NOWHERE


def test_fetch_and_delete(spark, vectors):
    index = X.build(vectors)
    ids = spark.createDataFrame([(3,), (3,), (2000,), (99_999,)], "vec_id long")
    got = X.fetch(index, ids).collect()
    assert sorted(r["vec_id"] for r in got) == [3, 2000] and "list" not in got[0].asDict()
    left = X.delete(index, ids)
    assert left.rows.count() == vectors.count() - 2 and not X.fetch(left, ids).count()


def test_no_vectors(spark, vectors):
    index = X.build(vectors.limit(0))
    assert index.lists == 0 and X.search(index, vectors, 3).count() == 0
    one = X.build(vectors.where("vec_id = 7"))
    assert one.lists == 1 and X.search(one, vectors.where("vec_id = 8"), 3).first()["id"] == 7


def test_exact_neighbours_of_odd_vectors(spark, vectors, monkeypatch):
    """All pairs in Python, in many parts: copies, ties, missing, zero and shorter vectors, filters; parts meet, not rows."""
    rows = [r.asDict() for r in vectors.collect()] + [{"vec_id": 3000, "kind": "b", "embedding": [1.0, None] + [0.0] * 10}]
    table = spark.createDataFrame(rows, "vec_id long, kind string, embedding array<float>").repartition(3)
    length = lambda v: sum(x * x for x in v) ** 0.5 if v and None not in v else 0.0

    def cosine(a, b):
        n = length(a) * length(b)
        if n == 0:
            return 0.0
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 6) if len(a) == len(b) else None

    for size in (1 << 22, 1 << 10):
        monkeypatch.setattr(R, "ROWS_PART", size)
        monkeypatch.setattr(R, "QUERIES_PART", size)
        for same in (None, ["kind"]):
            found = R.nearest(table, table.where("vec_id % 20 = 0 OR vec_id >= 2000"), 7, same=same)
            got = {}
            for r in found.collect():
                got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["similarity"]))
            for q in rows:
                if q["vec_id"] % 20 and q["vec_id"] < 2000:
                    continue
                fit = [(cosine(q["embedding"], r["embedding"]), r["vec_id"]) for r in rows if r["vec_id"] != q["vec_id"] and (not same or q["kind"] == r["kind"] and q["kind"])]
                fit.sort(key=lambda x: (x[0] is None, -(x[0] or 0.0), x[1]))
                assert sorted(got.get(q["vec_id"], [])) == [(i + 1, r, s) for i, (s, r) in enumerate(fit[:7])], (q["vec_id"], same)
            assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_neighbours_of_every_vector_are_compared(spark, sf_dir):
    ids = {r[0] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()}
    got = {r["query_id"]: r["neighbours"] for r in plans.QUERIES["compare_neighbours"](spark, sf_dir).collect()}
    assert got == dict.fromkeys(ids, 10)


def test_every_vector_is_matched(spark, sf_dir):
    ids = {r[0] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()}
    got = plans.QUERIES["reverse_match"](spark, sf_dir).groupBy("record").count().collect()
    assert dict(map(tuple, got)) == dict.fromkeys(ids, 5)


def test_products_in_single_precision_lose_no_neighbour(monkeypatch):
    """Small tiles; neighbours that single precision can't tell apart, many copies, NaN, other lengths, no direction."""
    rnd = np.random.default_rng(3)
    around = rnd.standard_normal(16)
    rows = [list(around + 10.0 ** -rnd.integers(1, 8) * rnd.standard_normal(16)) for _ in range(500)] + [[1.0] * 16] * 120
    rows += [[float("nan")] + [1.0] * 15, [float("inf")] * 16, [0.0] * 16, [1.0] * 9, [float("nan")] * 9, None, [1.0, None]]
    ids = [int(i) for i in rnd.permutation(len(rows))]
    table = lambda i, v: pa.table({i: pa.array(ids, pa.int64()), v: pa.array(rows, pa.list_(pa.float64()))})

    def cosine(a, b):
        a, b = ([] if x is None or None in x else x for x in (a, b))
        with np.errstate(invalid="ignore"):
            if not any(a) or not any(b):
                return 0.0
            return float(np.dot(a, b) / np.sqrt(np.dot(a, a)) / np.sqrt(np.dot(b, b))) if len(a) == len(b) else None

    order = lambda s: -2e6 if s is None else np.inf if s != s else np.floor(s * 1e6 + 0.5)
    for tile, close, k in (((7, 48), 20, 3), ((256, 4096), 512, 10)):
        monkeypatch.setattr(R, "TILE", tile)
        monkeypatch.setattr(R, "CLOSE", close)
        got = {}
        for r in R._best(k, [], True)(table("query_id", "qv"), table("id", "v")).to_pylist():
            got.setdefault(r["query_id"], []).append((-order(r["similarity"]), r["id"]))
        for q, a in zip(ids, rows, strict=True):
            want = sorted((-order(cosine(a, b)), i) for i, b in zip(ids, rows, strict=True) if i != q)[:k]
            assert sorted(got[q]) == want, (q, tile)

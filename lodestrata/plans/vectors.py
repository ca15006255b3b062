"""Queries over vectors: neighbours, thesis ranking, matchmaking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import cosine
from ..operators import ranking as R
from ..operators import vector_index as X
from ..scratch import written
from ..session import table
from .registry import query

#: Searches: queries are all vectors whose id is divisible by 20, against all.
_Q = "vec_id % 20 = 0"
_PAIRS = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, q.label AS ql, v.vec_id AS id, v.label, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM v, v q WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p)
"""
#: Comparisons of the whole table: every vector against all.
_ALL_PAIRS = _PAIRS.replace("q.vec_id % 20 = 0 AND ", "")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


@query(_PAIRS + "SELECT query_id, id, similarity, rank FROM k WHERE rank <= 10")
def knn_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return R.nearest(v, v.filter(_Q), 10)


@query(_PAIRS + ", f AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p WHERE label = ql) SELECT * FROM f WHERE rank <= 5")
def knn_filtered(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return R.nearest(v, v.filter(_Q), 5, same=["label"])


@query(_ALL_PAIRS + "SELECT query_id, count(*) AS neighbours, count_if(label = ql) AS alike, round(avg(similarity), 4) AS mean FROM k WHERE rank <= 10 GROUP BY query_id")
def compare_neighbours(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    near = R.nearest(v, v, 10)
    labels = v.select(F.col("vec_id").alias("id"), "label")
    own = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    in_order = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("rank", "similarity"))), lambda x: x["similarity"]), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(in_order, F.lit(0.0), lambda s, x: s + x), F.size(in_order))  # not by the order in which rows arrive
    return near.join(labels, "id").join(own, "query_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("neighbours"), F.count_if(F.col("label") == F.col("ql")).alias("alike"), F.round(mean, 4).alias("mean"))


@query(_PAIRS + """, c AS (SELECT query_id, id, rank, least(1.0, similarity * 0.5 + CASE WHEN id % 3 = 0 THEN 0.2 ELSE 0 END + CASE WHEN label IN (1, 11) OR label = 2 THEN 0.15 ELSE 0 END + 0.15) AS s FROM k WHERE rank <= 15),
r AS (SELECT query_id, id, round(s, 3) AS match_score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 3) DESC, id) AS place FROM c) SELECT query_id, id, match_score, place FROM r WHERE place <= 5""")
def match_composite(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    near = R.nearest(v, v.filter(_Q), 15).join(v.select(F.col("vec_id").alias("id"), "label"), "id")
    words = lambda *w: F.array(*map(F.lit, w))
    stage = F.when(F.col("id") % 3 == 0, "Pre-Seed").otherwise("Series B")
    score = R.match_score(F.col("similarity"), words("seed"), words("sector1", "sector2"), words("Bavaria"), stage, F.concat(F.lit("sector"), F.col("label")), F.lit(None).cast("string"), F.lit("Ulm"))
    return R.rerank(near, score, 5).select("query_id", "id", "match_score", F.col("rank").alias("place"))


@query(_ALL_PAIRS + "SELECT query_id AS record, id AS investor, round(similarity, 3) AS match_score FROM k WHERE rank <= 5")
def reverse_match(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return R.nearest(v, v, 5).select(F.col("query_id").alias("record"), F.col("id").alias("investor"), F.round("similarity", 3).alias("match_score"))


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), t AS (SELECT list(x ORDER BY i) AS c FROM (SELECT i, round(avg(e[i]), 9) AS x FROM v, generate_series(1, 64) g(i) WHERE label = 3 GROUP BY i)),
s AS (SELECT vec_id, list_cosine_similarity(e, c) AS s, label FROM v, t)
SELECT vec_id, round(s + CASE WHEN label IN (3, 4) THEN 0.18 ELSE 0 END + CASE WHEN label = 5 THEN 0.06 ELSE 0 END - CASE WHEN vec_id % 10 = 7 THEN 0.25 ELSE 0 END, 4) AS relevance FROM s""")
def thesis_rank(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    mean = v.filter("label = 3").select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    centre = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))  # as long as a vector
    thesis = {"industries": ["3", "4"], "secondary_industries": ["5"], "excluded": ["seven"]}
    text = F.when(F.col("vec_id") % 10 == 7, "number seven").otherwise("other")
    score = R.thesis_score(cosine(F.col("embedding"), F.col("c")), F.col("label").cast("string"), F.lit(None).cast("string"), text, thesis)
    return v.crossJoin(F.broadcast(centre)).select("vec_id", score.alias("relevance"))


@query()
def vector_index_search(spark, sf_dir):
    """Neighbours by the index of all vectors, with the recall of each query against the exact way beside them."""
    v = _vectors(spark, sf_dir)
    index = X.build(v)
    found = written(X.search(index, v.filter(_Q), 10), "found")
    return found.join(X.recall(found, R.nearest(v, v.filter(_Q), 10)).select("query_id", "recall"), "query_id")


@query()
def vector_index_filtered(spark, sf_dir):
    """Neighbours of the query's own label only."""
    v = _vectors(spark, sf_dir)
    return X.search(X.build(v), v.filter(_Q), 5, same=["label"])


@query("""WITH w AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN label + 100 ELSE label END AS label, CASE WHEN vec_id % 10 = 3 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS e FROM embeddings
UNION ALL SELECT vec_id + 1000000, 7, embedding FROM embeddings WHERE vec_id % 50 = 0)
SELECT vec_id, label, len(e) AS size, round(list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM w WHERE vec_id % 9 <> 1 AND vec_id IN (SELECT vec_id FROM w WHERE vec_id % 3 <> 2)""")
def vector_upsert(spark, sf_dir):
    """Vectors by key: new labels keep the vector, new vectors the label, new ids join; some are deleted, others fetched."""
    v = _vectors(spark, sf_dir)
    none = F.lit(None)
    labels = v.filter("vec_id % 4 = 0 AND vec_id % 10 <> 3").select("vec_id", (F.col("label") + 100).alias("label"), none.cast("array<float>").alias("embedding"))
    turned = v.filter("vec_id % 10 = 3").select("vec_id", F.when(F.col("vec_id") % 4 == 0, F.col("label") + 100).alias("label"), F.transform("embedding", lambda x: -x).alias("embedding"))
    more = v.filter("vec_id % 50 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), F.lit(7).alias("label"), "embedding")
    index = X.upsert(X.build(v), labels.unionByName(turned).unionByName(more))
    index = X.delete(index, index.rows.filter("vec_id % 9 = 1"))
    rows = X.fetch(index, index.rows.filter("vec_id % 3 <> 2"))
    return rows.select("vec_id", "label", F.size("embedding").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))

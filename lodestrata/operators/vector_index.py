"""Vectors by key with an inverted-list index: build, upsert, fetch, delete, search by probes with exact rerank, recall.

Centroids are fitted on a bounded sample (``sample`` rows, those with the least hash of their id); every row is assigned to the
list of its nearest centroid, by matrix products in Arrow batches. The index is a table like any other, in the order of its
lists, so that a read of some lists skips the rest by the statistics of its files. A list that holds a third of all rows is
cut by id ranges when written, and by the hash of ids when searched.

A search takes the lists of each query's ``probes`` nearest centroids and ranks their rows by the exact cosine, so what it
returns has the right similarity. How many probes that takes depends on the data: ``build`` finds the fewest that reach a
target recall on a bounded set of its own rows as queries (``tune`` of them, those next in the order of hashes). What a search does lose is
measured by ``recall`` against ``ranking.nearest``, which stays the exact way.
Rows without a vector, or with one of another length, are kept and fetched, but never near; so are rows of length zero.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import norm
from ..scratch import written
from .ranking import nearest, top_matches

#: List of rows that are near nothing.
NOWHERE = -1


@dataclass(frozen=True)
class VectorIndex:
    """``rows``: id, vector, list and the caller's own columns; ``centres``: a unit vector for each list."""

    rows: DataFrame
    centres: np.ndarray
    id_col: str = "vec_id"
    vec_col: str = "embedding"
    probes: int = 8

    @property
    def lists(self) -> int:
        return len(self.centres)

    def nearest_lists(self, vector: Column, n: int) -> Column:
        """The numbers of the ``n`` nearest lists of a vector, the nearest first; none if it has no direction."""
        centres, n = self.centres, min(n, len(self.centres))
        width = centres.shape[1] if len(centres) else 0

        def ranked(vectors: pd.Series) -> pd.Series:
            fits = np.array([v is not None and len(v) == width for v in vectors], bool)
            out = np.full(len(vectors), None, object)
            if fits.any():
                x = np.stack([np.asarray(v, np.float32) for v in vectors[fits]])
                length = np.linalg.norm(x, axis=1)
                fit = x @ centres.T
                near = (np.argmax(fit, axis=1)[:, None] if n == 1 else np.argsort(-fit, axis=1, kind="stable")[:, :n]).astype(np.int32)
                for at, row, size in zip(np.flatnonzero(fits), near, length, strict=True):
                    out[at] = row if size > 0 and np.isfinite(size) else None
            return pd.Series(out)

        return F.coalesce(F.pandas_udf(ranked, "array<int>")(vector), F.array().cast("array<int>"))


def _ordered(index: VectorIndex, rows: DataFrame) -> DataFrame:
    at = rows.withColumn("list", F.coalesce(F.get(index.nearest_lists(F.col(index.vec_col), 1), 0), F.lit(NOWHERE)))
    return written(at.repartitionByRange("list", index.id_col).sortWithinPartitions("list"), "vectors")


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None, sample: int = 20_000, seed: int = 0, target: float = 0.95, tune: int = 100) -> VectorIndex:
    """The index of all rows; by default about as many lists as the root of their number, 4,096 at most. Its number of
    probes reaches a recall of ``target`` for the 10 nearest of ``tune`` queries."""
    v = vectors.where(F.col(vec_col).isNotNull() & (norm(F.col(vec_col)) > 0))
    sizes = v.groupBy(F.size(vec_col).alias("width")).count().orderBy(F.desc("count"), "width").first()
    width, n = sizes or (0, 0)  # the length of most vectors is that of all
    v = v.where(F.size(vec_col) == width)
    chosen = v.select(id_col, vec_col).orderBy(F.xxhash64(id_col), id_col).limit(sample)  # a bounded top, not a sort of all
    if not n:
        return VectorIndex(written(vectors.withColumn("list", F.lit(NOWHERE)), "vectors"), np.zeros((0, 0), np.float32), id_col, vec_col)
    k = max(1, min(lists or min(4096, round(n**0.5)), n, sample))
    points = written(chosen.select(array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))).alias("features")), "sample")
    centres = np.array(KMeans(k=k, seed=seed, maxIter=15, distanceMeasure="cosine").fit(points).clusterCenters() if k > 1 else [points.first()["features"].toArray()], np.float32)
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-30)
    empty = VectorIndex(vectors, centres, id_col, vec_col)
    index = replace(empty, rows=_ordered(empty, vectors))
    asked = v.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(tune)
    return replace(index, probes=_fewest_probes(index, v, asked, target))


def _fewest_probes(index: VectorIndex, vectors: DataFrame, queries: DataFrame, target: float) -> int:
    """One exact pass: in which of a query's lists, in their order, do its neighbours lie?"""
    exact = nearest(vectors, queries, 10, index.id_col, index.vec_col).select("query_id", "id")
    order = queries.select(F.col(index.id_col).alias("query_id"), index.nearest_lists(F.col(index.vec_col), index.lists).alias("order"))
    lies = index.rows.select(F.col(index.id_col).alias("id"), "list")
    found = exact.join(order, "query_id").join(lies, "id").groupBy(F.array_position("order", F.col("list")).alias("place")).count()
    counts = np.zeros(index.lists + 1, np.int64)
    for place, n in found.collect():  # a row for each list at most
        counts[place] += n
    return max(1, int(np.searchsorted(np.cumsum(counts), target * counts.sum())))


def upsert(index: VectorIndex, changes: DataFrame) -> VectorIndex:
    """A new snapshot: rows of ``changes`` replace those of their id or join them; a NULL in a change, its vector too, keeps what is stored.

    Ids are distinct on both sides. Only rows with a new vector are assigned anew.
    """
    own = [c for c in index.rows.columns if c not in (index.id_col, "list")]
    new = changes.select(index.id_col, *[F.col(c).alias(f"lode_{c}") for c in own if c in changes.columns], F.lit(True).alias("lode_new"))
    merged = index.rows.join(new, index.id_col, "full")
    kept = [F.coalesce(f"lode_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in own]
    fresh = F.col(f"lode_{index.vec_col}").isNotNull() if index.vec_col in changes.columns else F.lit(False)
    rows = merged.select(index.id_col, *kept, "list", F.coalesce(fresh, F.lit(False)).alias("lode_fresh"))
    at = F.when(F.col("lode_fresh"), F.get(index.nearest_lists(F.when(F.col("lode_fresh"), F.col(index.vec_col)), 1), 0)).otherwise(F.col("list"))
    rows = rows.withColumn("list", F.coalesce(at, F.lit(NOWHERE))).drop("lode_fresh").select(index.rows.columns)
    return replace(index, rows=written(rows.repartitionByRange("list", index.id_col).sortWithinPartitions("list"), "vectors"))


def delete(index: VectorIndex, ids: DataFrame) -> VectorIndex:
    return replace(index, rows=written(index.rows.join(ids.select(index.id_col).distinct(), index.id_col, "left_anti"), "vectors"))


def fetch(index: VectorIndex, ids: DataFrame) -> DataFrame:
    """The stored rows of a batch of ids, vectors and all."""
    return index.rows.join(ids.select(index.id_col).distinct(), index.id_col, "left_semi").drop("list")


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, same: list[str] | None = None, without_self: bool = True) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` most similar rows in each query's nearest lists by cosine, ties by id.

    ``same`` names payload columns that must be equal on both sides. Queries meet the rows of their lists as in ``ranking.nearest``.
    """
    same = same or []
    q = queries.select(F.col(index.id_col).alias("query_id"), F.col(index.vec_col).alias("qv"), *same, F.explode(index.nearest_lists(F.col(index.vec_col), probes or index.probes)).alias("list"))
    rows = index.rows.where(F.col("list") != NOWHERE).select("list", *same, F.col(index.id_col).alias("id"), F.col(index.vec_col).alias("v"))
    return top_matches(q, rows, k, ["list"], same, without_self)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, expected, hit, recall): the share of each query's exact neighbours that a search found. A neighbour as
    similar as the last exact one counts, since ties are many where vectors repeat."""
    last = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("expected"), F.min("similarity").alias("least"))
    hit = found.join(last, "query_id").where("similarity >= least").groupBy("query_id").agg(F.count(F.lit(1)).alias("hit"))
    hits = F.least(F.coalesce("hit", F.lit(0)), "expected")
    return last.join(hit, "query_id", "left").select("query_id", "expected", hits.alias("hit"), F.round(hits / F.col("expected"), 4).alias("recall"))

"""Nearest neighbours, thesis ranking and matchmaking.

Exact neighbours are found by matrix products: corpus and queries are cut into parts by the hash of their ids, Spark brings each pair
of parts together, and a task that holds one pair leaves the ``k`` best rows of each of its queries. Products in single precision
leave the few rows that may be among the best by the bound of their error; those are compared in doubles. So what moves is a copy of the
queries for each part of the corpus and of the corpus for each part of the queries, and k rows a query and part, never a row for
each pair. The number of products is that of all pairs; a task's memory is bounded by the sizes of the parts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import keyword_hits

#: Numbers in a part of the corpus, in a part of the queries, and in a table of doubles that a task makes at once.
ROWS_PART, QUERIES_PART, AT_ONCE = 1 << 23, 1 << 23, 1 << 21
#: Products that are worth a task of their own; tasks for each core of the cluster, where there are products enough.
WORTH, TASKS = 1 << 24, 6
#: Queries and rows of a product in single precision; rows that share one maximum, at most; rows of a query (or 16 k) that are compared in doubles one by one.
TILE, SHARE, CLOSE = (256, 4096), 16, 512


class _Vectors:
    """A column of vectors: lengths (-1: no vector, or one with a NULL in it) and norms; ``rows`` and ``units`` have zeros for all of other lengths."""

    def __init__(self, column: pa.ChunkedArray):
        array = column.combine_chunks()
        array = pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array
        self.width = pc.fill_null(pc.list_value_length(array), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(np.maximum(self.width, 0))
        values = array.flatten()
        if values.null_count:
            owner = np.searchsorted(ends, np.flatnonzero(values.is_null().to_numpy(zero_copy_only=False)), side="right")
            keep = np.ones(len(values), bool)
            for o in np.unique(owner):
                keep[ends[o] - self.width[o] : ends[o]] = False
                self.width[o] = -1
            values = values.filter(pa.array(keep))
        values = values.to_numpy(zero_copy_only=False)
        self.values = values if values.dtype in (np.float32, np.float64) else values.astype(np.float64)
        self.starts = np.cumsum(np.maximum(self.width, 0)) - np.maximum(self.width, 0)
        self.norm = np.zeros(len(self.width))
        for w in np.unique(self.width):
            if w > 0:
                for at in _slices(np.flatnonzero(self.width == w), AT_ONCE // w):
                    self.norm[at] = np.sqrt(_sums(self.rows(at, int(w)), None))

    def rows(self, at: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(at), max(width, 0)))
        if width > 0:
            fit = np.flatnonzero(self.width[at] == width)
            out[fit] = self.values[self.starts[at[fit]][:, None] + np.arange(width)]
        return out

    def units(self, at: np.ndarray, width: int, kind: type) -> np.ndarray:
        """Rows by their norms."""
        out, done = np.empty((len(at), max(width, 0)), kind), 0
        for some in _slices(at, AT_ONCE // max(1, width)):
            with np.errstate(invalid="ignore"):
                out[done : done + len(some)] = self.rows(some, width) / np.where(self.norm[some] > 0, self.norm[some], 1)[:, None]
            done += len(some)
        return out


def _slices(at: np.ndarray, step: int):
    step = max(1, int(step))
    return (at[i : i + step] for i in range(0, len(at), step))


def _sums(a: np.ndarray, b: np.ndarray | None) -> np.ndarray:
    """Sums of products row by row, added up in the order of the columns."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * (a if b is None else b)[:, i]
    return total


def _top(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ``k`` greatest of each row, of equals the first; -inf is never taken."""
    n = score.shape[1]
    if n <= k:
        return np.nonzero(score > -np.inf)
    least = np.partition(score, n - k, axis=1)[:, n - k, None]
    kept = score >= least
    for i in np.array_split(np.flatnonzero(kept.sum(axis=1) > k), max(1, len(score) // 64)):
        if len(i):  # too many equals at the end
            equal = score[i] == least[i]
            room = k - (score[i] > least[i]).sum(axis=1, keepdims=True)
            kept[i] &= ~equal | (np.cumsum(equal, axis=1, dtype=np.int32) <= room)
    kept &= score > -np.inf
    return np.nonzero(kept)


def _close(a: np.ndarray, b: np.ndarray, k: int, hide: Callable[[np.ndarray, int, int, int], None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column numbers of all products of unit vectors that may be among the ``k`` greatest of their row when they are computed in doubles
    and rounded to six digits, and the rows that have too many of these. ``hide`` puts what holds besides into a tile of products."""
    (n, width), close = b.shape, max(CLOSE, 16 * k)
    share = max(1, min(SHARE, n // (16 * k)))
    groups = -(-min(TILE[1], n) // share)
    tile = np.empty((min(TILE[0], len(a)), groups * share), np.float32)
    margin = np.float32((width + 8) * 2.0**-23 + 1.1e-6)  # twice the error of a product, and the step of the rounding
    found, over = [], []
    for top in range(0, len(a), TILE[0]):
        rows = min(TILE[0], len(a) - top)
        greatest, least = np.full((rows, k), -np.inf, np.float32), np.full(rows, -np.inf, np.float32)
        many, mine = np.zeros(rows, np.int64), []
        for left in range(0, n, groups * share):
            cols = min(groups * share, n - left)
            some = tile[:rows]
            np.matmul(a[top : top + rows], b[left : left + cols].T, out=some[:, :cols])
            some[:, cols:] = -np.inf
            hide(some, top, left, cols)
            some = some.reshape(rows, share, groups)
            most = some.max(axis=1)
            news = np.flatnonzero(most.max(axis=1) >= least)
            if not len(news):
                continue
            both = np.concatenate([greatest[news], most[news]], axis=1)
            greatest[news] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            least[news] = np.where(many[news] > close, np.inf, greatest[news].min(axis=1) - margin)
            i, group = np.nonzero(most[news] >= least[news, None])
            score = some[news[i], :, group]
            hit, at = np.nonzero((score >= least[news[i], None]) & (score > -np.inf))
            mine.append((news[i[hit]], left + at * groups + group[hit], score[hit, at]))
            many += np.bincount(mine[-1][0], minlength=rows)
        if mine:
            i, c, score = (np.concatenate(x) for x in zip(*mine, strict=True))
            last = greatest.min(axis=1) - margin
            kept = (many[i] <= close) & (score >= last[i])
            found.append((top + i[kept], c[kept]))
        over.append(top + np.flatnonzero(many > close))
    none = np.zeros(0, np.int64)
    return *(np.concatenate([none, *(f[x] for f in found)]) for x in (0, 1)), np.concatenate([none, *over])


def _best(k: int, same: list[str], without_self: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a part of the queries and one of the corpus: (query_id, id, similarity) of the ``k`` best rows of each query."""
    far = -1e30  # of another length: after all that have a similarity

    def found(qi: np.ndarray, vi: np.ndarray, q: _Vectors, v: _Vectors, qid: np.ndarray, vid: np.ndarray):
        for width in map(int, np.unique(q.width[qi])):
            asked = qi[q.width[qi] == width]
            odd = (v.width[vi] != width) & (v.norm[vi] != 0)
            low, high = (np.searchsorted(vid[vi], qid[asked], side) if without_self else np.zeros(len(asked), np.int64) for side in ("left", "right"))
            plain = ~((q.norm[asked] > 0) & np.isfinite(q.norm[asked]))
            quick = np.flatnonzero(~plain)
            if len(quick):
                b = v.units(vi, width, np.float32)
                bad = np.flatnonzero(~np.isfinite(b).all(axis=1))  # NaN to all, so before all others
                b[bad] = 0
                aside = np.flatnonzero(odd)

                def hide(some: np.ndarray, top: int, left: int, cols: int) -> None:
                    some[:, aside[(aside >= left) & (aside < left + cols)] - left] = far
                    some[:, bad[(bad >= left) & (bad < left + cols)] - left] = -np.inf
                    own, end = (x[quick[top : top + len(some)]] - left for x in (low, high))
                    for i in range(int((end - own).max(initial=0))):
                        at = np.flatnonzero((own + i < end) & (own + i >= 0) & (own + i < cols))
                        some[at, own[at] + i] = -np.inf

                r, c, over = _close(q.units(asked[quick], width, np.float32), b, k, hide)
                plain[quick[over]] = True
                for i in bad[: k + int((high - low).max(initial=0))]:
                    at = np.setdiff1d(np.flatnonzero((low[quick] > i) | (high[quick] <= i)), over)
                    r, c = np.concatenate([r, at]), np.concatenate([c, np.full(len(at), i)])
                r = quick[r]
                cosine = np.zeros(len(r))
                for at in _slices(np.arange(len(r)), AT_ONCE // max(1, width)):
                    cosine[at] = similarity(q, v, asked[r[at]], vi[c[at]], width)
                score = np.where(odd[c], far, rounded(cosine))
                order = np.lexsort((c, -score, r))
                r, c = r[order], c[order]
                first = np.flatnonzero(np.diff(r, prepend=-1))
                kept = np.arange(len(r)) - np.repeat(first, np.diff(first, append=len(r))) < k
                r, c, cosine = r[kept], c[kept], cosine[order][kept]
                yield asked[r], vi[c], cosine, odd[c]
            if plain.any():
                yield from every(np.flatnonzero(plain), asked, vi, q, v, width, odd, low, high)

    def every(plain: np.ndarray, asked: np.ndarray, vi: np.ndarray, q: _Vectors, v: _Vectors, width: int, odd: np.ndarray, low: np.ndarray, high: np.ndarray):
        """The same where many rows are equally near: all products in doubles."""
        unit_b = v.units(vi, width, np.float64).T
        for some in _slices(plain, AT_ONCE // max(1, len(vi))):
            rows = asked[some]
            score = rounded(q.units(rows, width, np.float64) @ unit_b)
            score[np.ix_(q.norm[rows] != 0, odd)] = far
            score[:, v.norm[vi] == 0] = score[q.norm[rows] == 0] = 0
            for i in np.flatnonzero(high[some] > low[some]):
                score[i, low[some[i]] : high[some[i]]] = -np.inf
            r, c = _top(score, k)
            yield rows[r], vi[c], similarity(q, v, rows[r], vi[c], width), score[r, c] == far

    def rounded(score: np.ndarray) -> np.ndarray:
        score = np.floor(score * 1e6 + 0.5)
        score[np.isnan(score)] = np.inf  # as Spark orders them
        return score

    def similarity(q: _Vectors, v: _Vectors, qs: np.ndarray, vs: np.ndarray, width: int) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            lengths = v.norm[vs] * q.norm[qs]
            none = (lengths == 0) | (v.norm[vs] == 0) | (q.norm[qs] == 0)
            return np.where(none, 0.0, _sums(v.rows(vs, width), q.rows(qs, width)) / lengths)

    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        qid, vid = queries["query_id"].to_numpy(), rows["id"].to_numpy()
        q, v = _Vectors(queries["qv"]), _Vectors(rows["v"])
        order = np.argsort(vid, kind="stable")  # of equals the lesser id is the first
        groups = [(np.arange(len(qid)), order)]
        if same:
            both = pd.concat([queries.select(same).to_pandas(), rows.select(same).to_pandas()], ignore_index=True)
            code = both.groupby(same, sort=False, dropna=True).ngroup().to_numpy()  # -1: NULL equals nothing
            cq, cv = code[: len(qid)], code[len(qid) :][order]
            by_q, by_v = np.argsort(cq, kind="stable"), np.argsort(cv, kind="stable")
            cut = lambda codes, by, c: by[np.searchsorted(codes[by], c, "left") : np.searchsorted(codes[by], c, "right")]
            groups = [(cut(cq, by_q, c), order[cut(cv, by_v, c)]) for c in np.intersect1d(cq, cv) if c >= 0]
        parts = [x for qi, vi in groups if len(qi) and len(vi) for x in found(qi, vi, q, v, qid, vid)]
        take = lambda i: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64)
        cosine = pa.array(take(2).astype(np.float64), mask=take(3).astype(bool))
        return pa.table({"query_id": queries["query_id"].take(pa.array(take(0))), "id": rows["id"].take(pa.array(take(1))), "similarity": cosine})

    return best


def top_matches(q: DataFrame, v: DataFrame, k: int, on: list[str], same: list[str], without_self: bool) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` best rows of ``v`` (id, v) for each query of ``q`` (query_id, qv) among those that are equal in
    ``on`` and ``same``. Parts are made within each group of ``on``, so large groups are shared out."""
    q, v = q.filter("query_id IS NOT NULL"), v.filter("id IS NOT NULL")
    if not on:
        on = ["lode_all"]
        q, v = q.withColumn("lode_all", F.lit(0)), v.withColumn("lode_all", F.lit(0))
    size = lambda d, c, n: d.groupBy(*on).agg(F.count(F.lit(1)).alias(n), F.greatest(F.max(F.size(c)), F.lit(1)).alias(f"{n}w"))
    wide = F.greatest("nqw", "nvw").cast("double")
    most = TASKS * v.sparkSession.sparkContext.defaultParallelism if on == ["lode_all"] else 1
    tasks = F.least(F.lit(float(most)), F.col("nq") * F.col("nv") * wide / WORTH)
    sizes = size(q, "qv", "nq").join(size(v, "v", "nv"), on)
    pv = F.ceil(F.greatest(F.col("nv") * wide / ROWS_PART, F.least(tasks, F.sqrt(tasks * F.col("nv") / F.col("nq")))))  # the fewest copies
    sizes = sizes.select(*on, F.ceil(F.greatest(F.col("nq") * wide / QUERIES_PART, tasks / pv)).alias("lode_pq"), pv.alias("lode_pv"))
    sizes = F.broadcast(sizes)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = [*on, "lode_i", "lode_j"]
    own = [F.col(c).alias(c) for c in same]  # new columns, as both sides may come from one table
    qs = q.join(sizes, on).select("query_id", "qv", *own, *on, part("query_id", "lode_pq").alias("lode_i"), every("lode_pv").alias("lode_j"))
    vs = v.join(sizes, on).select("id", "v", *same, *on, every("lode_pq").alias("lode_i"), part("id", "lode_pv").alias("lode_j"))
    types = dict(q.dtypes)["query_id"], dict(v.dtypes)["id"]
    if on == ["lode_all"]:  # parts are few and large: a task for each
        qs, vs = (d.repartition(2 * most, *keys) for d in (qs, vs))
    scored = qs.groupBy(*keys).cogroup(vs.groupBy(*keys)).applyInArrow(_best(k, same, without_self), f"query_id {types[0]}, id {types[1]}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    ranked = scored.withColumn("similarity", F.round("similarity", 6)).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)


def nearest(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", same: list[str] | None = None, without_self: bool = True) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` most similar vectors of each query by cosine, exact, ties by id.

    ``same`` names columns that must be equal on both sides (a filter before the top-k). The similarity is 0 where a side has no
    vector or no length, and NULL, after all others, for vectors of different lengths.
    """
    same = same or []
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("qv"), *same)
    v = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), *same)
    return top_matches(q, v, k, [], same, without_self)


def thesis_score(semantic: Column, industry: Column, cluster: Column, text: Column, thesis: dict[str, list[str]]) -> Column:
    """Similarity to a thesis with capped boosts for its tags and words and a capped penalty for excluded words."""
    tag = lambda c, key, boost: F.when(c.isin(*thesis.get(key, [])), boost).otherwise(0.0)
    hits = lambda key, each, cap: F.least(F.size(keyword_hits(text, thesis[key])) * each, F.lit(cap)) if thesis.get(key) else F.lit(0.0)
    score = semantic + tag(industry, "industries", 0.18) + tag(cluster, "clusters", 0.18) + hits("keywords", 0.04, 0.20)
    score = score + tag(industry, "secondary_industries", 0.06) + tag(cluster, "secondary_clusters", 0.06) + hits("secondary_keywords", 0.015, 0.08)
    return F.round(score - hits("excluded", 0.25, 0.5), 4)


def _either_way(values: Column, text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return (low != "") & F.exists(values, lambda x: F.contains(low, F.lower(x)) | F.contains(F.lower(x), low))


def match_score(similarity: Column, stages: Column, industries: Column, regions: Column, stage: Column, industry: Column, country: Column, city: Column) -> Column:
    """Half similarity, the rest for stage, industry and region; a substring either way is enough. At most 1.

    A record with a city but without a country fits any region, since the empty country is part of every name.
    """
    land, town = (F.lower(F.coalesce(c, F.lit(""))) for c in (country, city))
    near = ((land != "") | (town != "")) & F.exists(regions, lambda r: F.contains(land, F.lower(r)) | F.contains(town, F.lower(r)) | F.contains(F.lower(r), land))
    parts = F.when(_either_way(stages, stage), 0.2).otherwise(0.0) + F.when(_either_way(industries, industry), 0.15).otherwise(0.0) + F.when(near, 0.15).otherwise(0.0)
    return F.round(F.least(similarity * 0.5 + parts, F.lit(1.0)), 3)


def rerank(candidates: DataFrame, score: Column, k: int) -> DataFrame:
    """The top ``k`` of each query's 3k nearest, by a composite score."""
    order = Window.partitionBy("query_id").orderBy(F.desc("match_score"), "id")
    return candidates.filter(F.col("rank") <= 3 * k).withColumn("match_score", score).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def evidence_score(name: Column, emb: Column, location: Column, year: Column, founders: Column, weights: dict[str, float] = C.WEIGHTS) -> Column:
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), emb))
    return F.round(weights["name"] * name + weights["embedding"] * clamped + weights["location"] * location + weights["founded_year"] * year + weights["founders"] * founders, 3)

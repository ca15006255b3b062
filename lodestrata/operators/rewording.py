"""Texts that say the same in other words' order or with a few letters changed: pairs, and the anti-join on them.

Two texts are reworded if their words, lower-cased and sorted, have an insertion-deletion similarity of at least ``least`` (0 to
100). A join on that without comparing all: such a pair of lengths n <= m differs by at most D = (1 - least / 100) (n + M)
operations, where M is the greatest length that can go with n. Of D + 1 pieces of q = n div (D + 1) characters of the shorter text at least one
is therefore whole in the longer one. So the shorter text's pieces are joined with the pieces of that size at every place of the
longer one: keys grow with the length of the texts, not with their number, and no pair is missed. At 90, pieces have 3 to 5
letters; towards 50 they are single letters and block little.

Equal texts of a key are compared once, whatever their number of rows. Null and blank texts are never reworded.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.identity import fold, sorted_tokens


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; one addition of |a|-bit numbers for each letter of ``b``."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    whole = row = (1 << len(a)) - 1
    for y in b:
        u = row & at.get(y, 0)
        row = (row + u | row - u) & whole
    return len(a) - row.bit_count()


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([200.0 * common_subsequence(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def subsequence_ratio(a: Column | str, b: Column | str) -> Column:
    """200 * longest common subsequence / both lengths, of texts as they are; 100 if both are empty. NULL is none."""
    return F.pandas_udf(_ratios, "double")(a, b)


def folded_text(text: Column) -> Column:
    """Lower-cased words in order, joined by one space."""
    return sorted_tokens(F.lower(text))


def reworded_ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts, 0 to 100, whatever the order and case of their words. Long texts are no matter."""
    return subsequence_ratio(folded_text(F.coalesce(a, F.lit(""))), folded_text(F.coalesce(b, F.lit(""))))


def _pieces(least: float) -> tuple[str, str]:
    """SQL for the keys of ``t`` as the shorter and as the longer text of a pair."""
    s = max(0.0, 1 - (least - 1e-9) / 100)
    if s >= 1:
        raise ValueError("a similarity above 0 is needed")
    most = lambda n: f"cast(floor({s!r}D * ({n} + floor({n} * {(1 + s) / (1 - s)!r}D + 1e-9D)) + 1e-9D) as int)"
    size = lambda n: f"greatest(1, {n} div ({most(n)} + 1))"
    short = f"transform(sequence(0, {most('length(t)')}), i -> concat({size('length(t)')}, ':', substr(t, cast(i * {size('length(t)')} + 1 as int), cast({size('length(t)')} as int))))"
    sizes = f"array_distinct(transform(sequence(greatest(1, cast(ceil(length(t) * {(1 - s) / (1 + s)!r}D - 1e-9D) as int)), length(t)), n -> {size('n')}))"
    long = f"flatten(transform({sizes}, q -> transform(sequence(1, cast(length(t) - q + 1 as int)), i -> concat(q, ':', substr(t, i, cast(q as int))))))"
    return f"array_distinct({short})", f"array_distinct({long})"


def reworded_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], text: str, least: float = C.TRIVIAL_REWORD) -> DataFrame:
    """(on, a, b, ratio): folded texts of ``left`` and ``right`` that are reworded, for equal ``on``; equal ones included."""
    on = list(on)
    short, long = _pieces(least)
    a, b = (d.select(*on, folded_text(F.col(text)).alias("t")).where("t <> ''").distinct() for d in (left, right))

    def keys(d: DataFrame, sql: str, name: str) -> DataFrame:
        return d.select(*on, F.col("t").alias(name), F.explode(F.expr(sql)).alias("piece"))

    met = keys(a, short, "a").join(keys(b, long, "b"), [*on, "piece"]).where("length(a) <= length(b)")
    met = met.unionByName(keys(a, long, "a").join(keys(b, short, "b"), [*on, "piece"]).where("length(a) > length(b)"))
    share = 1 - least / 100
    near = F.abs(F.length("a") - F.length("b")) <= share * (F.length("a") + F.length("b")) + 1e-9
    return met.where(near).select(*on, "a", "b").distinct().withColumn("ratio", F.round(subsequence_ratio("a", "b"), 4)).where(F.col("ratio") >= least)


def reworded_join(left: DataFrame, right: DataFrame, on: Sequence[str], text: str, least: float = C.TRIVIAL_REWORD, how: str = "left_semi") -> DataFrame:
    """Rows of ``left`` with (``left_semi``) or without (``left_anti``) a reworded text in ``right`` for equal ``on``."""
    on = list(on)
    found = reworded_pairs(left, right, on, text, least).select(*on, F.col("a").alias("lode_text")).distinct()
    return left.withColumn("lode_text", folded_text(F.col(text))).join(found, [*on, "lode_text"], how).drop("lode_text").select(left.columns)


def uncovered(proposed: DataFrame, pending: DataFrame, key: str, texts: Sequence[str] = (), lists: Sequence[str] = (), least: float = C.TRIVIAL_REWORD) -> DataFrame:
    """Proposals (key, field, new) that no pending one of their key and field says already.

    Free texts (the fields ``texts``) are covered by a reworded one, ``lists`` by the same list, all else by an equal folded value.
    """
    kind = F.when(F.col("field").isin(*texts), "text").when(F.col("field").isin(*lists), "list").otherwise("value")
    value = F.when(kind == "list", F.col("new")).otherwise(fold(F.col("new")))
    p, q = proposed.withColumn("lode_value", value), pending.select(key, "field", "new", value.alias("lode_value"))
    # equal values go first, by an equi-join; only what is left, and only texts, are compared by likeness
    open_ = p.join(q.select(key, "field", "lode_value").distinct(), [key, "field", "lode_value"], "left_anti").drop("lode_value").select(proposed.columns)
    if not texts:
        return open_
    is_text = F.col("field").isin(*texts)
    return open_.where(~is_text).unionByName(reworded_join(open_.where(is_text), pending.where(is_text), [key, "field"], "new", least, "left_anti"))

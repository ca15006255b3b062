"""The review inbox as its reader sees it: filtered, one entry a record with the candidates of each field, and settled by picks.

``reviews`` has one row a review (ident, key, created, risk and what else a filter asks for), ``changes`` one row for each field
that a review proposes a value for (ident, field, new, source). Candidates and entries are aggregates; which reviews stand
behind a candidate is a join of ``changes`` on (key, field, new), never a list in a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def review_filter(equal: dict[str, object] | None = None, evidence: Column | None = None, evidence_level: str | None = None, names: Sequence[Column] = (), q: str | None = None, path: str = "$.evidence_level") -> Column:
    """The conjunction of what is given: equal columns, the level within the evidence (JSON text; broken JSON has none), and a
    pattern that any of the names must match in any case of letters."""
    out = F.lit(True)
    for c, v in (equal or {}).items():
        out = out & (F.col(c) == v) if v is not None else out
    if evidence_level:
        out = out & (F.try_variant_get(F.try_parse_json(evidence), path, "string") == evidence_level)
    if q:
        like = F.lit(False)
        for n in names:
            like = like | F.coalesce(n.ilike(f"%{q}%"), F.lit(False))
        out = out & like
    return out


def candidates(reviews: DataFrame, changes: DataFrame, key: str, ident: str, created: str, live: DataFrame | None = None, fields: Sequence[str] = ()) -> DataFrame:
    """(key, field, place, value, votes, newest, sources, current): each different value that a field of a record might take.

    Places count from the value of the newest review. ``current`` is the record's live value, not what a review once saw: NULL
    where the record is gone or has no such field.
    """
    rows = changes.join(reviews.select(ident, key, created), ident)
    c = rows.groupBy(key, "field", F.col("new").alias("value")).agg(
        F.count(F.lit(1)).alias("votes"), F.max(F.struct(created, ident)).alias("last"), F.array_sort(F.collect_set("source")).alias("sources"),
    )
    order = Window.partitionBy(key, "field").orderBy(F.desc("last"))
    c = c.withColumn("place", F.row_number().over(order)).select(key, "field", "place", "value", "votes", F.col(f"last.{ident}").alias("newest"), "sources")
    if live is None or not fields:
        return c.withColumn("current", F.lit(None).cast("string"))
    now = live.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("current")) for f in fields])).alias("x")).select(key, "x.*")
    return c.join(now, [key, "field"], "left")


def entries(reviews: DataFrame, changes: DataFrame, key: str, ident: str, created: str, risk: str, live: DataFrame) -> DataFrame:
    """One row a record: reviews, risk (the worst: high if any is, else the newest review's), first_seen, last_seen, newest, the
    number of fields and of candidates, and whether the record is gone."""
    per_review = changes.groupBy(ident).agg(F.count(F.lit(1)).alias("n"))
    at = F.struct(created, ident)
    r = reviews.join(per_review, ident, "left").groupBy(key).agg(
        F.count(F.lit(1)).alias("reviews"), F.when(F.max(F.when(F.col(risk) == "high", 1).otherwise(0)) == 1, "high").otherwise(F.max(F.struct(at.alias("at"), F.col(risk).alias("risk")))["risk"]).alias("risk"),
        F.min(created).alias("first_seen"), F.max(created).alias("last_seen"), F.max(at)[ident].alias("newest"), F.coalesce(F.sum("n"), F.lit(0)).alias("changes"),
    )
    kinds = changes.join(reviews.select(ident, key), ident).groupBy(key, "field", "new").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy(key, "field").agg(F.count(F.lit(1)).alias("v")).groupBy(key).agg(F.count(F.lit(1)).alias("fields"), F.sum("v").alias("candidates"))
    out = r.join(kinds, key, "left").join(live.select(key, F.lit(True).alias("lode_there")).distinct(), key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(key, "reviews", "risk", "first_seen", "last_seen", "newest", "changes", zero("fields"), zero("candidates"), F.col("lode_there").isNull().alias("master_missing"))


def settle(reviews: DataFrame, changes: DataFrame, picks: DataFrame, key: str, ident: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What picks (key, field, value) do: statuses (key, ident, status), applied (key, field, value) and suppressed (key, field, value).

    Reviews of picked records alone are settled. One is approved if it proposes something and each of its values is the pick of
    its field, else rejected, and all that a rejected one proposed is suppressed, so that it isn't proposed again.
    """
    mine = reviews.join(picks.select(key).distinct(), key, "left_semi").select(key, ident)
    chosen = picks.where("value IS NOT NULL").groupBy(key, "field").agg(F.min("value").alias("value"))
    rows = mine.join(changes.select(ident, "field", "new"), ident, "left").join(chosen, [key, "field"], "left")
    same = F.col("field").isNotNull() & F.col("new").eqNullSafe(F.col("value"))
    statuses = rows.groupBy(key, ident).agg(F.when(F.min(same), "approved").otherwise("rejected").alias("status"))
    refused = rows.where("field IS NOT NULL").join(statuses.where("status = 'rejected'"), [key, ident], "left_semi")
    return statuses, chosen, refused.select(key, "field", F.col("new").alias("value")).distinct()


def merged_histories(rows: DataFrame, group: str, keeper: Column, order: Sequence[str], entries: str, url: str = "url") -> DataFrame:
    """(group, entries): the keeper's entries as they stand, then those of the others whose address is new, in order.

    ``entries`` is a list of structs. Addresses are compared as they are; entries without one are equal to one another.
    """
    kept = F.coalesce(keeper, F.lit(False))
    e = rows.select(group, kept.alias("lode_kept"), F.struct(*order).alias("lode_at"), F.posexplode(entries).alias("lode_pos", "lode_e"))
    by = Window.partitionBy(group, F.col("lode_e")[url]).orderBy(F.desc("lode_kept"), "lode_at", "lode_pos")
    e = e.withColumn("lode_n", F.row_number().over(by)).where("lode_kept OR lode_n = 1")
    listed = e.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((~F.col("lode_kept")).alias("later"), F.col("lode_at").alias("at"), F.col("lode_pos").alias("pos"), F.col("lode_e").alias("e")))).alias("l"))
    none = rows.select(group).distinct()
    empty = F.array().cast(rows.schema[entries].dataType)
    return none.join(listed, group, "left").select(group, F.coalesce(F.col("l.e"), empty).alias(entries))


def sweep_totals(groups: DataFrame, reviews: DataFrame, left: str, right: str) -> DataFrame:
    """One row: groups, losers, resolved, repointed, for merging each group (id, keeper) into its keeper.

    A review is resolved as moot where both its sides come to one record, and re-pointed where a side changes otherwise.
    """
    of = groups.select("id", "keeper")
    g = of.agg(F.count_distinct("keeper").alias("groups"), F.count_if(F.col("id") != F.col("keeper")).alias("losers"))
    r = reviews.join(of.select(F.col("id").alias(left), F.col("keeper").alias("lode_l")), left, "left").join(of.select(F.col("id").alias(right), F.col("keeper").alias("lode_r")), right, "left")
    a, b = F.coalesce("lode_l", left), F.coalesce("lode_r", right)
    moved = (a != F.col(left)) | (b != F.col(right))
    c = r.agg(F.count_if((a == b) & (F.col("lode_l").isNotNull() | F.col("lode_r").isNotNull())).alias("resolved"), F.count_if(moved & (a != b)).alias("repointed"))
    return g.crossJoin(c)  # one row each

"""The review queue: proposals, coverage, grouping, votes, merging. Tables in, tables out; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import fold, is_empty


def field_diff(master: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old, new, kind): what the incoming row would change; kind is fill or conflict."""
    m = master.select(key, *[F.col(f).cast("string").alias(f"m_{f}") for f in fields])
    i = incoming.select(key, *[F.col(f).cast("string").alias(f"i_{f}") for f in fields])
    rows = i.join(m, key).select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"m_{f}").alias("old"), F.col(f"i_{f}").alias("new")) for f in fields])).alias("x")).select(key, "x.*")
    changed = ~is_empty(F.trim(F.coalesce("new", F.lit("")))) & (fold(F.col("old")) != fold(F.col("new")))
    return rows.filter(changed).withColumn("kind", F.when(is_empty(F.col("old")), "fill").otherwise("conflict"))


def uncovered(proposed: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    """Proposals (key, field, new) that no pending one equals by folded value."""
    p = pending.select(key, "field", fold(F.col("new")).alias("lode_new")).distinct()
    return proposed.withColumn("lode_new", fold(F.col("new"))).join(p, [key, "field", "lode_new"], "left_anti").drop("lode_new")


def conflicting_fills(pending: DataFrame, key: str) -> DataFrame:
    """(key, field) for which pending proposals differ by folded value: none of them may be applied unseen."""
    return pending.groupBy(key, "field").agg(F.min(fold(F.col("new"))).alias("a"), F.max(fold(F.col("new"))).alias("b")).filter("a <> b").select(key, "field")


def candidates(proposals: DataFrame, key: str) -> DataFrame:
    """(key, field, value, votes): equal values counted, before anything is gathered."""
    return proposals.groupBy(key, "field", F.col("new").alias("value")).agg(F.count(F.lit(1)).alias("votes"))


def grouped(proposals: DataFrame, key: str, review: str, created: str, risk: str) -> DataFrame:
    """One row a key: reviews, worst risk, first and last seen, number of fields and of candidate values.

    Each kind of thing is counted from its own distinct rows, so no row is repeated for each count; what is joined is a row a key.
    """
    key_ = F.col(key).alias("lode_key")  # NULL is a key as any other
    spans = proposals.groupBy(key_).agg(
        F.when(F.max(F.when(F.col(risk) == "high", 1).otherwise(0)) == 1, "high").otherwise(F.max_by(risk, F.struct(created, review))).alias("risk"),
        F.min(created).alias("first_seen"),
        F.max(created).alias("last_seen"),
    )
    reviews = proposals.select(key_, F.col(review).alias("lode_review")).distinct().groupBy("lode_key").agg(F.count("lode_review").alias("reviews"))
    values = proposals.select(key_, "field", "new").distinct().groupBy("lode_key", "field").agg(F.count(F.when(F.col("field").isNotNull(), F.col("new"))).alias("values"))
    values = values.groupBy("lode_key").agg(F.count("field").alias("fields"), F.sum("values").alias("values"))
    out, columns = spans, [F.col("lode_key").alias(key), "reviews", "risk", "first_seen", "last_seen", "fields", "values"]
    for more in (reviews, values):
        out = out.join(more.withColumnRenamed("lode_key", "lode_other"), F.col("lode_key").eqNullSafe(F.col("lode_other"))).drop("lode_other")
    return out.select(*columns)


def majority(proposals: DataFrame, key: str) -> DataFrame:
    """(key, field, value, votes, resolvable): the winner of each field; a key with a tie in any field isn't resolvable."""
    counted = candidates(proposals, key)
    order = Window.partitionBy(key, "field").orderBy(F.desc("votes"), "value")
    ranked = counted.withColumn("place", F.row_number().over(order)).withColumn("second", F.lead("votes").over(order))
    first = ranked.filter("place = 1").withColumn("clear", F.col("second").isNull() | (F.col("votes") > F.col("second")))
    return first.withColumn("resolvable", F.min("clear").over(Window.partitionBy(key))).select(key, "field", "value", "votes", "resolvable")


def resolve(proposals: DataFrame, winners: DataFrame, key: str, review: str) -> DataFrame:
    """(key, review, status): a review is approved if all its fields propose the winner; unresolvable keys stay pending."""
    joined = proposals.join(winners.select(key, "field", "value", "resolvable"), [key, "field"])
    return joined.groupBy(key, review).agg(F.when(~F.min("resolvable"), "pending").when(F.min(F.col("new") == F.col("value")), "approved").otherwise("rejected").alias("status"))


def without_rejected(proposals: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Proposals less those whose exact value was rejected before."""
    return proposals.join(rejected.select(key, "field", F.col("value").alias("new")).distinct(), [key, "field", "new"], "left_anti")


def without_known_pairs(pairs: DataFrame, known: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs less those known to differ, whichever way round."""
    k = known.select(F.least(a, b).alias("lode_a"), F.greatest(a, b).alias("lode_b")).distinct()
    return pairs.withColumns({"lode_a": F.least(a, b), "lode_b": F.greatest(a, b)}).join(k, ["lode_a", "lode_b"], "left_anti").drop("lode_a", "lode_b")


def merge_groups(rows: DataFrame, group: str, age: str, ident: str, fields: list[str]) -> DataFrame:
    """One row a group: the oldest keeps its id; each field is the first non-empty one by age."""
    at = F.struct(age, ident)
    full = [F.min_by(F.nullif(F.col(f).cast("string"), F.lit("")), F.when(~is_empty(F.col(f)), at)).alias(f) for f in fields]
    return rows.groupBy(group).agg(F.min_by(ident, at).alias("keeper"), F.count(F.lit(1)).alias("members"), *full)


def union_history(rows: DataFrame, key: str, url: str, at: str) -> DataFrame:
    """The first sighting of each address of each key."""
    return rows.groupBy(key, url).agg(F.min(at).alias(at))


def add_new(current: Column, incoming: Column) -> Column:
    """``current`` and what of ``incoming`` it doesn't have in any case of letters, in order."""
    low = F.transform(current, F.lower)
    return F.concat(current, F.filter(incoming, lambda x: ~F.array_contains(low, F.lower(x))))


def repoint(reviews: DataFrame, keepers: DataFrame, left: str, right: str) -> DataFrame:
    """Reviews with merged ids replaced by their keeper; ``same`` marks those whose sides have become one."""
    a = keepers.select(F.col("id").alias(left), F.col("keeper").alias("lode_l"))
    b = keepers.select(F.col("id").alias(right), F.col("keeper").alias("lode_r"))
    out = reviews.join(a, left, "left").join(b, right, "left").withColumns({left: F.coalesce("lode_l", left), right: F.coalesce("lode_r", right)})
    return out.drop("lode_l", "lode_r").withColumn("same", F.col(left) == F.col(right))


def upsert(masters: DataFrame, incoming: DataFrame, key: list[str], machine: list[str], human: list[str]) -> DataFrame:
    """A new snapshot: machine columns take non-empty incoming values, human columns only where the row is new."""
    i = incoming.select(*key, *[F.col(c).alias(f"i_{c}") for c in machine + human], F.lit(True).alias("lode_in"))
    m = masters.select(*key, *machine, *human, F.lit(True).alias("lode_old"))
    out = m.join(i, key, "full")
    new = lambda c: F.when(~is_empty(F.col(f"i_{c}")), F.col(f"i_{c}"))
    return out.select(
        *key,
        *[F.coalesce(new(c), F.col(c)).alias(c) for c in machine],
        *[F.when(F.col("lode_old").isNull(), F.col(f"i_{c}")).otherwise(F.col(c)).alias(c) for c in human],
        F.when(F.col("lode_old").isNull(), "new").when(F.col("lode_in").isNull(), "kept").otherwise("refreshed").alias("status"),
    )

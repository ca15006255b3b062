"""Staged writes and review actions: snapshots in, snapshots and statuses out. Nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.identity import fold, is_empty
from ..scratch import written
from .matching import greedy_keepers
from .rewording import folded_text, reworded_join, reworded_pairs, reworded_ratio


def _blank(c: Column) -> Column:
    return is_empty(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def all_blank(fields: list[str], prefix: str = "") -> Column:
    """Whether none of the fields holds anything."""
    out = F.lit(True)
    for f in fields:
        out = out & _blank(F.col(prefix + f))
    return out


def proposals(masters: DataFrame, incoming: DataFrame, pending: DataFrame, fields: list[str], texts: list[str] | None = None) -> DataFrame:
    """What incoming rows (seq, master_id, fields) that are the same record as their master say that it doesn't.

    Rows are judged in the order of ``seq``. The first value for an empty field fills it unless a pending proposal
    differs from it (then it waits, and so do all after it); what differs from a filled field, from then on, is a conflict. A conflict that a pending proposal
    has already, or an earlier row proposes, is covered. Fields in ``texts`` hold free text: there a rewording of what is
    stored changes nothing, and a rewording of a pending or earlier proposal is covered. Columns: seq, master_id, field, old, new,
    action (fill, conflict or covered).
    """
    pairs = lambda p: F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(p + f).cast("string").alias("v")) for f in fields])).alias("x")
    old = masters.select("master_id", pairs("")).select("master_id", "x.field", F.col("x.v").alias("old"))
    new = incoming.select("seq", "master_id", pairs("")).select("seq", "master_id", "x.field", F.col("x.v").alias("new")).filter(~_blank(F.col("new")))
    rows = new.join(old, ["master_id", "field"])
    waiting = pending.select("master_id", "field", fold(F.col("new")).alias("folded")).distinct()
    contested = waiting.groupBy("master_id", "field").agg(F.count(F.lit(1)).alias("n"), F.min("folded").alias("one"))
    rows = rows.join(contested, ["master_id", "field"], "left").withColumn("folded", fold(F.col("new")))
    free = _blank(F.col("old")) & (F.col("n").isNull() | ((F.col("n") == 1) & (F.col("one") == F.col("folded"))))
    # the first row decides: if its value may not fill the field, it waits with the others, and none may
    first = rows.withColumn("free", free).groupBy("master_id", "field").agg(F.min_by(F.struct("seq", "new", "free"), "seq").alias("x"))
    filler = first.select("master_id", "field", F.when(F.col("x.free"), F.col("x")).alias("filler"))
    rows = rows.join(filler, ["master_id", "field"]).withColumn("current", F.when(_blank(F.col("old")) & (F.col("seq") > F.col("filler.seq")), F.col("filler.new")).otherwise(F.col("old")))
    is_fill = F.coalesce(F.col("seq") == F.col("filler.seq"), F.lit(False))
    changed = rows.filter(is_fill | _blank(F.col("current")) | (fold(F.col("current")) != F.col("folded"))).withColumn("fill", is_fill)
    if texts:
        return _with_texts(changed, pending, waiting, texts)
    return _judged(changed, waiting)


def _judged(changed: DataFrame, waiting: DataFrame) -> DataFrame:
    asked = waiting.withColumn("known", F.lit(True))
    first = changed.filter("NOT fill").groupBy("master_id", "field", "folded").agg(F.min("seq").alias("first"))
    out = changed.join(asked, ["master_id", "field", "folded"], "left").join(first, ["master_id", "field", "folded"], "left")
    action = F.when(F.col("fill"), "fill").when(F.col("known") | (F.col("first") < F.col("seq")), "covered").otherwise("conflict")
    return out.select("seq", "master_id", "field", F.col("current").alias("old"), "new", action.alias("action"))


def _with_texts(changed: DataFrame, pending: DataFrame, waiting: DataFrame, texts: list[str]) -> DataFrame:
    """As ``_judged``, with the fields ``texts`` compared by likeness. Earlier rows cover later ones in order: a row that is covered covers none."""
    is_text = F.col("field").isin(*texts)
    plain = _judged(changed.where(~is_text), waiting)
    same = ~F.col("fill") & ~_blank(F.col("current")) & (reworded_ratio(F.col("current"), F.col("new")) >= C.TRIVIAL_REWORD)
    rows = written(changed.where(is_text).where(~same).select("seq", "master_id", "field", F.col("current").alias("old"), "new", "fill"), "texts")
    on = ["master_id", "field"]
    asked = written(reworded_join(rows.where("NOT fill"), pending, on, "new", how="left_anti"), "asked")
    ids = asked.select(*on, folded_text(F.col("new")).alias("t"), F.concat_ws(":", "seq", "field").alias("id"), "seq")
    pairs = reworded_pairs(asked, asked, on, "new").select(*on, "a", "b")
    edges = pairs.join(ids.select(*on, F.col("t").alias("a"), F.col("id").alias("x")), [*on, "a"]).join(ids.select(*on, F.col("t").alias("b"), F.col("id").alias("y")), [*on, "b"]).where("x <> y")
    keepers = greedy_keepers(ids.select("id", "seq"), "id", edges, "x", "y", [F.col("seq")])
    staged_ids = keepers.where("id = keeper").select(F.col("id").alias("lode_id"), F.lit(True).alias("lode_staged"))
    out = rows.withColumn("lode_id", F.concat_ws(":", "seq", "field")).join(staged_ids, "lode_id", "left")
    action = F.when(F.col("fill"), "fill").when(F.col("lode_staged"), "conflict").otherwise("covered")
    return plain.unionByName(out.select("seq", "master_id", "field", "old", "new", action.alias("action")))


def staged(incoming: DataFrame, masters: DataFrame, changes: DataFrame, different: DataFrame, substantive: list[str]) -> DataFrame:
    """(seq, record_id, status) of incoming rows with their match: seq, new_id, outcome, risk, master_id and the fields.

    exact: staged_update if any change is a conflict, else no_op. A duplicate or an anomaly is new_master where the pair is
    known to differ; a high-risk duplicate that says nothing merges into a master that says something; else it is
    staged. Everything else is a new master. A row without a name of two letters has no status.
    """
    conflicts = changes.filter("action = 'conflict'").select("seq").distinct().withColumn("conflict", F.lit(True))
    known = different.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct().withColumn("differ", F.lit(True))
    bare = masters.select("master_id", all_blank(substantive).alias("bare"))
    rows = incoming.withColumns({"p": F.least("master_id", "new_id"), "q": F.greatest("master_id", "new_id"), "says_nothing": all_blank(substantive)})
    rows = rows.join(conflicts, "seq", "left").join(known, ["p", "q"], "left").join(bare, "master_id", "left")
    doubtful = F.col("outcome").isin("possible_duplicate", "anomaly") & F.col("differ").isNull()
    merged = (F.col("outcome") == "possible_duplicate") & (F.col("risk") == "high") & F.col("says_nothing") & ~F.coalesce("bare", F.lit(True))
    status = (
        F.when(F.length(F.trim(F.coalesce("name", F.lit("")))) < 2, F.lit(None).cast("string"))
        .when((F.col("outcome") == "exact_same_record") & F.col("bare").isNotNull(), F.when(F.col("conflict"), "staged_update").otherwise("no_op"))
        .when(doubtful & merged, "auto_merged_empty_duplicate")
        .when(doubtful, F.when(F.col("outcome") == "anomaly", "staged_anomaly").otherwise("staged_duplicate"))
        .otherwise("new_master")
    )
    out = rows.withColumn("status", status)
    record = F.when(F.col("status").isin("no_op", "staged_update", "auto_merged_empty_duplicate"), F.col("master_id")).when(F.col("status").isNotNull(), F.col("new_id"))
    return out.select("seq", record.alias("record_id"), "status")


def filled(masters: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """The masters with the fills of ``changes`` in their empty fields."""
    fills = changes.filter("action = 'fill'").groupBy("master_id").agg(*[F.max(F.when(F.col("field") == f, F.col("new"))).alias(f"f_{f}") for f in fields])
    rest = [c for c in masters.columns if c not in fields]
    return masters.join(fills, "master_id", "left").select(*rest, *[F.coalesce(f"f_{f}", F.col(f).cast("string")).alias(f) for f in fields])


def act(reviews: DataFrame, actions: DataFrame) -> DataFrame:
    """Reviews (review_id, status) after actions (review_id, action), of which each review takes at most one.

    approve, reject and delete need a pending review, undo one that was approved or rejected; other actions fail and
    change nothing. ``result`` is ok, conflict or, for ids without a review, missing.
    """
    rows = reviews.join(actions, "review_id", "full")
    pending, settled = F.col("status") == "pending", F.col("status").isin("approved", "rejected")
    after = F.when(pending & (F.col("action") == "approve"), "approved").when(pending & (F.col("action") == "reject"), "rejected").when(pending & (F.col("action") == "delete"), "deleted").when(settled & (F.col("action") == "undo"), "pending")
    result = F.when(F.col("action").isNotNull(), F.when(F.col("status").isNull(), "missing").when(after.isNotNull(), "ok").otherwise("conflict"))
    return rows.withColumns({"result": result, "status": F.coalesce(after, "status")})


def suppressed(acted: DataFrame) -> DataFrame:
    """(a, b): pairs that rejected duplicate reviews say are different, smaller id first."""
    pairs = acted.filter("result = 'ok' AND action = 'reject' AND review_type = 'possible_duplicate'")
    return pairs.select(F.least("master_id", "other_id").alias("a"), F.greatest("master_id", "other_id").alias("b")).distinct()


def multi_candidates(pending: DataFrame) -> DataFrame:
    """(master_id, field) that several pending proposals want to differ: none may be applied in bulk."""
    return pending.groupBy("master_id", "field").agg(F.count(F.lit(1)).alias("n"), F.min(fold(F.col("new"))).alias("a"), F.max(fold(F.col("new"))).alias("b")).filter("n > 1 AND a <> b").select("master_id", "field")


def drained(masters: DataFrame, pending: DataFrame) -> DataFrame:
    """(master_id, field, value, decision) of a backlog's fields that hold no free text: applied where the live field is
    empty and all proposals agree, contested where they don't, kept where it is filled. ``masters`` is long: master_id,
    field, live. Of equal values in different spelling the smallest is taken."""
    asked = pending.filter(~_blank(F.col("new"))).groupBy("master_id", "field").agg(F.min("new").alias("value"), F.min(fold(F.col("new"))).alias("a"), F.max(fold(F.col("new"))).alias("b"))
    rows = asked.join(masters, ["master_id", "field"], "left")
    decision = F.when(~_blank(F.col("live")), "kept").when(F.col("a") == F.col("b"), "applied").otherwise("contested")
    return rows.select("master_id", "field", "value", decision.alias("decision"))


def edited(rows: DataFrame, patches: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """``rows`` with patches (key, field, value) of allowed fields applied, of several for one field the last by ``at``;
    ``edited`` lists the fields that changed."""
    last = patches.filter(F.col("field").isin(*allowed)).groupBy(key, "field").agg(F.max_by("value", "at").alias("value"))
    wide = last.groupBy(key).agg(*[F.max_by(F.struct("value"), F.when(F.col("field") == f, F.lit(1))).alias(f"p_{f}") for f in allowed])
    joined = rows.join(wide, key, "left")
    new = {f: F.when(F.col(f"p_{f}").isNotNull(), F.col(f"p_{f}.value")).otherwise(F.col(f).cast("string")) for f in allowed}
    changed = F.array_compact(F.array(*[F.when(~new[f].eqNullSafe(F.col(f).cast("string")), F.lit(f)) for f in allowed]))
    return joined.select(*[c for c in rows.columns if c not in allowed], *[new[f].alias(f) for f in allowed], F.array_join(changed, ",").alias("edited"))


def without_records(table: DataFrame, gone: DataFrame, *refs: str) -> DataFrame:
    """Rows none of whose references is among the ids that go."""
    for ref in refs:
        table = table.join(gone.select(F.col("id").alias(ref)).distinct(), ref, "left_anti")
    return table


def verdict_proposals(verdicts: DataFrame, shown: DataFrame, aliases: dict[str, str], fields: list[str], masters: DataFrame) -> DataFrame:
    """Findings (master_id, field, value, url) of verdicts as proposals: field names by their alias, only fields that may be
    proposed, only values whose url was shown, and only what the master (long: master_id, field, live) doesn't have."""
    names = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    low = F.lower(F.trim("field"))
    field = F.coalesce(F.try_element_at(names, low), low) if names is not None else low
    loose = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^https?://(www\.)?", ""), "/+$", "")
    rows = verdicts.withColumns({"field": field, "loose": loose("url")}).filter(F.col("field").isin(*fields) & ~_blank(F.col("value")))
    seen = shown.select("master_id", loose("url").alias("loose")).distinct()
    rows = rows.join(seen, ["master_id", "loose"], "left_semi").join(masters, ["master_id", "field"], "left")
    rows = rows.filter(_blank(F.col("live")) | (fold(F.col("live")) != fold(F.col("value"))))
    return rows.groupBy("master_id", "field").agg(F.min("value").alias("value"), F.when(_blank(F.max("live")), "fill").otherwise("conflict").alias("kind"))


def applied(register: DataFrame, findings: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A register with findings (key, field, value): empty fields are filled, what disagrees stands under proposed_<field>."""
    wide = findings.groupBy(key).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"n_{f}") for f in fields])
    rows = register.join(wide, key, "left")
    out = [c for c in register.columns if c not in fields]
    for f in fields:
        empty = _blank(F.col(f))
        out.append(F.when(empty & F.col(f"n_{f}").isNotNull(), F.col(f"n_{f}")).otherwise(F.col(f).cast("string")).alias(f))
        out.append(F.when(~empty & (fold(F.col(f)) != fold(F.col(f"n_{f}"))), F.col(f"n_{f}")).alias(f"proposed_{f}"))
    return rows.select(*out)


def oldest(masters: DataFrame, by: str, age: str, ident: str) -> DataFrame:
    """(by, ident): the oldest row of each value."""
    return masters.filter(F.col(by).isNotNull()).groupBy(by).agg(F.min_by(ident, F.struct(age, ident)).alias(ident))


def survivors(rows: DataFrame, group: str, ident: str, best: list[Column]) -> DataFrame:
    """(ident, survivor): of each group the first in the order of ``best`` (descending, then the smallest id) stays."""
    order = Window.partitionBy(group).orderBy(*[c.desc_nulls_last() for c in best], F.col(ident))
    return rows.withColumn("survivor", F.first(ident).over(order)).select(ident, "survivor")

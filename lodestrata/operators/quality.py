"""Quality of a run: verdicts, recall, latency, bursts, retries, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .ordering import placed


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a, b), 4)


def verdict_metrics(df: DataFrame, verdict: Column, none: Column, stored: Column, duration: Column, by: list[str]) -> DataFrame:
    """Counts and ratios of reviewed extractions; a ratio without rows to divide by is NULL."""
    valid, bad, part = (F.count_if(F.coalesce(F.upper(F.trim(verdict)) == v, F.lit(False))) for v in ("VALID", "INVALID", "PARTIAL"))
    total = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        total.alias("total"), valid.alias("valid"), bad.alias("invalid"), part.alias("partial"), (total - valid - bad - part).alias("unreviewed"),
        F.count_if(none).alias("none_extracted"), F.count_if(stored).alias("stored"), F.count_if(none & (F.upper(F.trim(verdict)) == "INVALID")).alias("coverage_gaps"),
        _ratio(valid, valid + bad).alias("precision"), _ratio(bad, valid + bad + part).alias("false_positive_rate"), _ratio(part, valid + bad + part).alias("partial_rate"),
        _ratio(F.count_if(~none), total).alias("extraction_rate"), F.round(F.avg(F.coalesce(duration, F.lit(0.0))), 2).alias("avg_duration"),
    )


def recall(expected: Column, extracted: Column) -> Column:
    return F.when(expected <= 0, 1.0).otherwise(F.least(F.lit(1.0), extracted / expected))


def page_outcomes(extractions: DataFrame, expectations: DataFrame, page: str, name: str) -> DataFrame:
    """Distinct names (in lower case, trimmed) of each page against what it was expected to have."""
    key = F.lower(F.trim(name))
    found = extractions.filter(key != "").groupBy(page).agg(F.countDistinct(key).alias("extracted"))
    out = expectations.join(found, page, "left").withColumn("extracted", F.coalesce("extracted", F.lit(0)).cast("long"))
    return out.withColumn("recall", F.round(recall(F.col("expected"), F.col("extracted")), 4))


def shortfalls(outcomes: DataFrame, ratio: float = C.RECALL_LOW, gap: int = C.RECALL_GAP) -> DataFrame:
    missing = F.col("expected") - F.col("extracted")
    return outcomes.filter((F.col("expected") > 0) & (F.col("recall") < ratio) & (missing >= gap)).withColumn("gap", missing)


def stub_burst(stubs: Column, inserted: Column) -> Column:
    return (stubs >= C.BURST_MIN) & (stubs / F.greatest(inserted, F.lit(1)) >= C.BURST_SHARE)


def latency(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, least, median, p90 and most of each group. The 90th percentile is the exclusive one: at place 0.9 (n + 1)
    of the values in order, between two of them in proportion; the largest where there are fewer than nine."""
    rows = df.select(*by, F.col(value).alias("v"))
    ranked = placed(rows.where("v IS NOT NULL"), by, ["v"], "at", "known")
    at, n = F.col("at"), F.col("known")

    def share(place: Column) -> Column:
        """How much of a row's value counts for a place between two rows."""
        low = F.floor(place + 1e-9)
        return F.when(at == low, 1 - (place - low)).when(at == low + 1, place - low).otherwise(0.0)

    p90 = F.greatest(F.lit(1.0), F.least(n.cast("double"), 0.9 * (n + 1)))
    shares = ranked.select(*by, "v", share((n + 1) / 2).alias("s50"), share(p90).alias("s90")).where("s50 > 0 OR s90 > 0")
    places = shares.groupBy(*by).agg(F.round(F.sum(F.col("s50") * F.col("v")), 4).alias("median"), F.round(F.sum(F.col("s90") * F.col("v")), 4).alias("p90"))
    whole = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    on = [F.col(f"w.{c}").eqNullSafe(F.col(f"p.{c}")) for c in by]
    return whole.alias("w").join(places.alias("p"), on, "left").select(*[F.col(f"w.{c}").alias(c) for c in by], "n", "least", "median", "p90", "most")


def consecutive(df: DataFrame, key: list[str], order: list[str], short: Column, limit: int = 2) -> DataFrame:
    """Each row with the length of the run of ``short`` rows that it ends, and if that reaches ``limit``."""
    w = Window.partitionBy(*key).orderBy(*order)
    run = F.sum(F.when(short, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("lode_run", run)
    n = F.count_if(short).over(Window.partitionBy(*key, "lode_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("consecutive", n).drop("lode_run").withColumn("flagged", F.col("consecutive") >= limit)


def retry_step(failures: Column, render: Column, paginate: Column, hit_cap: Column, extraction: Column, position: Column) -> Column:
    """The first rung above ``position`` whose condition holds; NULL when the ladder is done."""
    rungs = [failures > 0, ~render, render & ~paginate, hit_cap, extraction == "card_structured", extraction == "alt_harvest", extraction == "main_prose"]
    steps = F.array(*[F.when(F.coalesce(c, F.lit(False)), i) for i, c in enumerate(rungs, 1)])
    return F.array_min(F.filter(steps, lambda s: s > F.coalesce(position, F.lit(0))))


def headline_like(name: Column) -> Column:
    n = F.size(F.filter(F.split(name, r"\s+"), lambda w: w != ""))
    return (F.length(name) > 45) | (n > 6) | name.rlike(r"[?!:;–—]|\.\s") | (name.contains(" ") & name.endswith("."))


def numbered_sequence(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """``df`` less names that share what stands before a trailing number with another name of the key."""
    head = F.lower(F.trim(F.regexp_extract(F.trim(name), r"^(.*?)[\s_-]*0*([0-9]+)$", 1)))
    rows = df.withColumn("lode_head", F.when(head != "", head))
    counts = rows.where("lode_head IS NOT NULL").groupBy(*key, "lode_head").count().where("count > 1")
    # only heads are counted, so a key's many plain names meet in no task
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in key] + [F.col("r.lode_head") == F.col("c.lode_head")]
    return rows.alias("r").join(counts.alias("c"), on, "left_anti").drop("lode_head")


def budgeted(df: DataFrame, key: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """Rows of each key, taken in order while they fit what is left of the budget; those that don't are passed over.

    A fold over the key's (cost) list: whether a row fits depends on which of those before it did.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    numbered = df.withColumn("lode_at", F.row_number().over(w))
    costs = numbered.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("lode_at", cost))), lambda x: x[cost].cast("long")).alias("lode_costs"))
    state = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<boolean>").alias("took"))
    step = lambda s, c: F.struct(F.when(c <= s["left"], s["left"] - c).otherwise(s["left"]).alias("left"), F.concat(s["took"], F.array(c <= s["left"])).alias("took"))
    took = costs.select(*key, F.aggregate("lode_costs", state, step, lambda s: s["took"]).alias("lode_took"))
    return numbered.join(took, key).filter(F.element_at("lode_took", F.col("lode_at"))).drop("lode_at", "lode_took")

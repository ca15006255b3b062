"""Profiles of sites at work: what strategy follows from one, guesses that give way, the page to list from, and lists of work."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered

#: What a profile leaves open.
DEFAULTS: dict[str, object] = {"shape": "unknown", "extraction": "full_text", "chunking": "sliding_window", "render": False, "paginate": False, "follow": False, "bypass": False, "expected": 0, "confidence": "low", "reason": "", "source": "learned"}


def strategies(sources: DataFrame, profiles: DataFrame, on: Sequence[str], defaults: Mapping[str, object] = DEFAULTS) -> DataFrame:
    """Sources with the strategy of their profile, open fields filled; without a profile all defaults, source ``default``."""
    kept = profiles.select(*on, *defaults, F.lit(True).alias("lode_known"))
    out = sources.join(kept, list(on), "left")
    filled = {k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()}
    filled["source"] = F.when(F.col("lode_known").isNull(), "default").otherwise(filled["source"])
    return out.withColumns(filled).drop("lode_known")


def with_guesses(profiles: DataFrame, guesses: DataFrame, on: Sequence[str]) -> DataFrame:
    """Profiles and, where none has the key, one guess for it: never expected to list anything, never probed.

    Of several guesses with one key the least by all columns stays. A key with a NULL is a key like others.
    """
    rest = [c for c in guesses.columns if c not in on]
    one = guesses.groupBy(*on).agg(F.min(F.struct(*rest)).alias("g")).select(*on, "g.*")
    same = None
    for c in on:
        same = F.col(f"g.{c}").eqNullSafe(F.col(f"p.{c}")) if same is None else same & F.col(f"g.{c}").eqNullSafe(F.col(f"p.{c}"))
    new = one.alias("g").join(profiles.alias("p"), same, "left_anti")
    fixed = {"expected": F.lit(0).cast(profiles.schema["expected"].dataType), "probed_at": F.lit(None).cast(profiles.schema["probed_at"].dataType)}
    return profiles.unionByName(new.withColumns(fixed), allowMissingColumns=True)


def listing_pages(sources: DataFrame, profiles: DataFrame, domain: str, pattern: str, expected: str, primary: str, least: int = 5) -> DataFrame:
    """Sources with url and known: the page of their domain that is expected to list most, if a concrete one is expected to list
    ``least`` or more, else the primary address. A pattern with a wildcard names a shape, not a page."""
    concrete = F.rtrim(F.col(pattern), F.lit("/"))
    p = profiles.where((F.col(expected) >= least) & (F.coalesce(concrete, F.lit("")) != "") & ~F.contains(F.col(pattern), F.lit("*")))
    best = p.groupBy(domain).agg(F.min_by(concrete, F.struct(-F.col(expected), concrete)).alias("lode_path"))
    out = sources.join(best, domain, "left")
    known = F.col("lode_path").isNotNull()
    return out.select(*sources.columns, F.when(known, F.concat(F.lit("https://"), domain, "lode_path")).otherwise(F.col(primary)).alias("url"), known.alias("known"))


def work_list(records: DataFrame, ids: DataFrame, key: str, excerpt: Column) -> DataFrame:
    """The asked-for records whatever their state, and what to do with each: ``recheck`` one with an excerpt, ``no_excerpt``, or
    ``missing`` if there is no such record."""
    asked = ids.select(key).where(F.col(key).isNotNull()).distinct()
    r = records.select(key, (F.coalesce(excerpt, F.lit("")) != "").alias("lode_has"))
    return asked.join(r, key, "left").select(key, F.when(F.col("lode_has").isNull(), "missing").when(F.col("lode_has"), "recheck").otherwise("no_excerpt").alias("task"))


def domain_junk(url: Column, domain: str, description: Column, website: Column) -> Column:
    """Whether a record came from a domain's pages and has neither description nor website: nothing speaks for it."""
    nothing = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.coalesce(url.ilike(f"%{domain}%"), F.lit(False)) & nothing(description) & nothing(website)


def in_first_order(rows: DataFrame, order: Sequence[str | Column], values: str) -> DataFrame:
    """(value, place): the different members of lists by where they first stand, rows in ``order``; nulls fall out.

    Only the different values are numbered, by ranges.
    """
    at = rows.select(F.struct(*order).alias("at"), F.posexplode(values).alias("pos", "value")).where("value IS NOT NULL")
    first = at.groupBy("value").agg(F.min(F.struct("at", "pos")).alias("first"))
    return numbered(first, ["first"], "place").select("value", F.col("place").cast("long").alias("place"))


def register_stats(rows: DataFrame, inside: Column, has: Mapping[str, Column]) -> DataFrame:
    """One row: total, in_radius, out_of_radius, and how many within have each thing. Unknown places are in neither."""
    within = F.coalesce(inside, F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(within).alias("in_radius"), F.count_if(~F.coalesce(inside, F.lit(True))).alias("out_of_radius"), *[F.count_if(within & c).alias(k) for k, c in has.items()])


def stats_by(rows: DataFrame, inside: Column, tier: Column, source: Column, labels: Mapping[int, str]) -> DataFrame:
    """(kind, value, label, n): rows within by tier, with its label, and all rows by source, in one pass."""
    label = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    kinds = F.array(
        F.when(F.coalesce(inside, F.lit(False)), F.struct(F.lit("tier").alias("kind"), tier.cast("string").alias("value"), F.coalesce(F.try_element_at(label, tier), F.lit("?")).alias("label"))),
        F.struct(F.lit("source").alias("kind"), source.cast("string").alias("value"), F.lit(None).cast("string").alias("label")),
    )
    return rows.select(F.explode(F.array_compact(kinds)).alias("k")).groupBy("k.kind", "k.value", "k.label").agg(F.count(F.lit(1)).alias("n"))


def promotion_counts(rows: DataFrame, footprint: Column, method: Column, known_size: Column, threshold: float) -> DataFrame:
    """(method, n, measured, large, promotable): footprints by how they were found; promotable are large ones of unknown size."""
    large = F.coalesce(footprint >= threshold, F.lit(False))
    return rows.groupBy(method.alias("method")).agg(F.count(F.lit(1)).alias("n"), F.count_if(footprint.isNotNull()).alias("measured"), F.count_if(large).alias("large"), F.count_if(large & known_size.isNull()).alias("promotable"))

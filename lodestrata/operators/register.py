"""The register of prospects: gates, triage, fan-in of sources, first-wins deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import clean_name
from ..functions.text import _EDGE


def structural_junk(name: Column) -> Column:
    """Too short or long, several names in one, a headline, an article before a noun, or an unnamed item."""
    n = F.trim(name)
    return F.coalesce((F.length(n) < 2) | (F.length(n) > 120) | (F.regexp_count(n, F.lit(",")) > 1) | n.rlike("[:?]") | n.rlike(r"(?i)^(ein|eine|a|an)\s+[\p{L}\p{N}_]") | n.rlike("^Q[0-9]+$"), F.lit(True))


def building_label(name: Column, words: list[str]) -> Column:
    return F.coalesce(F.trim(name).rlike(rf"(?iu)^({'|'.join(words)})\s*[-–]?\s*[0-9]+[a-z]?$"), F.lit(False))


def institution(name: Column, terms: list[str]) -> Column:
    """A term of letters as a word, any other anywhere; no name is none of ours either."""
    low = F.lower(F.coalesce(name, F.lit("")))
    single = [t.lower() for t in terms if t.replace(" ", "").isalpha()]
    found = low.rlike(rf"(^|{_EDGE})({'|'.join(single)})($|{_EDGE})") if single else F.lit(False)
    for t in terms:
        if not t.replace(" ", "").isalpha():
            found = found | low.contains(t.lower())
    return (F.trim(low) == "") | found


def accept(name: Column, terms: list[str], buildings: list[str]) -> Column:
    c = clean_name(name)
    return (c != "") & ~structural_junk(c) & ~building_label(c, buildings) & ~institution(c, terms)


def fan_in(sources: dict[str, DataFrame | None]) -> DataFrame:
    """All sources in one, by name of column; a source that failed (None) is left out."""
    parts = [df.withColumn("origin", F.lit(k)) for k, df in sources.items() if df is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_by_name(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Of names that are equal in lower case the first in order."""
    w = Window.partitionBy(F.lower(F.trim(name))).orderBy(*order)
    return df.withColumn("lode_at", F.row_number().over(w)).filter("lode_at = 1").drop("lode_at")


def industry_of(*labels: Column) -> Column:
    """The first label that says something."""
    return F.coalesce(*[F.when(~F.lower(c).isin("yes", "company", "works", ""), c) for c in labels])


def survivor(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("lode_at", F.row_number().over(w)).filter("lode_at = 1").drop("lode_at")


def verdict_transition(identity: Column, conflicts: Column, confirmed: Column) -> Column:
    """The next state of a record from a verdict on it."""
    return F.when(~F.coalesce(identity, F.lit(False)), "flagged").when(conflicts > 0, "flagged").when(confirmed > 0, "verified").otherwise("unverified")


def needs_probe(seen: Column, pinned: Column, stale: Column, shortfalls: Column, age_days: Column, ttl: int = 30) -> Column:
    return F.when(~seen, True).when(pinned, False).otherwise(stale | (shortfalls >= 2) | (age_days > ttl))

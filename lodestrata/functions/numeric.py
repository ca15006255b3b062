"""Numbers, dates, distances and scores as columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .text import words


def employees(c: Column, most: int = 9_999_999) -> Column:
    """All digits of the text as one number, within 1 and ``most``; else NULL."""
    n = F.regexp_replace(c.cast("string"), "[^0-9]", "").try_cast("bigint")
    return F.when(n.between(1, most), n)


def first_integer(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c.cast("string"), "[0-9]+", 0), F.lit("")).try_cast("bigint")


def number(c: Column) -> Column:
    """A number whose last separator, point or comma, is the decimal one."""
    dot, comma = F.instr(F.reverse(c), "."), F.instr(F.reverse(c), ",")
    german = (comma > 0) & ((dot == 0) | (comma < dot))
    plain = F.when(german, F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(c, F.lit(","), F.lit("")))
    return plain.try_cast("double")


def revenue(c: Column) -> Column:
    """struct(millions, year) from a text with a unit or at least six digits in a row; NULL if neither, or implausible."""
    year = F.regexp_extract(c, r"(?<![\p{L}\p{N}_])((?:19|20)[0-9]{2})(?![\p{L}\p{N}_])", 1)
    rest = F.regexp_replace(c, r"(?<![\p{L}\p{N}_])(?:19|20)[0-9]{2}(?![\p{L}\p{N}_])", "")
    unit = r"(?i)([0-9]+(?:[.,][0-9]+)*)\s*(mio\.?|million\w*|mrd\.?|milliard\w*|billion\w*|md\.?)"
    value, scale = number(F.regexp_extract(rest, unit, 1)), F.lower(F.regexp_extract(rest, unit, 2))
    raw = F.regexp_extract(rest, r"(?<![\p{L}\p{N}_])([0-9]{6,})(?![\p{L}\p{N}_])", 1).try_cast("double") / 1e6
    millions = F.when(scale != "", value * F.when(scale.rlike("^(mrd|milliard|billion|md)"), 1000.0).otherwise(1.0)).otherwise(raw)
    return F.when(millions.between(0.01, 1e6), F.struct(F.round(millions, 2).alias("millions"), year.try_cast("int").alias("year")))


def in_band(c: Column, low: int = C.BAND_LOW, high: int = C.BAND_HIGH) -> Column:
    return F.coalesce(c.between(low, high), F.lit(False))


def enough_revenue(millions: Column, year: Column, as_of: int, floor: float = C.REVENUE_FLOOR_M, age: int = C.REVENUE_MAX_AGE) -> Column:
    """Three-valued: NULL if unknown, undated or too old to trust."""
    return F.when(millions.isNull() | year.isNull() | (year < as_of - age), None).otherwise(millions >= floor)


def triage_tier(employees: Column, source: Column, footprint: Column, millions: Column, year: Column, as_of: int) -> Column:
    """1 ready, 2 enrich, 3 low prior, 9 out of band: headcount decides, then fresh revenue, then size on the ground."""
    money = enough_revenue(millions, year, as_of)
    return (
        F.when(employees.isNotNull(), F.when(in_band(employees), 1).otherwise(9))
        .when(money, 1)
        .when(~money, 9)
        .when(footprint >= C.LARGE_FOOTPRINT_M2, 2)
        .when(source.isin(*C.NOTABLE_SOURCES), 2)
        .otherwise(3)
    )


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return 2 * 6371.0 * F.asin(F.sqrt(F.when(h > 1.0, 1.0).otherwise(h)))  # NULL where a coordinate is


def polygon_area_m2(points: Column) -> Column:
    """Area of array<struct<lat, lon>> by the shoelace formula on a local projection; 0 under three points."""
    n = F.size(points)
    mean = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["lat"]) / n
    x = lambda p: p["lon"] * 111_320.0 * F.cos(F.radians(mean))
    y = lambda p: p["lat"] * 110_574.0
    turned = F.concat(F.slice(points, F.lit(2), n), F.slice(points, 1, 1))
    cross = F.zip_with(points, turned, lambda p, q: x(p) * y(q) - x(q) * y(p))
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2)


def centroid(points: Column) -> Column:
    """struct(lat, lon): the mean of the corners."""
    n = F.greatest(F.size(points), F.lit(1))
    mean = lambda k: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[k]) / n
    return F.struct(mean("lat").alias("lat"), mean("lon").alias("lon"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if a side has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def location_match(city_a: Column, city_b: Column, country_a: Column, country_b: Column) -> Column:
    same = lambda a, b: (F.trim(F.lower(a)) != "") & (F.trim(F.lower(a)) == F.trim(F.lower(b)))
    return F.when(same(city_a, city_b), 1.0).when(same(country_a, country_b), 0.6).otherwise(0.0)


def year_match(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).when(F.abs(a - b) == 1, 0.5).otherwise(0.0)


def plausible_year(c: Column) -> Column:
    return F.coalesce(c.cast("string").try_cast("int").between(1990, 2030), F.lit(False))


def _lookup(values: dict[str, int], key: Column, default: int) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(table[key], F.lit(default))


def enrichment_score(r: dict[str, Column]) -> Column:
    """struct(score, confidence, tier, source, profile, contact, funding) of a record.

    ``r`` has the columns sources (array<string>), urls (array<string>), website, description, industry, city, country,
    founded_year, tags (array), employee_count, business_model, linkedin, founders (array), contact_info, funding_stage,
    total_funding and rounds (a number).
    """
    text = lambda k: F.coalesce(r[k].cast("string"), F.lit("")) != ""
    point = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    kinds = F.when(F.size(r["sources"]) > 0, r["sources"]).otherwise(F.array(F.lit("general")))
    best = F.array_max(F.transform(kinds, lambda k: _lookup(C.SOURCE_SCORE, k, 4)))
    trust = F.array_max(F.transform(kinds, lambda k: _lookup(C.SOURCE_CONFIDENCE, k, 10)))
    unique = F.greatest(F.size(F.array_distinct(F.filter(r["urls"], lambda u: u != ""))), F.lit(1))
    at = F.least(unique, F.lit(4)) + 1
    source = F.least(best + F.element_at(F.array(*map(F.lit, C.DIVERSITY_BONUS)), at), F.lit(35))
    site = F.contains(r["website"], F.lit("http"))
    long = F.size(words(F.coalesce(r["description"], F.lit("")))) >= 50
    place = text("city") & text("country")
    year = plausible_year(r["founded_year"])
    profile = point(site, 5) + point(long, 5) + point(text("industry"), 4) + point(place, 4) + point(year, 3) + point(F.size(r["tags"]) >= 2, 2) + point(text("employee_count") | text("business_model"), 2)
    linked, people, mail = F.contains(r["linkedin"], F.lit("linkedin.com")), F.size(r["founders"]) > 0, F.contains(r["contact_info"], F.lit("@"))
    contact = point(linked, 10) + point(people, 8) + point(mail, 7)
    stage = ~F.trim(F.lower(F.coalesce(r["funding_stage"], F.lit("")))).isin("unknown", "null", "none", "")
    funding = point(stage, 5) + point(r["total_funding"] > 0, 6) + point(r["rounds"] > 0, 4)
    filled = sum((point(c, 1) for c in (site, long, text("industry"), place, year, linked, people, mail, stage)), F.lit(0))
    bonus = F.element_at(F.array(*map(F.lit, C.CONFIDENCE_BONUS)), at) + F.when(filled >= 6, 10).when(filled >= 3, 5).otherwise(0)
    score = source + profile + contact + funding
    return F.struct(score.alias("score"), F.least(trust + bonus, F.lit(100)).alias("confidence"), tier_label(score).alias("tier"), source.alias("source"), profile.alias("profile"), contact.alias("contact"), funding.alias("funding"))


def tier_label(score: Column) -> Column:
    out = None
    for least, label in C.TIERS:
        out = F.when(score >= least, label) if out is None else out.when(score >= least, label)
    return out.otherwise(C.TIERS[-1][1])


def should_rescore(last: Column, url: Column, known: Column, now: Column, days: int = 7) -> Column:
    """Never scored, from a new address, or scored more than ``days`` days ago."""
    return last.isNull() | ~F.array_contains(known, url) | (F.datediff(now, last) > days)


def keyword_hits(text: Column, needles: Iterable[str]) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, needles)), lambda k: F.contains(low, F.lower(k)))


def classify_pair(name: Column, emb: Column, founders: Column, score: Column, overlap: Column, domain: Column) -> Column:
    """struct(outcome, risk, reason) from the signals of a pair, by the first rule that fits."""
    best = F.greatest(name, emb, founders)
    strong = sum(((c >= C.STRONG).cast("int") for c in (name, emb, founders)), F.lit(0))
    kind = lambda outcome, risk, reason: F.struct(F.lit(outcome).alias("outcome"), F.lit(risk).alias("risk"), F.lit(reason).alias("reason"))
    return (
        F.when(domain & (best < C.ANOMALY_GAP), kind("anomaly", "anomaly", "shared domain only"))
        .when(domain, kind("possible_duplicate", "high", "domain and another signal"))
        .when((overlap < C.OVERLAP_VETO) & (name < C.OVERLAP_NAME_CEILING), kind("no_match", "none", "nothing literal in common"))
        .when((founders >= C.STRONG) & ((name >= C.STRONG) | (emb >= C.STRONG)), kind("possible_duplicate", "high", "founder and another signal"))
        .when((name >= C.STRONG) & (emb >= C.STRONG), kind("possible_duplicate", "high", "name and description"))
        .when(strong >= 2, kind("possible_duplicate", "low", "two strong signals"))
        .when(score >= C.REVIEW_THRESHOLD, kind("possible_duplicate", "low", "score in the review band"))
        .otherwise(kind("no_match", "none", "not enough evidence"))
    )

"""Queries that score, triage and place records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import geo as G
from ..operators import matching as M
from ..operators import register as R
from ..session import table
from .registry import query


def _customer(spark, sf_dir):
    return table(spark, sf_dir, "customer")


_TIER = "CASE WHEN s >= 81 THEN 'PRIORITY' WHEN s >= 61 THEN 'HIGH_QUALITY_LEAD' WHEN s >= 41 THEN 'INTERESTING' WHEN s >= 21 THEN 'EARLY_DISCOVERY' ELSE 'WEAK_SIGNAL' END"


@query(f"""WITH r AS (SELECT c_custkey AS k, c_custkey % 5 AS m, c_acctbal AS bal FROM customer),
p AS (SELECT k, CASE WHEN m = 0 THEN 20 + 6 WHEN m = 1 THEN 12 ELSE 4 END AS src, CASE WHEN m < 3 THEN 5 ELSE 0 END + 4 + CASE WHEN m = 2 THEN 4 ELSE 0 END + CASE WHEN k % 60 BETWEEN 20 AND 59 THEN 3 ELSE 0 END + CASE WHEN m = 4 THEN 2 ELSE 0 END AS prof,
 CASE WHEN k % 7 = 0 THEN 10 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 8 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 7 ELSE 0 END AS con, CASE WHEN k % 4 <> 0 THEN 5 ELSE 0 END + CASE WHEN bal > 0 THEN 6 ELSE 0 END AS fund FROM r), t AS (SELECT *, src + prof + con + fund AS s FROM p)
SELECT k, s AS score, {_TIER} AS tier, src AS source, prof AS profile, con AS contact, fund AS funding FROM t""")
def enrichment_score(spark, sf_dir):
    k, m = F.col("c_custkey"), F.col("c_custkey") % 5
    words = lambda *w: F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")
    none = F.lit(None).cast("string")
    record = {
        "sources": F.when(m == 0, words("rss", "incubator")).when(m == 1, words("startup_network")).otherwise(words()),
        "urls": F.when(m == 0, words("http://a", "http://b", "http://a")).otherwise(words("http://a")),
        "website": F.when(m < 3, "https://x.org"), "description": F.lit("short"), "industry": F.col("c_mktsegment"),
        "city": F.when(m == 2, "Ulm"), "country": F.lit("Germany"), "founded_year": k % 60 + 1970, "tags": F.when(m == 4, words("a", "b")).otherwise(words("a")),
        "employee_count": none, "business_model": none, "linkedin": F.when(k % 7 == 0, "https://linkedin.com/x"), "founders": F.when(k % 3 == 0, words("A B")).otherwise(words()),
        "contact_info": F.when(k % 2 == 0, "a@b.c"), "funding_stage": F.when(k % 4 == 0, "Unknown").otherwise("Seed"), "total_funding": F.col("c_acctbal"), "rounds": F.lit(0),
    }
    s = _customer(spark, sf_dir).select(k.alias("k"), N.enrichment_score(record).alias("s"))
    return s.select("k", "s.score", "s.tier", "s.source", "s.profile", "s.contact", "s.funding")


@query(f"WITH r AS (SELECT CAST(floor(c_acctbal / 100) AS BIGINT) AS s FROM customer) SELECT {_TIER} AS tier, count(*) AS n FROM r GROUP BY 1")
def score_tiers(spark, sf_dir):
    return _customer(spark, sf_dir).groupBy(N.tier_label(F.floor(F.col("c_acctbal") / 100)).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


_REV = "CASE WHEN m IS NULL OR y IS NULL OR y < 2024 THEN NULL ELSE m >= 25 END"
_TRIAGE = "WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_size * 100 END AS e, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice / 40 END AS m, CASE WHEN p_partkey % 5 <> 0 THEN 2022 + p_size % 4 END AS y, p_size * 300.0 AS area, CASE p_partkey % 2 WHEN 0 THEN 'wikidata' ELSE 'osm' END AS src FROM part)\n"


def _triage(spark, sf_dir):
    k, z = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(k.alias("k"), F.when(k % 3 == 0, z * 100).alias("e"), F.when(k % 4 != 0, F.col("p_retailprice") / 40).alias("m"), F.when(k % 5 != 0, z % 4 + 2022).alias("y"), (z * 300.0).alias("area"), F.when(k % 2 == 0, "wikidata").otherwise("osm").alias("src"))


@query(_TRIAGE + f"SELECT k, CASE WHEN e IS NOT NULL THEN CASE WHEN e BETWEEN 100 AND 4000 THEN 1 ELSE 9 END WHEN {_REV} THEN 1 WHEN NOT ({_REV}) THEN 9 WHEN area >= 10000 THEN 2 WHEN src = 'wikidata' THEN 2 ELSE 3 END AS tier FROM r")
def triage_tier(spark, sf_dir):
    t = _triage(spark, sf_dir)
    return t.select("k", N.triage_tier(*[F.col(c) for c in ("e", "src", "area", "m", "y")], 2025).alias("tier"))


@query(_TRIAGE + f"SELECT k, {_REV} AS enough FROM r")
def revenue_three_valued(spark, sf_dir):
    return _triage(spark, sf_dir).select("k", N.enough_revenue(F.col("m"), F.col("y"), 2025).alias("enough"))


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 6 AS f, year(o_orderdate) AS y, CAST(o_orderkey % 900 + 1 AS BIGINT) AS v FROM orders)
SELECT k, CASE f WHEN 0 THEN v + 0.5 WHEN 1 THEN round(v * 1000.0, 2) WHEN 2 THEN 1000 + v / 1000.0 * 0 + 0.25 WHEN 3 THEN round((v + 1000000) / 1e6, 2) END AS millions, CASE WHEN f IN (0, 2) THEN y END AS year FROM r""")
def parse_revenue(spark, sf_dir):
    k, v, y = F.col("o_orderkey"), F.col("o_orderkey") % 900 + 1, F.year("o_orderdate")
    f = k % 6
    text = (
        F.when(f == 0, F.concat(v, F.lit(",5 Mio. EUR ("), y, F.lit(")"))).when(f == 1, F.concat(v, F.lit(" Mrd EUR")))
        .when(f == 2, F.concat(F.lit("1.000,25 Millionen in "), y)).when(f == 3, F.concat(v + 1_000_000, F.lit(" EUR")))
        .when(f == 4, v.cast("string")).otherwise("unknown")
    )
    return table(spark, sf_dir, "orders").select(k.alias("k"), N.revenue(text).alias("r")).select("k", "r.millions", "r.year")


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN 1000 + s_suppkey ELSE CASE WHEN s_suppkey > 0 THEN s_suppkey END END AS n FROM supplier")
def parse_employees(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.when(k % 3 == 0, "??").when(k % 3 == 1, F.concat(F.lit("ca. "), F.format_number(k + 1000, 0))).otherwise(F.concat(k, F.lit(" Mitarbeiter")))
    return table(spark, sf_dir, "supplier").select(k.alias("k"), N.employees(text).alias("n"))


_GEO = "(SELECT s_suppkey AS id, 48.0 + (s_suppkey * 37 % 180 - 90) / 100.0 AS lat, 10.2 + (s_suppkey * 61 % 180 - 90) / 80.0 AS lon FROM supplier)"
_KM = "2 * 6371.0 * asin(sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)))"


def _points(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), (48.0 + (k * 37 % 180 - 90) / 100.0).alias("lat"), (10.2 + (k * 61 % 180 - 90) / 80.0).alias("lon"))


@query(f"SELECT id, round({_KM.format(a='47.98', b='10.18', c='lat', d='lon')}, 2) AS km FROM {_GEO} WHERE {_KM.format(a='47.98', b='10.18', c='lat', d='lon')} <= 50")
def haversine_radius(spark, sf_dir):
    d = N.haversine_km(F.lit(47.98), F.lit(10.18), F.col("lat"), F.col("lon"))
    return _points(spark, sf_dir).withColumn("km", d).filter("km <= 50").select("id", F.round("km", 2).alias("km"))


@query(f"""WITH g AS (SELECT i, j, 47.98 + i * 4.0 / 110.574 AS lat, 10.18 + j * 4.0 / (111.320 * cos(radians(47.98))) AS lon FROM generate_series(-13, 13) a(i), generate_series(-13, 13) b(j))
SELECT i, j, round(lat, 6) AS lat, round(lon, 6) AS lon FROM g WHERE {_KM.format(a='47.98', b='10.18', c='lat', d='lon')} <= 54""")
def tile_grid(spark, sf_dir):
    return G.tile_grid(spark, 47.98, 10.18).select("i", F.col("j").cast("long").alias("j"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("""WITH p AS (SELECT s_suppkey AS id, 48.0 + s_suppkey % 50 / 100.0 AS a, 10.0 AS b, 0.0005 + s_suppkey % 7 / 10000.0 AS d FROM supplier)
SELECT id, round(d * 110574.0 * d * 111320.0 * cos(radians((a + a + (a + d) + (a + d)) / 4)), 1) AS area FROM p""")
def polygon_area(spark, sf_dir):
    k = F.col("s_suppkey")
    a, b, d = 48.0 + k % 50 / 100.0, F.lit(10.0), 0.0005 + k % 7 / 10000.0
    point = lambda x, y: F.struct(x.alias("lat"), y.alias("lon"))
    ring = F.array(point(a, b), point(a, b + d), point(a + d, b + d), point(a + d, b))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.round(N.polygon_area_m2(ring), 1).alias("area"))


@query(f"""WITH p AS (SELECT id, lat, lon, 'Firm ' || chr(CAST(65 + id % 26 AS INT)) AS name FROM {_GEO}), b AS (SELECT id * 10 + o AS osm, lat + o * 0.0001 AS blat, lon AS blon, CASE WHEN id % 3 = 0 AND o = 2 THEN 'firm ' || lower(chr(CAST(65 + id % 26 AS INT))) || ' gmbh' END AS bname, o, id AS owner FROM p, (VALUES (1), (2)) t(o) WHERE id % 4 <> 0 OR o = 1),
d AS (SELECT p.id, osm, bname, name, {_KM.format(a='p.lat', b='p.lon', c='blat', d='blon')} * 1000 AS m FROM p JOIN b ON abs(blat - lat) < 0.001 AND abs(blon - lon) < 0.002), r AS (SELECT * FROM d WHERE m <= 40),
n AS (SELECT id, count(*) AS n, arg_min(osm, osm) FILTER (lower(name) || ' gmbh' = bname) AS named, arg_min(m, osm) FILTER (lower(name) || ' gmbh' = bname) AS nm, arg_min(osm, m) AS near, min(m) AS dm FROM r GROUP BY id)
SELECT id AS point_id, coalesce(named, near) AS osm_id, CASE WHEN named IS NOT NULL THEN 'name_match' ELSE 'unambiguous_nearest' END AS method, round(coalesce(nm, dm), 1) AS distance_m FROM n WHERE named IS NOT NULL OR (n = 1 AND dm <= 15)""")
def spatial_unambiguous_nearest(spark, sf_dir):
    letter = F.char((65 + F.col("id") % 26).cast("int"))
    p = _points(spark, sf_dir).withColumn("name", F.concat(F.lit("Firm "), letter))
    b = p.withColumn("o", F.explode(F.array(F.lit(1), F.lit(2)))).filter("id % 4 <> 0 OR o = 1")
    named = F.when((F.col("id") % 3 == 0) & (F.col("o") == 2), F.concat(F.lit("firm "), F.lower(letter), F.lit(" gmbh")))
    b = b.select((F.col("id") * 10 + F.col("o")).alias("osm_id"), named.alias("building_name"), (F.col("lat") + F.col("o") * 0.0001).alias("blat"), F.col("lon").alias("blon"))
    return M.spatial_match(p.select(F.col("id").alias("point_id"), "name", "lat", "lon"), b)


@query(r"""WITH n AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN p_name || ' GmbH' WHEN 1 THEN 'Halle ' || p_partkey % 30 WHEN 2 THEN 'A, B, ' || p_name WHEN 3 THEN 'Sparkasse ' || p_name WHEN 4 THEN 'Q' || p_partkey ELSE p_name || ' (Unternehmen)' END AS name FROM part)
SELECT k, p AS accepted FROM (SELECT k, k % 6 IN (0, 5) AS p FROM n)""")
def prospect_gate(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_name")
    name = F.when(k % 6 == 0, F.concat(n, F.lit(" GmbH"))).when(k % 6 == 1, F.concat(F.lit("Halle "), k % 30)).when(k % 6 == 2, F.concat(F.lit("A, B, "), n)).when(k % 6 == 3, F.concat(F.lit("Sparkasse "), n)).when(k % 6 == 4, F.concat(F.lit("Q"), k)).otherwise(F.concat(n, F.lit(" (Unternehmen)")))
    return table(spark, sf_dir, "part").select(k.alias("k"), R.accept(name, ["sparkasse", "bank", "klinikum"], ["halle", "tor", "werk"]).alias("accepted"))


@query(f"""WITH p AS (SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE lat END AS lat, {_KM.format(a='47.98', b='10.18', c='lat', d='lon')} AS km FROM {_GEO})
SELECT CASE WHEN id % 7 = 0 THEN 'junk' WHEN lat IS NULL THEN 'needs_geocoding' WHEN km > 50 THEN 'out_of_radius' ELSE 'kept' END AS label, count(*) AS n FROM p GROUP BY 1""")
def candidate_split(spark, sf_dir):
    p = _points(spark, sf_dir)
    km = N.haversine_km(F.lit(47.98), F.lit(10.18), F.col("lat"), F.col("lon"))
    label = G.catchment_label(F.col("id") % 7 == 0, F.when(F.col("id") % 9 != 0, F.col("lat")), km)
    return p.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def supplier_points(spark, sf_dir):
    """Suppliers on the map, thick in the middle."""
    k = F.col("s_suppkey")
    away = F.pow((k % 97) / 97.0, 3) * 0.4
    turn = (k * 7 % 360) * 0.017453292519943295
    return table(spark, sf_dir, "supplier").select(k.alias("id"), (48.0 + away * F.sin(turn)).alias("lat"), (10.0 + away * F.cos(turn)).alias("lon"))


def sweep_tiles(spark):
    g = G.tile_grid(spark, 48.0, 10.0, radius_km=24.0, tile_km=8.0)
    return g.select("lat", "lon", F.lit(8000.0).alias("radius_m"), (F.col("i") * 1000 + F.col("j")).alias("place"))


@query()
def adaptive_sweep(spark, sf_dir):
    """The calls of a sweep over all suppliers, quartering full tiles until a budget of sixty calls is spent."""
    calls, _ = G.sweep(supplier_points(spark, sf_dir), sweep_tiles(spark), max_calls=60, cap=5)
    return calls.select("call", "level", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "radius_m", "found", "full")


@query()
def sweep_finds(spark, sf_dir):
    """Which suppliers the sweep finds, and by which call first."""
    return G.sweep(supplier_points(spark, sf_dir), sweep_tiles(spark), max_calls=60, cap=5)[1]

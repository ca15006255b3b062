"""Queries of the register and of sites' profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import policy as P
from ..operators import browse as B
from ..operators import profiles as R
from ..operators import stewardship as S
from ..scratch import scratch
from ..session import table
from ..sources import formats
from .registry import query

_REG = """WITH r AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS distance, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey * 10 END AS employees, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_nationkey % 4 END AS tier, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal < 5000 END AS inside, c_mktsegment AS source FROM customer)
"""


def _register(spark, sf_dir):
    k, unless = F.col("c_custkey"), lambda n, c: F.when(F.col("c_custkey") % n != 0, c)
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_name").alias("name"), unless(7, F.col("c_acctbal")).alias("distance"), unless(5, F.col("c_nationkey") * 10).alias("employees"),
        unless(9, F.col("c_nationkey") % 4).alias("tier"), unless(11, F.col("c_acctbal") < 5000).alias("inside"), F.col("c_mktsegment").alias("source"),
    )


_MENU = {"distance": "distance", "employees": "employees", "tier": "tier", "name": "name"}
_ORDERS = {"distance": "distance NULLS LAST", "employees": "employees DESC NULLS LAST", "tier": "tier NULLS LAST, distance NULLS LAST", "name": "name DESC NULLS LAST"}


@query(_REG + " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS sort, id, row_number() OVER (ORDER BY {o}, id) AS place FROM r) WHERE place BETWEEN 6 AND 35" for k, o in _ORDERS.items()))
def register_menu(spark, sf_dir):
    """A page of the register by each entry of its sort menu."""
    out, r = None, _register(spark, sf_dir)
    for k, o in _ORDERS.items():
        p = B.register_page(r, _MENU, "id", k, descending=True, limit=30, offset=5)
        ids = p.agg(F.collect_list("id").alias("ids"))  # thirty of them, in order
        p = ids.select(F.lit(k).alias("sort"), F.posexplode("ids").alias("place", "id")).select("sort", "id", (F.col("place") + 6).cast("long").alias("place"))
        out = p if out is None else out.unionByName(p)
    return out


@query(_REG + "SELECT count(*) AS total, count(*) FILTER (inside) AS in_radius, count(*) FILTER (NOT inside) AS out_of_radius, count(*) FILTER (inside AND employees IS NOT NULL) AS with_employees, count(*) FILTER (inside AND distance IS NOT NULL) AS with_distance, count(*) FILTER (inside AND tier IS NOT NULL) AS triaged FROM r")
def register_counts(spark, sf_dir):
    has = {"with_employees": "employees", "with_distance": "distance", "triaged": "tier"}
    return R.register_stats(_register(spark, sf_dir), F.col("inside"), {k: F.col(c).isNotNull() for k, c in has.items()})


_TIERS = {0: "first", 1: "second", 2: "third"}


@query(_REG + """SELECT 'tier' AS kind, CAST(tier AS VARCHAR) AS value, CASE tier WHEN 0 THEN 'first' WHEN 1 THEN 'second' WHEN 2 THEN 'third' ELSE '?' END AS label, count(*) AS n FROM r WHERE inside GROUP BY ALL UNION ALL SELECT 'source', source, NULL, count(*) FROM r GROUP BY ALL""")
def register_groups(spark, sf_dir):
    """Records within by tier, and all by source."""
    return R.stats_by(_register(spark, sf_dir), F.col("inside"), F.col("tier"), F.col("source"), _TIERS)


@query(_REG + "SELECT id, name, employees, distance FROM r WHERE inside AND tier = 2")
def register_export(spark, sf_dir):
    """Records that a filter leaves, out as a marked sheet and back."""
    where, out = F.col("inside") & B.criteria(equal={"tier": 2}), scratch(spark, "export")
    formats.export_register(_register(spark, sf_dir), out, {"id": "Nr", "name": "Firma", "employees": "Mitarbeiter", "distance": "Entfernung (km)"}, [F.col("distance").asc_nulls_last(), F.col("id")], where)
    back = formats.sheet(spark, out, "Nr;Firma;Mitarbeiter;Entfernung (km)\n1;a;2;3", required="firma")
    return back.select(F.col("nr").cast("long").alias("id"), F.col("firma").alias("name"), F.col("mitarbeiter").cast("long").alias("employees"), F.col("entfernungkm").cast("double").alias("distance"))


@query(_REG + "SELECT source AS method, count(*) AS n, count(distance) AS measured, count(*) FILTER (distance >= 4000) AS large, count(*) FILTER (distance >= 4000 AND employees IS NULL) AS promotable FROM r GROUP BY 1")
def promotion_counts(spark, sf_dir):
    """Measured sizes by how they were found, and those that would move a record of unknown size up."""
    return R.promotion_counts(_register(spark, sf_dir), F.col("distance"), F.col("source"), F.col("employees"), 4000)


_HOST = "regexp_replace(regexp_extract(lower(u), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^www\\.', '')"


@query(f"""WITH s AS (SELECT page_id, url AS u FROM pages UNION ALL SELECT page_id + 100000, 'https://www.' || (CASE page_id % 5 WHEN 0 THEN 'linkedin.com' WHEN 1 THEN 'de.wikipedia.org' WHEN 2 THEN 'mytech.eu' WHEN 3 THEN 'a.tech.eu' ELSE 'x.com.de' END) || '/' || url FROM pages),
h AS (SELECT *, {_HOST} AS host FROM s), b AS (SELECT unnest({[*C.SHARED_DOMAINS, *C.REPORTING_DOMAINS]}) AS d), p AS (SELECT unnest({C.DIRECTORY_HOSTS}) AS d)
SELECT page_id, host <> '' AND NOT EXISTS (SELECT 1 FROM b WHERE host = d OR ends_with(host, '.' || d)) AS official, NOT EXISTS (SELECT 1 FROM p WHERE contains(lower(u), d)) AS unlisted FROM h""")
def official_sites(spark, sf_dir):
    """Addresses that can be an organisation's own, by host and by part."""
    p, k = table(spark, sf_dir, "pages").select("page_id", "url"), F.col("page_id") % 5
    host = F.when(k == 0, "linkedin.com").when(k == 1, "de.wikipedia.org").when(k == 2, "mytech.eu").when(k == 3, "a.tech.eu").otherwise("x.com.de")
    more = p.select((F.col("page_id") + 100000).alias("page_id"), F.concat(F.lit("https://www."), host, F.lit("/"), "url").alias("url"))
    return p.unionByName(more).select("page_id", P.official_site(F.col("url")).alias("official"), P.unlisted_site(F.col("url")).alias("unlisted"))


_JUNK = """WITH r AS (SELECT page_id AS id, url ILIKE '%example.ORG%' AND (html IS NULL OR html = '' OR page_id % 3 = 0) AND page_id % 4 <> 1 AS junk FROM pages)
"""


def _junk(spark, sf_dir):
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    return p.select(k.alias("id"), R.domain_junk(F.col("url"), "example.ORG", F.when(k % 3 != 0, F.col("html")), F.when(k % 4 == 1, F.col("url"))).alias("junk"))


@query(_JUNK + "SELECT 'record' AS kind, id FROM r WHERE NOT junk UNION ALL SELECT 'review', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT id FROM r WHERE junk) AND o_orderkey % 50 NOT IN (SELECT id FROM r WHERE junk)")
def domain_purge(spark, sf_dir):
    """Records and reviews that are left once what a domain's pages gave without evidence is gone."""
    r = _junk(spark, sf_dir)
    gone = r.where("junk").select("id")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 50).alias("b"))
    left = S.without_records(o, gone, "a", "b").select(F.lit("review").alias("kind"), F.col("o_orderkey").alias("id"))
    return r.where("NOT junk").select(F.lit("record").alias("kind"), "id").unionByName(left)


_PROFILES = r"""WITH u AS (SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p, length(html) AS n FROM pages),
pr AS (SELECT host, CASE WHEN page_id % 6 = 0 THEN p || '/*' WHEN page_id % 6 = 1 THEN p || '//' ELSE p END AS pattern, CASE WHEN page_id % 8 = 0 THEN NULL ELSE n % 40 END AS expected FROM u),
so AS (SELECT page_id AS id, host, 'https://' || host || '/start' AS primary_url FROM u)
"""


def _profiles(spark, sf_dir):
    k, url = F.col("page_id"), F.col("url")
    u = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(F.lower(url), "^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1).alias("p"), F.length("html").alias("n"))
    pattern = F.when(k % 6 == 0, F.concat("p", F.lit("/*"))).when(k % 6 == 1, F.concat("p", F.lit("//"))).otherwise(F.col("p"))
    profiles = u.select("host", pattern.alias("pattern"), F.when(k % 8 != 0, F.col("n") % 40).alias("expected"))
    return u.select(k.alias("id"), "host", F.concat(F.lit("https://"), "host", F.lit("/start")).alias("primary_url")), profiles


@query(_PROFILES + """, ok AS (SELECT host, rtrim(pattern, '/') AS path, expected FROM pr WHERE expected >= 5 AND rtrim(pattern, '/') <> '' AND NOT contains(pattern, '*')), b AS (SELECT host, path, row_number() OVER (PARTITION BY host ORDER BY expected DESC, path) AS n FROM ok)
SELECT so.*, coalesce('https://' || so.host || b.path, primary_url) AS url, b.path IS NOT NULL AS known FROM so LEFT JOIN b ON b.host = so.host AND n = 1""")
def listing_pages(spark, sf_dir):
    """Where to list each source from: its best known page, or its address."""
    sources, profiles = _profiles(spark, sf_dir)
    return R.listing_pages(sources, profiles, "host", "pattern", "expected", "primary_url")


@query("""WITH p AS (SELECT s_suppkey AS site, s_nationkey AS pattern, CASE WHEN s_suppkey % 2 = 0 THEN 'logo_grid' END AS shape, CASE WHEN s_suppkey % 3 = 0 THEN true END AS render, CASE WHEN s_suppkey % 4 = 0 THEN s_nationkey END AS expected FROM supplier WHERE s_acctbal > 3000),
s AS (SELECT c_custkey % 10 AS site, c_nationkey AS pattern, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT s.site, s.pattern, n, coalesce(shape, 'unknown') AS shape, coalesce(render, false) AS render, coalesce(expected, 0) AS expected, CASE WHEN p.site IS NULL THEN 'default' ELSE 'learned' END AS source FROM s LEFT JOIN p ON p.site = s.site AND p.pattern = s.pattern""")
def profile_strategies(spark, sf_dir):
    """The strategy of each source's profile, open fields filled; all defaults where there is none."""
    k = F.col("s_suppkey")
    p = table(spark, sf_dir, "supplier").where("s_acctbal > 3000").select(k.alias("site"), F.col("s_nationkey").alias("pattern"), F.when(k % 2 == 0, "logo_grid").alias("shape"), F.when(k % 3 == 0, True).alias("render"), F.when(k % 4 == 0, F.col("s_nationkey")).alias("expected"), F.lit(None).cast("string").alias("source"))
    s = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 10).alias("site"), F.col("c_nationkey").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    return R.strategies(s, p, ["site", "pattern"], {f: R.DEFAULTS[f] for f in ("shape", "render", "expected", "source")})


@query("""WITH p AS (SELECT s_nationkey AS site, min(s_suppkey) AS expected, max(s_acctbal) AS probed_at FROM supplier GROUP BY 1), g AS (SELECT c_nationkey AS site, min(c_acctbal) AS probed_at FROM customer GROUP BY 1)
SELECT site, CAST(expected AS BIGINT) AS expected, probed_at FROM p UNION ALL SELECT site, 0, NULL FROM g WHERE site NOT IN (SELECT site FROM p)""")
def guessed_profiles(spark, sf_dir):
    """Profiles and, where there is none, guesses, which never take a real one's place."""
    p = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("site")).agg(F.min("s_suppkey").alias("expected"), F.max("s_acctbal").alias("probed_at"))
    g = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("site"), F.col("c_custkey").alias("expected"), F.col("c_acctbal").alias("probed_at"))
    return R.with_guesses(p, g, ["site"])


@query("""WITH i AS (SELECT DISTINCT o_custkey * 2 AS id FROM orders WHERE o_orderstatus = 'P'), r AS (SELECT doc_id AS id, coalesce(CASE WHEN lang = 'en' THEN '' ELSE text END, '') <> '' AS has FROM documents)
SELECT i.id, CASE WHEN r.id IS NULL THEN 'missing' WHEN has THEN 'recheck' ELSE 'no_excerpt' END AS task FROM i LEFT JOIN r ON r.id = i.id""")
def picked_work(spark, sf_dir):
    """What to do with records that were picked by hand."""
    ids = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select((F.col("o_custkey") * 2).alias("id"))
    r = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    return R.work_list(r, ids, "id", F.when(F.col("lang") != "en", F.col("text")))


@query(r"""WITH w AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS value FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS w FROM documents WHERE lang = 'en')), f AS (SELECT value, min((doc_id, pos)) AS first FROM w GROUP BY 1) SELECT value, row_number() OVER (ORDER BY first) AS place FROM f""")
def vocabulary_order(spark, sf_dir):
    """The different words of the texts of a language by where they first stand."""
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0)).alias("w"))
    return R.in_first_order(d, ["doc_id"], "w")

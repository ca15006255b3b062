"""Queries of identity ladders, look-ups, queues, reports and progress."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import numeric as N
from ..functions.text import header_key
from ..operators import geo as G
from ..operators import matching as M
from ..operators import register as R
from ..operators import stewardship as S
from ..operators.extraction import merge_by_name as merged_by_name
from ..scratch import scratch, written
from ..operators.ordering import running
from ..session import table
from ..sources import formats
from .matching import _LCS
from .registry import query

#: Rows (p_brand, name) of the parts, each the smallest key, in the city that its type names.
_CO = _LCS + """, c AS (SELECT min(p_partkey) AS id, p_name AS name, CASE WHEN p_brand = 'Brand#1' THEN '' ELSE 'City ' || p_brand END AS city FROM part GROUP BY p_name, p_brand),
q AS (SELECT x.id AS a, y.id AS b, x.name AS n, y.name AS m, CASE WHEN x.city = '' OR y.city = '' THEN NULL ELSE x.city = y.city END AS place FROM c x JOIN c y ON x.id < y.id),
i AS (SELECT n.name, n.id FROM n), d AS (SELECT q.*, CASE WHEN n = m THEN 100 ELSE e.ratio END AS r FROM q JOIN i u ON u.name = q.n JOIN i w ON w.name = q.m LEFT JOIN e ON e.a = least(u.id, w.id) AND e.b = greatest(u.id, w.id))
"""


@query(_CO + """SELECT a, b FROM d WHERE n = m OR (least(length(n), length(m)) >= 6 AND (starts_with(n, m) OR starts_with(m, n))) OR (place AND string_split(n, ' ')[2] = string_split(m, ' ')[2] AND string_split(n, ' ')[1] = string_split(m, ' ')[1])
 OR (place AND list_has_any(list_filter(string_split(n, ' '), lambda w: w <> 'small'), list_filter(string_split(m, ' '), lambda w: w <> 'small')) AND (CASE WHEN contains(n, 'small') AND contains(m, 'small') THEN n = m WHEN contains(n, 'small') OR contains(m, 'small') THEN false ELSE r >= 80 END OR (contains(n, 'small') <> contains(m, 'small') AND false)))
 OR (NOT place AND r >= 95) OR (place IS NULL AND r >= 88)""")
def same_company_pairs(spark, sf_dir):
    """Names in places: one company or not, by the rule for the same, another or an unknown place."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name"), "p_brand").agg(F.min("p_partkey").alias("id"))
    rows = p.select("id", "name", F.when(F.col("p_brand") == "Brand#1", "").otherwise(F.concat(F.lit("City "), "p_brand")).alias("city"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    return M.company_pairs(rows, "id", "name", "city", "lat", "lon", ["small"])


#: Suppliers as masters, every third without a website; customers as incoming records of the same names.
_ID = """WITH m AS (SELECT s_suppkey AS id, 'firm ' || (s_suppkey % 60) AS n, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'site' || (s_suppkey % 60) || '.com' END AS d, s_acctbal AS age FROM supplier),
i AS (SELECT c_custkey AS q, 'firm ' || (c_custkey % 70) AS n, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'site' || (c_custkey % 60) || '.com' END AS d FROM customer),
f AS (SELECT n, d, arg_min(id, {'a': age, 'i': id}) AS id FROM m WHERE d IS NOT NULL GROUP BY n, d), w AS (SELECT n, arg_min(id, {'a': age, 'i': id}) AS id FROM m WHERE d IS NULL GROUP BY n)
"""


@query(_ID + "SELECT q, coalesce(f.id, CASE WHEN i.d IS NULL THEN w.id END) AS master_id, CASE WHEN f.id IS NOT NULL THEN 'fingerprint' WHEN i.d IS NULL AND w.id IS NOT NULL THEN 'name' ELSE 'none' END AS by FROM i LEFT JOIN f ON f.n = i.n AND f.d = i.d LEFT JOIN w ON w.n = i.n")
def identity_join(spark, sf_dir):
    """Incoming records by exact identity: the fingerprint of name and own domain, else the name among masters without
    a website, of which the oldest wins."""
    site = lambda k, none: F.when(k % none != 0, F.concat(F.lit("https://www.site"), k % 60, F.lit(".com/about")))
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    k = F.col("s_suppkey")
    m = s.select(k.alias("id"), F.concat(F.lit("Firm "), k % 60, F.lit(" GmbH")).alias("name"), site(k, 3).alias("site"), F.col("s_acctbal").alias("age"))
    k = F.col("c_custkey")
    i = c.select(k.alias("q"), F.concat(F.lit(" firm  "), k % 70).alias("name"), site(k, 4).alias("site"))
    own = I.identity_domain(F.col("site"))
    print_of = F.when(own.isNotNull(), I.fingerprint(F.col("name"), F.col("site")))
    m = m.withColumns({"fp": print_of, "n": F.when(own.isNull(), I.normalize_name(F.col("name")))})
    i = i.withColumns({"fp": print_of, "n": F.when(own.isNull(), I.normalize_name(F.col("name")))})
    by_print, by_name = S.oldest(m, "fp", "age", "id"), S.oldest(m, "n", "age", "id").withColumnRenamed("id", "id2")
    rows = i.join(by_print, "fp", "left").join(by_name, "n", "left")
    by = F.when(F.col("id").isNotNull(), "fingerprint").when(F.col("id2").isNotNull(), "name").otherwise("none")
    return rows.select("q", F.coalesce("id", "id2").alias("master_id"), by.alias("by"))


@query(_LCS + """, k AS (SELECT id, name FROM n WHERE id % 2 = 0), w AS (SELECT id, name FROM n WHERE id % 2 = 1), x AS (SELECT a, b, ratio FROM e UNION ALL SELECT b, a, ratio FROM e)
SELECT w.id, min(k.id) AS pool_id, CASE WHEN min(k.id) IS NULL THEN 'new' ELSE 'known' END AS state FROM w LEFT JOIN x ON x.a = w.id AND x.ratio >= 80 LEFT JOIN k ON k.id = x.b GROUP BY w.id""")
def new_or_known(spark, sf_dir):
    """Names against a pool: the first match in the pool's order, or new."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    ask, pool = names.filter("id % 2 = 1"), names.filter("id % 2 = 0")
    found = M.name_pairs(ask.withColumnRenamed("id", "a"), pool.withColumnRenamed("id", "b"), "a", "b", "name", 80.0)
    first = found.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("pool_id"))
    return ask.select("id").join(first, "id", "left").withColumn("state", F.when(F.col("pool_id").isNull(), "new").otherwise("known"))


@query("""WITH p AS (SELECT DISTINCT o_custkey % 25 AS site, '/' || o_orderstatus || '/*' AS pattern, 1 AS x FROM orders WHERE o_totalprice > 200000), r AS (SELECT c_custkey AS id, c_nationkey AS site, '/' || substr('FOP', 1 + CAST(c_custkey % 3 AS INT), 1) || '/item-' || c_custkey AS path, c_custkey % 4 = 0 AS strict FROM customer)
SELECT r.id, CASE WHEN p.x IS NOT NULL THEN p.pattern WHEN NOT strict AND r.site % 2 = 0 THEN 'default' END AS profile FROM r LEFT JOIN p ON p.site = r.site AND starts_with(r.path, substr(p.pattern, 1, 3))""")
def most_specific_profile(spark, sf_dir):
    """A site's profile for a page's pattern, else its default unless only an exact one will do."""
    p = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select((F.col("o_custkey") % 25).alias("site"), F.concat(F.lit("/"), "o_orderstatus", F.lit("/*")).alias("pattern")).distinct()
    c = table(spark, sf_dir, "customer")
    url = F.concat(F.lit("https://x.org/"), F.substring(F.lit("FOP"), F.col("c_custkey").cast("int") % 3 + 1, F.lit(1)), F.lit("/item-"), "c_custkey")
    r = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("site"), I.path_pattern(url).alias("pattern"), (F.col("c_custkey") % 4 == 0).alias("strict"))
    site = spark.range(0, 25, 2).select(F.col("id").alias("site"), F.lit("default").alias("fallback"))
    rows = r.join(p.withColumn("exact", F.col("pattern")), ["site", "pattern"], "left").join(F.broadcast(site), "site", "left")
    return rows.select("id", F.coalesce("exact", F.when(~F.col("strict"), F.col("fallback"))).alias("profile"))


@query("""SELECT c_custkey, row_number() OVER (ORDER BY t NULLS FIRST, d NULLS LAST, c_custkey) AS place FROM (SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_nationkey END AS t, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS d FROM customer) ORDER BY place LIMIT 100""")
def enrichment_queue(spark, sf_dir):
    """The next hundred records: never attempted first, then the nearest."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey")).alias("t"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("d"))
    top = c.orderBy(F.col("t").asc_nulls_first(), F.col("d").asc_nulls_last(), "c_custkey").limit(100)
    return top.select("c_custkey", F.row_number().over(Window.orderBy(F.col("t").asc_nulls_first(), F.col("d").asc_nulls_last(), "c_custkey")).cast("long").alias("place"))


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS description, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'x' END AS website, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'not_found' ELSE 'thin' END AS reason, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS classified, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'saas' END AS model FROM orders)
SELECT count(*) AS total, count(*) FILTER (description IS NULL AND website IS NULL AND coalesce(reason, '') <> 'not_found') AS stubs, count(*) FILTER (classified IS NULL OR model IS NULL) AS unclassified, count(*) FILTER (classified IS NOT NULL AND model IS NOT NULL) AS classified FROM r""")
def backlog_sizes(spark, sf_dir):
    """How many records wait for a first search, or for a classification."""
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(F.when(k % 3 != 0, F.col("o_orderpriority")).alias("description"), F.when(F.col("o_orderstatus") != "P", "x").alias("website"), F.when(k % 5 == 1, "not_found").when(k % 5 > 1, "thin").alias("reason"), F.when(k % 4 != 0, F.col("o_orderdate")).alias("at"), F.when(k % 7 != 0, "saas").alias("model"))
    stub = F.col("description").isNull() & F.col("website").isNull() & (F.col("reason").isNull() | ~F.col("reason").isin("not_found"))
    open_ = F.col("at").isNull() | F.col("model").isNull()
    return r.agg(F.count(F.lit(1)).alias("total"), F.count_if(stub).alias("stubs"), F.count_if(open_).alias("unclassified"), F.count_if(~open_).alias("classified"))


@query("""WITH t AS (SELECT max(ts) AS now FROM events), r AS (SELECT event_type AS source, count(*) AS n, count(*) FILTER (value > 5) AS done, max(ts) FILTER (value > 5) AS last FROM events GROUP BY 1)
SELECT source, n, done, last, coalesce(date_diff('second', last, now) < 600, false) AS active, round((n - done) * 2.3::DOUBLE, 1) AS minutes_left FROM r, t""")
def enrichment_progress(spark, sf_dir):
    """By source: how far, when last, whether it is running, and how long it will take."""
    e = table(spark, sf_dir, "events")
    r = e.groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 5).alias("done"), F.max(F.when(F.col("value") > 5, F.col("ts"))).alias("last"))
    now = e.agg(F.max("ts").alias("now"))  # one row
    return r.crossJoin(F.broadcast(now)).select("source", "n", "done", "last", F.coalesce(F.unix_timestamp("now") - F.unix_timestamp("last") < 600, F.lit(False)).alias("active"), F.round((F.col("n") - F.col("done")) * 2.3, 1).alias("minutes_left"))


@query("""SELECT event_type AS source, count(*) AS chunks, count(*) FILTER (value < 2) AS filtered, round(coalesce(100.0 * count(*) FILTER (value < 2) / nullif(count(*), 0), 0), 2) AS filtered_pct, round(coalesce(100.0 * count(*) FILTER (value > 9) / nullif(count(*) FILTER (value >= 2), 0), 0), 2) AS failed_pct, count(DISTINCT user_id) AS pages FROM events GROUP BY 1""")
def run_report(spark, sf_dir):
    """A run's counters as shares, zero where there is nothing to divide by."""
    v = F.col("value")
    share = lambda a, b: F.round(F.coalesce(F.try_divide(100.0 * a, b), F.lit(0.0)), 2)
    filtered, failed, called = F.count_if(v < 2), F.count_if(v > 9), F.count_if(v >= 2)
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("chunks"), filtered.alias("filtered"), share(filtered, F.count(F.lit(1))).alias("filtered_pct"), share(failed, called).alias("failed_pct"), F.countDistinct("user_id").alias("pages"))


@query("""WITH p AS (SELECT user_id AS page, arg_max(CAST(floor(value * 10) AS BIGINT), event_id) AS expected, count(DISTINCT event_type) * 10 AS found, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1)
SELECT page, expected, failures, sum(expected) OVER (ORDER BY page ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM p""")
def expectations(spark, sf_dir):
    """The last expectation of each page, its failures, and the running total of what is expected."""
    e = table(spark, sf_dir, "events")
    p = e.groupBy(F.col("user_id").alias("page")).agg(F.max_by(F.floor(F.col("value") * 10), "event_id").alias("expected"), F.count_if(F.col("event_type") == "error").alias("failures"))
    return running(p, ["page"], {"running": F.col("expected")})


@query("""WITH p AS (SELECT o_custkey AS page, count(*) AS expected, count(*) FILTER (o_orderstatus = 'F') AS got FROM orders GROUP BY 1), r AS (SELECT *, got / expected AS recall FROM p)
SELECT CASE WHEN recall >= 0.9 THEN 'full' WHEN recall >= 0.6 THEN 'most' WHEN recall > 0 THEN 'some' ELSE 'none' END AS bucket, count(*) AS pages, round(sum(got)::DOUBLE / sum(expected), 4) AS weighted, round(avg(recall), 4) AS mean FROM r GROUP BY 1""")
def recall_report(spark, sf_dir):
    """Recall by bucket, weighted by entities and by page."""
    p = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("o_orderstatus") == "F").alias("got"))
    r = p.withColumn("recall", F.col("got") / F.col("expected"))
    bucket = F.when(F.col("recall") >= 0.9, "full").when(F.col("recall") >= 0.6, "most").when(F.col("recall") > 0, "some").otherwise("none")
    return r.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("pages"), F.round(F.sum("got") / F.sum("expected"), 4).alias("weighted"), F.round(F.avg("recall"), 4).alias("mean"))


@query("""WITH a AS (SELECT DISTINCT lower(p_name) AS n FROM part WHERE p_size < 6), b AS (SELECT DISTINCT lower(p_name) AS n FROM part WHERE p_size > 45) SELECT coalesce(a.n, b.n) AS name, CASE WHEN b.n IS NULL THEN 'lost' WHEN a.n IS NULL THEN 'gained' ELSE 'both' END AS state FROM a FULL JOIN b ON a.n = b.n""")
def names_lost_gained(spark, sf_dir):
    """Names of two runs: in both, lost or gained."""
    p = table(spark, sf_dir, "part")
    a, b = (p.filter(c).select(F.lower("p_name").alias("name")).distinct().withColumn(k, F.lit(True)) for c, k in (("p_size < 6", "before"), ("p_size > 45", "after")))
    return a.join(b, "name", "full").select("name", F.when(F.col("after").isNull(), "lost").when(F.col("before").isNull(), "gained").otherwise("both").alias("state"))


@query("""WITH m AS (SELECT l_returnflag AS run, 'rows' AS metric, count(*)::DOUBLE AS v FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'parts', count(DISTINCT l_partkey) FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'quantity', sum(l_quantity) FROM lineitem GROUP BY 1)
SELECT a.metric, a.v AS before, b.v AS after, b.v - a.v AS delta, round(100 * (b.v - a.v) / nullif(a.v, 0), 2) AS pct FROM m a JOIN m b ON a.metric = b.metric WHERE a.run = 'A' AND b.run = 'N'""")
def ab_comparison(spark, sf_dir):
    """Metrics of two runs side by side."""
    x = table(spark, sf_dir, "lineitem").filter("l_returnflag IN ('A', 'N')")
    side = lambda flag: [F.count_if(F.col("l_returnflag") == flag).cast("double"), F.countDistinct(F.when(F.col("l_returnflag") == flag, F.col("l_partkey"))).cast("double"), F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))]
    both = x.agg(*[c.alias(f"{s}{k}") for s, flag in (("a", "A"), ("b", "N")) for k, c in enumerate(side(flag))])
    rows = both.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a{k}").alias("before"), F.col(f"b{k}").alias("after")) for k, m in enumerate(("rows", "parts", "quantity"))])).alias("x")).select("x.*")
    return rows.withColumn("delta", F.col("after") - F.col("before")).withColumn("pct", F.round(F.try_divide(100 * F.col("delta"), F.col("before")), 2))


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey AS seq, nullif(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END, '') AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS b, substr(o_orderpriority, 1, 1) AS tag FROM orders)
SELECT k, min(seq) AS first, arg_min(a, seq) FILTER (a IS NOT NULL) AS a, arg_min(b, seq) FILTER (b IS NOT NULL) AS b, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM o GROUP BY k""")
def merge_by_name(spark, sf_dir):
    """Extractions of one name as one: the first is the base, later ones fill its gaps, tags are united."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("a"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("b"), F.substring("o_orderpriority", 1, 1).alias("tag"))
    one = merged_by_name(o.withColumn("tags", F.array("tag")).withColumn("first", F.col("at")), ["k"], "k", ["at"], ["first", "a", "b"], ["tags"], key=lambda c: c.cast("string"))
    return one.select("k", "first", "a", "b", F.array_join("tags", ",").alias("tags"))


@query("""SELECT l_orderkey AS grp, count(*) AS n, round(avg((l_discount > 0.05)::INT), 4) AS linked, round(count(DISTINCT l_partkey)::DOUBLE / count(*), 4) AS distinct_ratio, CAST(trunc(median(l_quantity)) AS BIGINT) AS median, round(stddev_pop(l_quantity) / avg(l_quantity), 4) AS cv FROM lineitem GROUP BY 1""")
def group_shapes(spark, sf_dir):
    """The shape of groups of siblings: shares, distinct ratio, median size, variation."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("l_discount") > 0.05).cast("int")), 4).alias("linked"), F.round(F.countDistinct("l_partkey") / F.count(F.lit(1)), 4).alias("distinct_ratio"), F.median("l_quantity").cast("long").alias("median"), F.round(F.stddev_pop("l_quantity") / F.avg("l_quantity"), 4).alias("cv"))


@query("""WITH p AS (SELECT url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS site, regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]*)', 1) AS first FROM pages), c AS (SELECT site, first, count(*) AS n FROM p GROUP BY 1, 2), t AS (SELECT site, count(*) AS total, count(*) FILTER (regexp_matches(url, '[?&]page=[0-9]+')) AS numbered FROM p GROUP BY 1)
SELECT t.site, total, numbered > 0 AS paginated, (SELECT '/' || first || '/*' FROM c WHERE c.site = t.site AND first <> '' AND n >= 0.6 * total) AS pattern FROM t""")
def detail_patterns(spark, sf_dir):
    """Of each site the path that most of its links have in common, and whether its lists are paged."""
    p = table(spark, sf_dir, "pages").select("url", I.authority(F.col("url")).alias("site"), F.regexp_extract("url", "^[a-z]+://[^/?#]*/([^/?#]*)", 1).alias("first"))
    c = p.groupBy("site", "first").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("url").rlike("[?&]page=[0-9]+")).alias("m"))
    t = c.groupBy("site").agg(F.sum("n").alias("total"), F.sum("m").alias("m"), F.max_by("first", F.when(F.col("first") != "", F.struct("n", "first"))).alias("best"), F.max(F.when(F.col("first") != "", F.col("n"))).alias("most"))
    return t.select("site", "total", (F.col("m") > 0).alias("paginated"), F.when(F.col("most") >= 0.6 * F.col("total"), F.concat(F.lit("/"), "best", F.lit("/*"))).alias("pattern"))


@query("""WITH p AS (SELECT o_custkey AS page, count(*) AS expected, count(*) FILTER (o_orderstatus = 'F') AS got FROM orders GROUP BY 1) SELECT page, expected, got FROM p WHERE expected - got >= 3 ORDER BY got / expected, expected DESC, page LIMIT 3""")
def worst_pages(spark, sf_dir):
    """The three pages with the worst recall."""
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("o_orderstatus") == "F").alias("got"))
    return p.filter("expected - got >= 3").orderBy(F.col("got") / F.col("expected"), F.desc("expected"), "page").limit(3)


@query("""SELECT o_orderstatus AS origin, count(*) AS found, count(*) FILTER (k <> 'junk') AS plausible, count(*) FILTER (k = 'kept') AS kept, count(*) FILTER (k = 'needs_geocoding') AS without_place FROM (SELECT o_orderstatus, CASE WHEN o_orderkey % 6 = 0 THEN 'junk' WHEN o_orderkey % 5 = 0 THEN 'needs_geocoding' WHEN o_totalprice / 4000 > 50 THEN 'out_of_radius' ELSE 'kept' END AS k FROM orders) GROUP BY 1""")
def discovery_funnel(spark, sf_dir):
    """By source how many candidates each step leaves."""
    o = table(spark, sf_dir, "orders")
    k = G.catchment_label(F.col("o_orderkey") % 6 == 0, F.when(F.col("o_orderkey") % 5 != 0, F.lit(48.0)), F.col("o_totalprice") / 4000, 50.0)
    rows = o.select(F.col("o_orderstatus").alias("origin"), k.alias("k"))
    count = lambda c: F.count_if(c)
    return rows.groupBy("origin").agg(F.count(F.lit(1)).alias("found"), count(F.col("k") != "junk").alias("plausible"), count(F.col("k") == "kept").alias("kept"), count(F.col("k") == "needs_geocoding").alias("without_place"))


@query("""WITH t AS (SELECT s_suppkey AS id, 40 + s_nationkey / 10 AS lat, 8 + s_nationkey / 10 AS lon, CASE WHEN s_suppkey % 2 = 0 THEN 4000.0 ELSE 700.0 END AS r, s_acctbal > 5000 AS busy FROM supplier), q AS (SELECT id, lat + a * r / 2 / 110574.0 AS lat, lon + b * r / 2 / 111320.0 / cos(radians(lat)) AS lon, r / 2 AS radius_m FROM t, (VALUES (-1), (1)) x(a), (VALUES (-1), (1)) y(b) WHERE busy AND r > 800)
SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, radius_m FROM q""")
def subdivided_tiles(spark, sf_dir):
    """The quarters of tiles whose answer was full."""
    s = table(spark, sf_dir, "supplier")
    t = s.select(F.col("s_suppkey").alias("id"), (40 + F.col("s_nationkey") / 10).alias("lat"), (8 + F.col("s_nationkey") / 10).alias("lon"), F.when(F.col("s_suppkey") % 2 == 0, 4000.0).otherwise(700.0).alias("radius_m"), (F.col("s_acctbal") > 5000).alias("busy"))
    q = G.subdivide(t, F.col("busy"))
    # moves of a whole tile's half along each side, from its centre
    return q.select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "radius_m")


@query("SELECT count(*) AS tiles, 2::BIGINT AS groups, count(*) * 2 AS calls, round(count(*) * 2 / 1000 * 35.0::DOUBLE, 2) AS usd FROM supplier")
def sweep_costs(spark, sf_dir):
    """What a sweep of these tiles for twelve types costs."""
    return G.sweep_cost(table(spark, sf_dir, "supplier"), types=12)


@query("""WITH c AS (SELECT n_nationkey, n_regionkey + 45.5 AS lat, n_regionkey < 3 AS near FROM nation WHERE n_nationkey % 4 <> 0) SELECT c_custkey, c.lat::DOUBLE AS lat, coalesce(near, false) AS in_radius FROM customer LEFT JOIN c ON c_nationkey = n_nationkey""")
def geocoded_places(spark, sf_dir):
    """Places with the coordinates that a cache has."""
    n = table(spark, sf_dir, "nation").filter("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("place"), (F.col("n_regionkey") + F.lit(45.5)).cast("double").alias("lat"), (F.col("n_regionkey") < 3).alias("in_radius"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("place"))
    return G.geocoded(c, n, ["place"]).select("c_custkey", "lat", "in_radius")


@query("""SELECT s_suppkey AS id, s_name AS name, (47 + s_nationkey / 10)::DOUBLE AS lat, (9 + s_nationkey / 10)::DOUBLE AS lon, CASE WHEN s_suppkey % 3 = 0 THEN 'yes' WHEN s_suppkey % 3 = 1 THEN 'brewery' END AS industry, (47 + s_nationkey / 10)::DOUBLE AS wkt_lat, round((141 + 3 * s_nationkey / 10) / 3, 4)::DOUBLE AS middle FROM supplier WHERE s_suppkey % 3 = 1
UNION ALL SELECT s_suppkey, s_name, 47 + s_nationkey / 10, 9 + s_nationkey / 10, NULL, 47 + s_nationkey / 10, round((141 + 3 * s_nationkey / 10) / 3, 4) FROM supplier WHERE s_suppkey % 3 <> 1""")
def map_answers(spark, sf_dir):
    """Elements of a map service's answer, a point in text form, a label, and the middle of an outline."""
    s = table(spark, sf_dir, "supplier")
    lat, lon = 47 + F.col("s_nationkey") / 10, 9 + F.col("s_nationkey") / 10
    place = F.struct(lat.alias("lat"), lon.alias("lon"))
    tags = F.create_map(F.lit("name"), F.col("s_name"), F.lit("office"), F.when(F.col("s_suppkey") % 3 == 0, "yes").when(F.col("s_suppkey") % 3 == 1, "brewery").otherwise(""))
    element = F.struct(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, lat).alias("lat"), F.when(F.col("s_suppkey") % 2 == 0, lon).alias("lon"), F.when(F.col("s_suppkey") % 2 == 1, place).alias("center"), tags.alias("tags"))
    x = formats.map_elements(s.select(F.to_json(F.struct(F.array(element).alias("elements"))).alias("body")))
    wkt = formats.point(F.concat(F.lit("Point("), F.col("lon"), F.lit(" "), F.col("lat"), F.lit(")")))
    ring = F.array(*[F.struct((F.col("lat") + d).alias("lat"), F.col("lon").alias("lon")) for d in (-1.0, 0.0, 1.0)])
    return x.select("id", "name", "lat", "lon", R.industry_of(F.col("tags")["office"]).alias("industry"), wkt["lat"].alias("wkt_lat"), F.round(N.centroid(ring)["lat"], 4).alias("middle"))


@query("SELECT s_suppkey, s_name AS firmenname, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 10 <> 0")
def sheet_round_trip(spark, sf_dir):
    """A register as a sheet and back: folded headers, rows without a name dropped."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("Nr"), F.when(F.col("s_suppkey") % 10 != 0, F.col("s_name")).alias("Firmen-Name"), F.col("s_nationkey").alias("Länder"), F.col("s_acctbal").alias("Größe"))
    path = scratch(spark, "sheet")
    formats.export_sheet(s, path)
    back = formats.sheet(spark, path, "Nr;Firmen-Name;Länder;Größe\n1;a;2;3", required="firmenname")
    return back.select(F.col("nr").cast("long").alias("s_suppkey"), "firmenname", F.col("lander").cast("int").alias("s_nationkey"), F.col("grosse").cast("double").alias("s_acctbal"))


@query("SELECT DISTINCT doc_id, source, coalesce(nullif(CASE WHEN doc_id % 9 = 0 THEN '' ELSE lang END, ''), '(none)') AS name FROM documents")
def capture_log(spark, sf_dir):
    """Extractions as appended lines of JSON, and read back."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.nullif(F.when(F.col("doc_id") % 9 != 0, F.col("lang")).otherwise(""), F.lit("")), F.lit("(none)")).alias("name"))
    path = scratch(spark, "capture")
    for part in (d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1")):
        formats.append_json(part, path)
    return spark.read.schema("doc_id long, source string, name string").json(path)


def placed_names(spark, sf_dir, later=False):
    """Names of parts in places, some by coordinates only; ``later`` is a newer version of the table."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name"), "p_brand").agg(F.min("p_partkey").alias("id"))
    b = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    city = F.when(b % 5 == 0, "").when(b % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("City "), "p_brand"))
    lat, lon = F.when(b % 5 == 0, 48.0 + b / 100.0), F.when(b % 5 == 0, 10.0 + (b % 3) / 10.0)
    name = F.col("name")
    if later:
        p = p.where("id % 17 <> 5")
        name, city = F.when(F.col("id") % 23 == 1, F.concat(name, F.lit(" works"))).otherwise(name), F.when(F.col("id") % 19 == 2, "City Brand#3").otherwise(city)
    rows = p.select("id", name.alias("name"), city.alias("city"), lat.alias("lat"), lon.alias("lon"))
    return rows.unionByName(rows.where("id % 31 = 3").withColumn("id", F.col("id") + 1_000_000).withColumn("name", F.concat("name", F.lit(" group")))) if later else rows


@query()
def refreshed_pairs(spark, sf_dir):
    """Pairs of one company after a table changed: kept, added and stale ones, comparing changed rows only."""
    place = ["name", "city", "lat", "lon"]
    old, new = placed_names(spark, sf_dir), placed_names(spark, sf_dir, later=True)
    before = written(M.company_pairs(old, "id", *place, ["small"]), "pairs")
    return M.refreshed_pairs(before, old, new, "id", *place, ["small"])[0]


@query()
def pool_matches(spark, sf_dir):
    """New rows against a pool: the first of the pool that is the same company by name and place."""
    pool, rows = placed_names(spark, sf_dir), placed_names(spark, sf_dir, later=True).withColumn("id", F.col("id") + 10_000_000)
    return M.pool_matches(rows, pool, "id", "name", "city", "lat", "lon", ["small"], ["name"])

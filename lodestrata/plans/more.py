"""Queries of logs, exports, registries, paging and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import scratch
from ..operators.ordering import numbered
from ..session import table
from .registry import query


@query("""SELECT page_id, 'chunk ' || page_id AS chunk, '' AS verdict, row_number() OVER (ORDER BY url, page_id) AS line FROM pages""")
def review_export(spark, sf_dir):
    """Extractions in the order of page and chunk, with an empty column for the verdict, as a sheet and back."""
    p = table(spark, sf_dir, "pages").select("url", "page_id", F.concat(F.lit("chunk "), "page_id").alias("chunk"), F.lit("").alias("verdict"))
    path = scratch(spark, "review-sheet")
    numbered(p, ["url", "page_id"]).sort("line").drop("url").write.option("header", True).option("emptyValue", '""').csv(path)
    return spark.read.option("header", True).option("emptyValue", "").schema("page_id long, chunk string, verdict string, line long").csv(path).withColumn("verdict", F.coalesce("verdict", F.lit("")))


@query("""WITH v AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY rev DESC) AS r FROM (SELECT vec_id, label, 0 AS rev FROM embeddings UNION ALL SELECT vec_id, label + 100, 1 FROM embeddings WHERE vec_id % 4 = 0))
SELECT vec_id, label FROM v WHERE r = 1 AND vec_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def vector_store(spark, sf_dir):
    """Vectors by key: later writes replace earlier ones, and a batch is fetched by its ids."""
    e = table(spark, sf_dir, "embeddings")
    writes = e.select("vec_id", "label", F.lit(0).alias("rev")).unionByName(e.filter("vec_id % 4 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(1).alias("rev")))
    stored = writes.groupBy("vec_id").agg(F.max_by("label", "rev").alias("label"))
    wanted = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("vec_id"))
    return stored.join(wanted, "vec_id", "left_semi")


@query("""WITH q AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, any_value(n) AS results, array_to_string(list(event_id ORDER BY r), ',') AS top FROM q WHERE r <= 5 GROUP BY user_id""")
def search_sessions(spark, sf_dir):
    """Of each search how many results it had, and its first five."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    top = e.withColumn("r", F.row_number().over(w)).filter("r <= 5").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "event_id"))), lambda x: x["event_id"]), ",").alias("top"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("results")).join(top, "user_id")


@query("SELECT doc_id, substring(text, 1, 500) AS subject, substring(source, 1, 255) AS sender, md5(substring(text, 1, 10000)) AS body FROM documents WHERE length(text) >= 100")
def newsletter_audit(spark, sf_dir):
    """What is kept of a message: the beginnings of its subject, sender and text, as its columns take them."""
    d = table(spark, sf_dir, "documents").filter(F.length("text") >= 100)
    return d.select("doc_id", F.substring("text", 1, 500).alias("subject"), F.substring("source", 1, 255).alias("sender"), F.md5(F.substring("text", 1, 10_000)).alias("body"))


@query("""WITH r AS (SELECT c_custkey AS n, c_custkey % 200 AS id, c_mktsegment AS kind, c_nationkey % 4 AS priority, CASE c_nationkey % 3 WHEN 0 THEN 'static' WHEN 1 THEN 'rendered' ELSE 'odd' END AS strategy FROM customer),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS k FROM r WHERE strategy <> 'odd') SELECT id, n, kind, strategy FROM f WHERE k = 1 AND priority <= 1 AND kind IN ('BUILDING', 'MACHINERY')""")
def source_registry(spark, sf_dir):
    """Sources of a registry: invalid ones left out, the first of each id, then by priority and kind."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_nationkey") % 3
    r = c.select(F.col("c_custkey").alias("n"), (F.col("c_custkey") % 200).alias("id"), F.col("c_mktsegment").alias("kind"), (F.col("c_nationkey") % 4).alias("priority"), F.when(k == 0, "static").when(k == 1, "rendered").otherwise("odd").alias("strategy"))
    first = r.filter(F.col("strategy").isin("static", "rendered")).groupBy("id").agg(F.min_by(F.struct("n", "kind", "priority", "strategy"), "n").alias("x")).select("id", "x.*")
    return first.filter((F.col("priority") <= 1) & F.col("kind").isin("BUILDING", "MACHINERY")).select("id", "n", "kind", "strategy")


@query("""SELECT c_custkey, c_name, coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS sector, greatest(c_acctbal, 0) AS balance FROM customer WHERE lower(c_mktsegment) LIKE '%house%' OR c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def sector_rows(spark, sf_dir):
    """Public rows of some sectors, with defaults where there is nothing."""
    c = table(spark, sf_dir, "customer").filter(F.lower("c_mktsegment").contains("house") | F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return c.select("c_custkey", "c_name", F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("")).alias("sector"), F.greatest("c_acctbal", F.lit(0.0)).alias("balance"))


@query("""SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS line FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50""")
def review_page(spark, sf_dir):
    """The second page of fifty of the queue, latest first."""
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)
    w = Window.orderBy(F.desc("o_orderdate"), "o_orderkey")  # over the hundred rows of two pages
    return o.select("o_orderkey", "o_orderstatus", F.row_number().over(w).alias("line")).filter("line > 50")


@query("""WITH a AS (SELECT 'group' AS kind, o_custkey AS id, max(o_orderdate) AS seen FROM orders WHERE o_orderstatus = 'F' GROUP BY 2 UNION ALL SELECT 'pair', o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P')
SELECT kind, id, row_number() OVER (ORDER BY seen DESC, kind, id) AS line FROM a ORDER BY line LIMIT 200""")
def merged_inbox(spark, sf_dir):
    """Groups and pairs in one inbox, latest first: its first two hundred."""
    o = table(spark, sf_dir, "orders")
    groups = o.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("seen")).select(F.lit("group").alias("kind"), "id", "seen")
    pairs = o.filter("o_orderstatus = 'P'").select(F.lit("pair").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("seen"))
    top = groups.unionByName(pairs).orderBy(F.desc("seen"), "kind", "id").limit(200)
    return top.select("kind", "id", F.row_number().over(Window.orderBy(F.desc("seen"), "kind", "id")).alias("line"))


@query("""WITH f AS (SELECT doc_id, list_distinct(list_filter(list_transform(list_slice(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), 1, 12), lambda w: lower(w)), lambda w: length(w) >= 4)) AS a, list_distinct(list_filter(list_transform(list_slice(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), 7, 18), lambda w: lower(w)), lambda w: length(w) >= 4)) AS b FROM documents)
SELECT doc_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 4) END AS overlap FROM f""")
def founder_overlap(spark, sf_dir):
    """The share of names that two lists have in common, names of four letters and more in any case; 0 if one is empty."""
    words = F.split("text", r"[\x20\x09-\x0D]+")
    names = lambda c: F.array_distinct(F.filter(F.transform(c, F.lower), lambda w: F.length(w) >= 4))
    d = table(spark, sf_dir, "documents").select("doc_id", names(F.slice(words, 1, 12)).alias("a"), names(F.slice(words, 7, 12)).alias("b"))
    return d.select("doc_id", F.round(F.when((F.size("a") > 0) & (F.size("b") > 0), T.jaccard(F.col("a"), F.col("b"))).otherwise(0.0), 4).alias("overlap"))


@query("""WITH a AS (SELECT 'id' || (o_custkey % 300) AS m FROM orders WHERE o_orderstatus = 'F' UNION SELECT unnest(['id' || (c_custkey % 400), 'https://x.org/' || (c_custkey % 7)]) FROM customer), b AS (SELECT DISTINCT 'id' || (l_partkey % 500) AS m FROM lineitem)
SELECT coalesce(a.m, b.m) AS marker, CASE WHEN starts_with(coalesce(a.m, b.m), 'https://') THEN 'url' ELSE 'id' END AS kind, CASE WHEN b.m IS NULL THEN 'old' WHEN a.m IS NULL THEN 'new' ELSE 'both' END AS state FROM a FULL JOIN b ON a.m = b.m""")
def marker_sets(spark, sf_dir):
    """Markers of old and new state, from a column and from nested histories: their union, and where each stands."""
    o, c, x = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    plain = o.filter("o_orderstatus = 'F'").select(F.concat(F.lit("id"), F.col("o_custkey") % 300).alias("m"))
    nested = c.select(F.explode(F.array(F.concat(F.lit("id"), F.col("c_custkey") % 400), F.concat(F.lit("https://x.org/"), F.col("c_custkey") % 7))).alias("m"))
    old = plain.unionByName(nested).distinct().withColumn("old", F.lit(True))
    new = x.select(F.concat(F.lit("id"), F.col("l_partkey") % 500).alias("m")).distinct().withColumn("new", F.lit(True))
    state = F.when(F.col("new").isNull(), "old").when(F.col("old").isNull(), "new").otherwise("both")
    return old.join(new, "m", "full").select(F.col("m").alias("marker"), F.when(F.col("m").startswith("https://"), "url").otherwise("id").alias("kind"), state.alias("state"))


@query("""WITH p AS (SELECT o_custkey AS page, count(*) AS expected, count(*) FILTER (o_orderstatus = 'F') AS got FROM orders GROUP BY 1), w AS (SELECT page, expected - got AS missing, row_number() OVER (ORDER BY expected - got DESC, page) AS r FROM p WHERE got < 0.6 * expected AND expected - got >= 5),
c AS (SELECT *, CAST(ceil(missing / 3.0) AS BIGINT) AS calls, sum(CAST(ceil(missing / 3.0) AS BIGINT)) OVER (ORDER BY r) AS spent FROM w WHERE r <= 3) SELECT page, missing, calls, spent <= 12 AS retried FROM c""")
def recall_retries(spark, sf_dir):
    """The three pages that miss most, with the calls that a retry takes, while a budget of twelve calls lasts."""
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("o_orderstatus") == "F").alias("got"))
    worst = p.filter((F.col("got") < 0.6 * F.col("expected")) & (F.col("expected") - F.col("got") >= 5)).select("page", (F.col("expected") - F.col("got")).alias("missing")).orderBy(F.desc("missing"), "page").limit(3)
    calls = worst.withColumn("calls", F.ceil(F.col("missing") / 3.0).cast("long"))
    spent = F.sum("calls").over(Window.orderBy(F.desc("missing"), "page").rowsBetween(Window.unboundedPreceding, 0))
    return calls.withColumn("retried", spent <= 12)


@query("""WITH k AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'name_batch' WHEN 1 THEN 'per_block' ELSE 'prose' END AS strategy, list_filter(list_transform(string_split_regex(text, '\\n'), lambda x: trim(x)), lambda x: x <> '') AS lines, text FROM documents)
SELECT doc_id, strategy, CASE strategy WHEN 'name_batch' THEN CAST(ceil(len(lines) / 6.0) AS BIGINT) WHEN 'per_block' THEN len(lines) ELSE 1 END AS chunks FROM k""")
def chunk_dispatch(spark, sf_dir):
    """How many chunks a text makes by the strategy of its page: lines in batches, a line each, or one of prose."""
    k = F.col("doc_id") % 3
    lines = F.size(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, "name_batch").when(k == 1, "per_block").otherwise("prose").alias("strategy"), lines.alias("n"))
    return d.select("doc_id", "strategy", F.when(F.col("strategy") == "name_batch", F.ceil(F.col("n") / 6.0).cast("long")).when(F.col("strategy") == "per_block", F.col("n").cast("long")).otherwise(F.lit(1).cast("long")).alias("chunks"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 90 DAY FROM orders) AND o_orderstatus <> 'P'""")
def since_bound(spark, sf_dir):
    """Messages of the last ninety days, to the day, that aren't done."""
    o = table(spark, sf_dir, "orders")
    last = o.agg(F.date_sub(F.max("o_orderdate"), 90).alias("since"))  # one row
    return o.filter("o_orderstatus <> 'P'").crossJoin(F.broadcast(last)).filter(F.to_date("o_orderdate") >= F.col("since")).select("o_orderkey")


@query("""WITH n AS (SELECT o_orderkey AS uid, '<' || (o_orderkey % 900) || '@' || lower(o_orderstatus) || '.org>' AS message FROM orders) SELECT message, max(uid) AS uid, count(*) AS copies FROM n GROUP BY 1""")
def message_ids(spark, sf_dir):
    """Messages by their own id, with the latest number that the mailbox gave them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.concat(F.lit("<"), F.col("o_orderkey") % 900, F.lit("@"), F.lower("o_orderstatus"), F.lit(".org>")).alias("message"))
    return o.groupBy("message").agg(F.max("uid").alias("uid"), F.count(F.lit(1)).alias("copies"))


@query("""WITH o AS (SELECT o_custkey AS page_id, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1), t AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'ItemList' ELSE 'WebPage' END AS type, 1 AS n FROM o WHERE page_id % 7 <> 0 UNION ALL SELECT page_id, 'Organization', f FROM o WHERE page_id % 7 <> 0 AND f > 0)
SELECT t.page_id, t.type, t.n::BIGINT AS n, CASE WHEN t.page_id % 5 <> 0 THEN 0 WHEN t.page_id % 2 = 0 THEN o.n ELSE o.f END::BIGINT AS items FROM t JOIN o USING (page_id)""")
def structured_data(spark, sf_dir):
    """Types and list sizes of pages' JSON-LD, broken scripts passed over."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").cast("int").alias("f"))
    k = F.col("page_id")
    nodes = F.array_repeat(F.to_json(F.struct(F.array(F.lit("Organization")).alias("@type"), F.lit("x").alias("name"))), F.col("f"))
    said = F.when(k % 2 == 0, F.concat(F.lit('"numberOfItems": '), "n", F.lit(", "))).otherwise("")
    top = F.concat(F.lit('{"@type": "'), F.when(k % 5 == 0, "ItemList").otherwise("WebPage"), F.lit('", '), said, F.lit('"itemListElement": ['), F.array_join(nodes, ","), F.lit("]}"))
    html = F.concat(F.lit('<html><script type="application/ld+json">'), F.when(k % 7 == 0, "{broken").otherwise(top), F.lit("</script></html>"))
    from ..functions.html import structured_types

    return structured_types(o.select("page_id", html.alias("html")))


@query("""SELECT page_id, contains(lower(url), '/fr/') OR contains(lower(url), 'page=') OR contains(lower(url), '/en/') AS detail FROM pages""")
def detail_markers(spark, sf_dir):
    """Pages whose address has one of the markers of a detail page."""
    marks = F.array(*map(F.lit, ("/fr/", "page=", "/en/")))
    return table(spark, sf_dir, "pages").select("page_id", F.exists(marks, lambda m: F.contains(F.lower("url"), m)).alias("detail"))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n'), lambda x: trim(x)), lambda x: length(x) >= 40) AS s FROM documents)
SELECT doc_id, len(s) AS slides, md5(array_to_string(list_transform(s, lambda x, i: '[' || i || '] ' || x), chr(10))) AS deck FROM s""")
def content_slides(spark, sf_dir):
    """Lines that hold enough to be a slide, numbered and joined."""
    s = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 40)
    d = table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    deck = F.array_join(F.transform("s", lambda x, i: F.concat(F.lit("["), i + 1, F.lit("] "), x)), "\n")
    return d.select("doc_id", F.size("s").cast("long").alias("slides"), F.md5(deck).alias("deck"))


@query("""SELECT c_custkey, concat_ws('; ', CASE WHEN c_nationkey % 6 = 0 THEN 'title missing' WHEN length(c_name) > 17 THEN 'title too long' END, CASE WHEN c_acctbal < 0 THEN 'amount negative' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY') THEN 'sector unknown' END) AS problems FROM customer""")
def draft_problems(spark, sf_dir):
    """What is wrong with a draft: required fields, lengths, values."""
    title = F.when(F.col("c_nationkey") % 6 != 0, F.col("c_name"))
    checks = F.array(F.when(title.isNull(), "title missing").when(F.length(title) > 17, "title too long"), F.when(F.col("c_acctbal") < 0, "amount negative"), F.when(~F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD", "MACHINERY"), "sector unknown"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_compact(checks), "; ").alias("problems"))


@query("""WITH n AS (SELECT s_suppkey + 1000 AS id, lower(s_name) AS k FROM supplier WHERE s_acctbal > 5000), o AS (SELECT c_custkey AS id, 'supplier#' || lpad(CAST(c_custkey * 3 AS VARCHAR), 9, '0') AS k FROM customer)
SELECT n.id, CASE WHEN o.id IS NULL THEN 'added' ELSE 'exists' END AS state, o.id AS known FROM n LEFT JOIN (SELECT k, min(id) AS id FROM o GROUP BY k) o USING (k)""")
def manual_adds(spark, sf_dir):
    """Rows entered by hand: added, or already there under the same name."""
    n = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select((F.col("s_suppkey") + 1000).alias("id"), F.lower("s_name").alias("k"))
    o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("known"), F.concat(F.lit("supplier#"), F.lpad((F.col("c_custkey") * 3).cast("string"), 9, "0")).alias("k"))
    first = o.groupBy("k").agg(F.min("known").alias("known"))
    return n.join(first, "k", "left").select("id", F.when(F.col("known").isNull(), "added").otherwise("exists").alias("state"), "known")


@query("""SELECT CASE WHEN s_acctbal < 3000 THEN 'logo_grid' WHEN s_acctbal < 6000 THEN 'prose' ELSE 'card_directory' END AS shape, count(*) AS sites, count(*) FILTER (s_nationkey > 4 AND s_acctbal NOT BETWEEN 3000 AND 5999.999) AS with_entities, round(avg(s_nationkey), 4) AS expected FROM supplier GROUP BY 1""")
def site_audit(spark, sf_dir):
    """Profiles of sites by shape: how many, how many are expected to list entities, and how many on average."""
    b = F.col("s_acctbal")
    s = table(spark, sf_dir, "supplier").select(F.when(b < 3000, "logo_grid").when(b < 6000, "prose").otherwise("card_directory").alias("shape"), F.col("s_nationkey").alias("expected"))
    lists = F.col("shape").isin("logo_grid", "card_directory", "article_feed") & (F.col("expected") > 4)
    return s.groupBy("shape").agg(F.count(F.lit(1)).alias("sites"), F.count_if(lists).alias("with_entities"), F.round(F.avg("expected"), 4).alias("expected"))

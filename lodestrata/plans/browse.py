"""Queries over records: filters, pages, facets, counts, run quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import browse as B
from ..operators import quality as Q
from ..session import table
from .registry import query


@query("SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment ILIKE '%build%' AND c_acctbal >= 0 AND c_acctbal <= 5000 ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 10")
def browse_filter_page(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter(B.criteria(like={"c_mktsegment": "build"}, between={"c_acctbal": (0, 5000)}))
    return B.page(c.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], 25, 10)


@query("SELECT c_custkey FROM customer ORDER BY (c_mktsegment IN ('BUILDING', 'MACHINERY'))::INT + (c_acctbal > 5000)::INT + (lower(c_name) LIKE '%gmbh%')::INT DESC, c_acctbal DESC, c_custkey LIMIT 40")
def browse_priority_sort(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    keys = B.priority_order(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"], F.col("c_acctbal") > 5000, F.col("c_name"), F.col("c_acctbal"))
    return B.page(c, [*keys, F.col("c_custkey")], 40).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%re%_%' OR p_brand ILIKE '%re%_%' OR p_type ILIKE '%re%_%'")
def keyword_search(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(B.criteria(any_like=([F.col("p_name"), F.col("p_brand"), F.col("p_type")], "re%_"))).select("p_partkey")


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey = 3 OR (s_nationkey IS NULL) OR s_acctbal BETWEEN 1000 AND 1500")
def register_filter(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.filter(B.criteria(equal={"s_nationkey": 3}) | B.criteria(unset=["s_nationkey"]) | B.criteria(between={"s_acctbal": (1000, 1500)})).select("s_suppkey", "s_nationkey", "s_acctbal")


@query("SELECT event_id, user_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) = 42")
def json_evidence_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.try_variant_get(F.parse_json("props"), "$.k", "int") == 42).select("event_id", "user_id")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate, o_orderkey LIMIT 30")
def backlog_before_limit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
    return B.page(o, [F.col("o_orderdate"), F.col("o_orderkey")], 30).select("o_orderkey", "o_orderdate")


@query("SELECT coalesce(o_orderpriority, 'none') AS risk, count(*) AS n FROM orders GROUP BY 1")
def risk_counts(spark, sf_dir):
    return B.counts_by(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), "risk")


@query("SELECT o_orderpriority AS priority, count_if(o_orderstatus = 'F') AS n_F, count_if(o_orderstatus = 'O') AS n_O, count_if(o_orderstatus = 'P') AS n_P FROM orders GROUP BY 1")
def status_matrix_pivot(spark, sf_dir):
    return B.pivot_counts(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.col("o_orderstatus"), "priority", ["F", "O", "P"])


@query(r"SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\.', '') AS site, count(*) AS n FROM pages GROUP BY 1")
def source_site_counts(spark, sf_dir):
    from ..functions.identity import base_domain

    return table(spark, sf_dir, "pages").groupBy(base_domain(F.col("url")).alias("site")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL ORDER BY p_brand LIMIT 200")
def facets(spark, sf_dir):
    return B.facet(table(spark, sf_dir, "part"), "p_brand")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), m AS (SELECT max(day) AS last FROM d),
s AS (SELECT CAST(unnest(generate_series(last - INTERVAL 13 DAY, last, INTERVAL 1 DAY)) AS DATE) AS day FROM m)
SELECT strftime(s.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM s LEFT JOIN d ON s.day = d.day""")
def kpi_growth_zero_filled(spark, sf_dir):
    return B.zero_filled_days(table(spark, sf_dir, "events"), "ts", 14).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 4")
def kpi_top_n(spark, sf_dir):
    return B.top_values(table(spark, sf_dir, "part"), "p_type", 4)


_VERDICT = "CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'VALID' WHEN l.quality = 0 THEN 'INVALID' WHEN l.toxic = 1 THEN ' partial' END"


@query(f"""WITH r AS (SELECT d.source, upper(trim({_VERDICT})) AS v, d.n_chars < 100 AS none, d.doc_id % 2 = 0 AS stored, CAST(d.n_chars AS DOUBLE) AS dur FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT source, count(*) AS total, count_if(v = 'VALID') AS valid, count_if(v = 'INVALID') AS invalid, count_if(v = 'PARTIAL') AS partial, count(*) - count_if(v IN ('VALID', 'INVALID', 'PARTIAL')) AS unreviewed,
count_if(none) AS none_extracted, count_if(stored) AS stored, count_if(none AND v = 'INVALID') AS coverage_gaps,
round(count_if(v = 'VALID') * 1.0 / nullif(count_if(v IN ('VALID', 'INVALID')), 0), 4) AS precision, round(count_if(v = 'INVALID') * 1.0 / nullif(count_if(v IN ('VALID', 'INVALID', 'PARTIAL')), 0), 4) AS false_positive_rate,
round(count_if(v = 'PARTIAL') * 1.0 / nullif(count_if(v IN ('VALID', 'INVALID', 'PARTIAL')), 0), 4) AS partial_rate, round(count_if(NOT none) * 1.0 / count(*), 4) AS extraction_rate, round(avg(dur), 2) AS avg_duration FROM r GROUP BY source""")
def validation_metrics(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "VALID").when(F.col("quality") == 0, "INVALID").when(F.col("toxic") == 1, " partial")
    return Q.verdict_metrics(d, verdict, F.col("n_chars") < 100, F.col("doc_id") % 2 == 0, F.col("n_chars").cast("double"), ["source"])


@query("""WITH x AS (SELECT o_custkey AS c, count(DISTINCT o_orderdate) AS extracted FROM orders GROUP BY 1), e AS (SELECT c_custkey AS c, c_nationkey + 5 AS expected FROM customer),
o AS (SELECT e.c AS page, CAST(expected AS BIGINT) AS expected, coalesce(extracted, 0) AS extracted FROM e LEFT JOIN x ON e.c = x.c)
SELECT page, expected, extracted, round(least(1.0, extracted * 1.0 / expected), 4) AS recall, expected - extracted AS gap FROM o WHERE expected > 0 AND round(least(1.0, extracted * 1.0 / expected), 4) < 0.6 AND expected - extracted >= 5""")
def recall_shortfalls(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderdate").cast("string").alias("name"))
    e = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), (F.col("c_nationkey") + 5).cast("long").alias("expected"))
    return Q.shortfalls(Q.page_outcomes(x, e, "page", F.col("name")))


@query("SELECT user_id, count(*) AS inserted, count_if(event_type = 'error') AS stubs, count_if(event_type = 'error') >= 15 AND count_if(event_type = 'error') * 1.0 / greatest(count(*), 1) >= 0.6 AS burst FROM events GROUP BY 1")
def bare_stub_burst(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("inserted"), F.count_if(F.col("event_type") == "error").alias("stubs"))
    return e.withColumn("burst", Q.stub_burst(F.col("stubs"), F.col("inserted")))


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1), p AS (SELECT *, greatest(1.0::DOUBLE, least(n::DOUBLE, 0.9::DOUBLE * (n + 1))) AS at_ FROM s), q AS (SELECT *, CAST(floor(at_ + 1e-9) AS INT) AS j FROM p)
SELECT event_type, n, v[1] AS least, round(list_median(v), 4) AS median, round(v[j] + (at_ - j) * (coalesce(v[j + 1], v[j]) - v[j]), 4) AS p90, v[-1] AS most FROM q""")
def latency_stats(spark, sf_dir):
    return Q.latency(table(spark, sf_dir, "events"), "value", ["event_type"])


@query("""WITH e AS (SELECT *, sum(CASE WHEN value < 10 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
r AS (SELECT event_id, user_id, count_if(value < 10) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS consecutive FROM e)
SELECT event_id, user_id, consecutive, consecutive >= 2 AS flagged FROM r""")
def consecutive_shortfalls(spark, sf_dir):
    return Q.consecutive(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") < 10).select("event_id", "user_id", "consecutive", "flagged")


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 3 - 1 AS failures, p_size % 2 = 0 AS render, p_size % 3 = 0 AS paginate, p_size % 5 = 0 AS cap, CASE p_partkey % 4 WHEN 0 THEN 'card_structured' WHEN 1 THEN 'alt_harvest' WHEN 2 THEN 'main_prose' ELSE 'full_text' END AS x, p_partkey % 7 AS pos FROM part)
SELECT k, CASE WHEN pos < 1 AND failures > 0 THEN 1 WHEN pos < 2 AND NOT render THEN 2 WHEN pos < 3 AND render AND NOT paginate THEN 3 WHEN pos < 4 AND cap THEN 4 WHEN pos < 5 AND x = 'card_structured' THEN 5 WHEN pos < 6 AND x = 'alt_harvest' THEN 6 WHEN pos < 7 AND x = 'main_prose' THEN 7 END AS step FROM p""")
def retry_ladder(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    x = F.when(k % 4 == 0, "card_structured").when(k % 4 == 1, "alt_harvest").when(k % 4 == 2, "main_prose").otherwise("full_text")
    return table(spark, sf_dir, "part").select(k.alias("k"), Q.retry_step(k % 3 - 1, size % 2 == 0, size % 3 == 0, size % 5 == 0, x, k % 7).alias("step"))


@query(r"""SELECT doc_id, length(left(text, 60)) > 45 OR len(list_filter(string_split_regex(left(text, 60), '\s+'), lambda w: w <> '')) > 6 OR regexp_matches(left(text, 60), '[?!:;–—]|\.\s') OR (contains(left(text, 60), ' ') AND ends_with(left(text, 60), '.')) AS headline FROM documents""")
def headline_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", Q.headline_like(F.left("text", F.lit(60))).alias("headline"))


@query(r"""WITH n AS (SELECT 'part' AS kind, p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer)
SELECT kind, id, length(name) > 45 OR len(list_filter(string_split_regex(name, '\s+'), lambda w: w <> '')) > 6 OR regexp_matches(name, '[?!:;–—]|\.\s') OR (contains(name, ' ') AND ends_with(name, '.')) AS headline FROM n""")
def headline_whole_names(spark, sf_dir):
    names = lambda t, c: table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(f"{c}key").alias("id"), F.col(f"{c[0]}_name").alias("name"))
    n = names("part", "p_part").unionByName(names("supplier", "s_supp")).unionByName(names("customer", "c_cust"))
    return n.select("kind", "id", Q.headline_like(F.col("name")).alias("headline"))


@query(r"""WITH n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Site ' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'Only' || chr(CAST(65 + s_suppkey % 26 AS INT)) || s_suppkey % 100 ELSE 'plain' END AS name, s_nationkey FROM supplier),
h AS (SELECT *, nullif(lower(trim(regexp_extract(name, '^(.*?)[\s_-]*0*([0-9]+)$', 1))), '') AS head FROM n)
SELECT s_suppkey, name FROM h WHERE head IS NULL OR (SELECT count(*) FROM h g WHERE g.head = h.head AND g.s_nationkey = h.s_nationkey) < 2""")
def numbered_sequences(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("Site "), k)).when(k % 3 == 1, F.concat(F.lit("Only"), F.char((65 + k % 26).cast("int")), k % 100)).otherwise("plain")
    s = table(spark, sf_dir, "supplier").select(k, "s_nationkey", name.alias("name"))
    return Q.numbered_sequence(s, ["s_nationkey"], F.col("name")).select("s_suppkey", "name")


@query("""WITH RECURSIVE o AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS i, CAST(l_quantity AS BIGINT) AS c FROM lineitem),
f AS (SELECT k, i, CASE WHEN c <= 60 THEN 60 - c ELSE 60 END AS room, c <= 60 AS took, c FROM o WHERE i = 1
UNION ALL SELECT o.k, o.i, CASE WHEN o.c <= f.room THEN f.room - o.c ELSE f.room END, o.c <= f.room, o.c FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1)
SELECT k, count(*) AS taken, CAST(sum(c) AS BIGINT) AS used FROM f WHERE took GROUP BY k""")
def budgeted_selection(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("long").alias("c"), "l_quantity", "l_linenumber", "l_partkey")
    took = Q.budgeted(items, ["k"], [F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_partkey")], "c", 60)
    return took.groupBy("k").agg(F.count(F.lit(1)).alias("taken"), F.sum("c").alias("used"))


@query("SELECT event_id, ts, user_id FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 50")
def run_history(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts", "user_id")


@query("SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS place FROM events GROUP BY 1, 2")
def rank_within_user(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")))


@query("SELECT count(*) AS total, count_if(c_acctbal < 0) AS negative, count_if(c_acctbal >= 5000) AS rich, count(DISTINCT c_nationkey) AS nations, round(avg(c_acctbal), 4) AS mean FROM customer")
def register_stats(spark, sf_dir):
    return table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.count_if(F.col("c_acctbal") >= 5000).alias("rich"), F.countDistinct("c_nationkey").alias("nations"), F.round(F.avg("c_acctbal"), 4).alias("mean"))

"""Queries over sources, crawls and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import html
from ..functions.identity import base_domain
from ..operators import register as R
from ..scratch import scratch, written
from ..sources import crawl, formats
from ..streaming import jobs, states, upserts
from ..session import table
from .registry import query
from .text import GROUPS, _CHUNKS, _SCORE


def _folder(spark, name):
    return scratch(spark, name)


def _stream(spark, sf_dir, name):
    # as a pattern, so that a table may be one file
    return jobs.stream_of(spark, f"{sf_dir}/{name}.parque[t]", table(spark, sf_dir, name).schema, files=100)


@query("SELECT DISTINCT user_id FROM events")
def stream_dedupe_ids(spark, sf_dir):
    f = _folder(spark, "ids")
    return jobs.run_available(jobs.new_ids(_stream(spark, sf_dir, "events").select("user_id"), "user_id"), f"{f}/out", f"{f}/state")


@query(_CHUNKS + f", r AS (SELECT source, len(list_filter(string_split_regex(chunk, '\\s+'), lambda w: w <> '')) >= 25 AND {_SCORE} >= 2 AS ok FROM chunks WHERE length(chunk) >= 100) SELECT source, count(*) AS chunks, count_if(ok) AS kept FROM r GROUP BY source")
def stream_chunk_yield(spark, sf_dir):
    f = _folder(spark, "yield")
    return jobs.run_complete(jobs.chunk_yield(_stream(spark, sf_dir, "documents"), GROUPS, ["source"]), f"{f}/out", f"{f}/state")


@query("""WITH e AS (SELECT *, sum(CASE WHEN value < 10 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
r AS (SELECT event_id, user_id, count_if(value < 10) OVER (PARTITION BY user_id, g ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS consecutive FROM e)
SELECT user_id AS key, event_id, consecutive, CASE WHEN consecutive >= 2 THEN 'flagged' ELSE 'active' END AS status FROM r""")
def stream_outcome_state(spark, sf_dir):
    f = _folder(spark, "state")
    rows = _stream(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") < 10).alias("short"))
    return jobs.run_available(jobs.outcome_state(rows, "user_id", "event_id", "short"), f"{f}/out", f"{f}/state")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    return jobs.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, g""")
def session_counts(spark, sf_dir):
    return jobs.session_counts(table(spark, sf_dir, "events"), "ts", "user_id")


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS src, (o_custkey * 3 + o_orderkey % 5) % 500 AS dst FROM orders), r(url, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.url WHERE r.depth < 4)
SELECT url, min(depth) AS depth FROM r GROUP BY url""")
def crawl_reach(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 3 + F.col("o_orderkey") % 5) % 500).alias("dst"))
    return crawl.reach(links, spark.range(1).select(F.col("id").alias("url")), 4)


@query("""SELECT doc_id, concat_ws(chr(10), 'Title ' || doc_id, nullif(CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END, ''), nullif(substring(text, 1, 4000), '')) AS doc FROM documents
WHERE length(concat_ws(chr(10), 'Title ' || doc_id, nullif(CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END, ''), nullif(substring(text, 1, 4000), ''))) >= 80""")
def feed_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    doc = formats.entry_document(F.concat(F.lit("Title "), F.col("doc_id")), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(""), F.col("text"))
    return d.select("doc_id", F.md5(doc).alias("d"), doc.alias("doc")).filter("doc IS NOT NULL").select("doc_id", "doc")


@query("SELECT doc_id, item_id FROM documents d JOIN (SELECT item_id, lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)) AS k FROM benchmark) b ON contains(lower(d.text), b.k) WHERE regexp_matches(b.k, '^[a-z]+ [a-z]+$') AND regexp_matches(lower(d.text), '(^|[^\\p{L}\\p{N}])' || split_part(b.k, ' ', 1) || '($|[^\\p{L}\\p{N}])')")
def page_keyword_scan(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.array_join(F.slice(F.split("text", " "), 1, 2), " ")).alias("keyword")).filter(F.col("keyword").rlike("^[a-z]+ [a-z]+$"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return formats.keyword_hits_in_pages(d, b, "text").join(b, "keyword").select("doc_id", "item_id")


@query("""SELECT p_name AS name, min(p_partkey) AS k FROM part GROUP BY p_name""")
def category_scan(spark, sf_dir):
    return R.first_by_name(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("k")), "name", ["k"])


@query("SELECT c_name AS name, c_acctbal AS bal, NULL::INT AS nation, 'a' AS origin FROM customer UNION ALL SELECT s_name, NULL, s_nationkey, 'b' FROM supplier")
def source_fan_in(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return R.fan_in({"a": a, "broken": None, "b": b})


@query("""WITH m AS (SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_id % 3 <> 0) SELECT event_id, ts FROM m ORDER BY ts, event_id LIMIT 40""")
def newsletter_scan(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return formats.new_messages(e, e.filter("event_id % 3 = 0"), F.lit("2024-01-10"), "ts", "event_id", 40)


@query("""WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, i, n FROM c""")
def batch_index(spark, sf_dir):
    w = Window.partitionBy("conv_id")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w.orderBy("turn")).alias("i"), F.count(F.lit(1)).over(w).alias("n"))


def _in_batches(spark, df, order, name, n=4, rows=1_000_000):
    """The rows as a stream of ``n`` batches in their order: a folder with as many files for each, of ``rows`` or more where
    there are more than one."""
    folder = _folder(spark, name)
    ranked = written(df, "rows")
    cuts = ranked.select(F.percentile_approx(order, [k / n for k in range(1, n)], 100)).first()[0] or []
    at = F.col(order)
    ends = list(zip([None, *cuts], [*cuts, None], strict=True))
    parts = [(F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high) for low, high in ends]
    # a file too few would mix batches, so it is the smallest batch that says how many each has
    files = max(1, min(ranked.select(*map(F.count_if, parts)).first()) // rows)
    for part in parts:
        batch = ranked.where(part)
        (batch.coalesce(1) if files == 1 else batch.repartition(files)).write.mode("append").parquet(folder)
    return jobs.stream_of(spark, folder, ranked.schema, files)


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def stream_upsert(spark, sf_dir):
    """The latest event of each user and type, merged batch by batch into versioned snapshots."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    f = _folder(spark, "upserts")
    target = upserts.SnapshotTable(spark, f"{f}/table", e.schema, ["user_id", "event_type"])
    return upserts.upsert_stream(_in_batches(spark, e, "event_id", "events"), target, ["event_id"], f"{f}/state")


@query()
def stream_recent_ids(spark, sf_dir):
    """Messages that aren't among the last fifty new ones of their mailbox: types of events as mailboxes, users as ids."""
    f = _folder(spark, "recent")
    rows = _in_batches(spark, table(spark, sf_dir, "events").select("event_type", "user_id", "event_id"), "event_id", "events")
    return jobs.run_available(states.recent_ids(rows, "event_type", "user_id", "event_id", keep=50), f"{f}/out", f"{f}/state")


def profile_events(spark, sf_dir):
    """Events as what happens to the profiles of sites: each user is a site."""
    e, v = table(spark, sf_dir, "events"), F.floor(F.col("value")).cast("long")
    kind = F.array(*map(F.lit, ("recall", "recall", "retry", "probe", "recall", "stale", "pin", "unpin", "guess", "probe")))
    return e.select(
        "user_id", "ts", F.col("event_id").alias("seq"), F.get(kind, F.pmod(v + F.length("event_type"), F.lit(10)).cast("int")).alias("kind"), (v % 7).alias("expected"), (v % 5).alias("extracted"),
        (v % 11 == 0).alias("recovered"), (v % 8).cast("int").alias("step"), (F.col("event_id") / 4000).cast("int").alias("version"), F.col("event_type").alias("strategy"), (v % 13 == 0).alias("forced"),
    )


@query()
def stream_profile_states(spark, sf_dir):
    """The life of each site's profile in the order of event time."""
    f = _folder(spark, "profiles")
    rows = _in_batches(spark, profile_events(spark, sf_dir), "seq", "events")
    return jobs.run_available(states.profile_states(rows, "user_id", "ts"), f"{f}/out", f"{f}/state")


def page_graph(spark, sf_dir):
    """Links between addresses of one site, on all pages: short paths as details, capitalised ones as promising."""
    p = table(spark, sf_dir, "pages")
    found = html.links(p).join(p.select("page_id", "url"), "page_id")
    site, path = base_domain(F.col("url")), F.regexp_extract("link", "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    tier = F.when(F.length(path) <= 3, crawl.DETAIL).when(path.rlike("^/[A-Z]"), crawl.HIGH).otherwise(crawl.LOW)
    return found.where(base_domain(F.col("link")) == site).select(site.alias("site"), F.col("url").alias("src"), F.col("link").alias("dst"), tier.alias("tier"), "position").distinct()


@query()
def budgeted_crawl(spark, sf_dir):
    """What a crawl of six pages a site visits, two at a time."""
    seeds = table(spark, sf_dir, "pages").select(base_domain(F.col("url")).alias("site"), "url")
    return crawl.crawl(page_graph(spark, sf_dir), seeds, pages=6, depth=2, batch=2)

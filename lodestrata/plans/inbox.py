"""Queries of the whole review inbox: orders are reviews of customers, their lines propose values for customers' fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import browse as B
from ..operators import inbox as I
from ..session import table
from .registry import query

_T = """WITH rv AS (SELECT o_orderkey AS review, o_custkey AS master, o_orderdate AS created, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE 'medium' END AS risk FROM orders WHERE o_orderstatus = 'O'),
ch AS (SELECT l_orderkey AS review, CASE l_returnflag WHEN 'A' THEN 'c_mktsegment' WHEN 'N' THEN 'c_nationkey' ELSE 'site' END AS field, min(CAST(l_suppkey % 7 AS VARCHAR)) AS new, min(l_linestatus) AS source FROM lineitem GROUP BY 1, 2),
lv AS (SELECT c_custkey AS master, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer WHERE c_custkey % 11 <> 0),
x AS (SELECT rv.*, ch.field, ch.new, ch.source FROM rv JOIN ch USING (review))
"""


def _reviews(spark, sf_dir):
    p = F.col("o_orderpriority")
    risk = F.when(p == "1-URGENT", "high").when(p == "5-LOW", "low").otherwise("medium")
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("review"), F.col("o_custkey").alias("master"), F.col("o_orderdate").alias("created"), risk.alias("risk"))


def _changes(spark, sf_dir):
    flag = F.col("l_returnflag")
    field = F.when(flag == "A", "c_mktsegment").when(flag == "N", "c_nationkey").otherwise("site")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("review"), field.alias("field"), (F.col("l_suppkey") % 7).cast("string").alias("new"), "l_linestatus")
    return lines.groupBy("review", "field").agg(F.min("new").alias("new"), F.min("l_linestatus").alias("source"))


def _live(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("master"), "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"))


@query(_T + """, c AS (SELECT master, field, new AS value, count(*) AS votes, max(created) AS seen_at, first(review ORDER BY created DESC, review DESC) AS newest, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM x GROUP BY ALL)
SELECT c.master, c.field, row_number() OVER (PARTITION BY c.master, c.field ORDER BY seen_at DESC, newest DESC) AS place, value, votes, newest, sources, CASE c.field WHEN 'c_mktsegment' THEN c_mktsegment WHEN 'c_nationkey' THEN c_nationkey END AS current FROM c LEFT JOIN lv USING (master)""")
def inbox_candidates(spark, sf_dir):
    """Every value that a field of a record might take, beside its live one."""
    c = I.candidates(_reviews(spark, sf_dir), _changes(spark, sf_dir), "master", "review", "created", _live(spark, sf_dir), ["c_mktsegment", "c_nationkey"])
    return c.withColumn("sources", F.array_join("sources", ","))


_ENTRIES = _T + """, a AS (SELECT master, count(*) AS reviews, CASE WHEN bool_or(risk = 'high') THEN 'high' ELSE first(risk ORDER BY created DESC, review DESC) END AS risk, min(created) AS first_seen, max(created) AS last_seen, first(review ORDER BY created DESC, review DESC) AS newest FROM rv GROUP BY 1),
n AS (SELECT master, count(*) AS changes, count(DISTINCT field) AS fields, count(DISTINCT (field, new)) AS candidates FROM x GROUP BY 1),
e AS (SELECT a.*, coalesce(changes, 0) AS changes, coalesce(fields, 0) AS fields, coalesce(candidates, 0) AS candidates, lv.master IS NULL AS master_missing FROM a LEFT JOIN n USING (master) LEFT JOIN lv USING (master))
"""


@query(_ENTRIES + "SELECT * FROM e")
def inbox_entries(spark, sf_dir):
    return I.entries(_reviews(spark, sf_dir), _changes(spark, sf_dir), "master", "review", "created", "risk", _live(spark, sf_dir))


@query(_ENTRIES + "SELECT * FROM e ORDER BY last_seen DESC, master LIMIT 40 OFFSET 10")
def inbox_page(spark, sf_dir):
    """The second page of the inbox, the last seen first."""
    e = I.entries(_reviews(spark, sf_dir), _changes(spark, sf_dir), "master", "review", "created", "risk", _live(spark, sf_dir))
    return B.page(e, [F.col("last_seen").desc(), F.col("master")], 40, 10)


_PICKS = _T + """, pk AS (SELECT c_custkey AS master, 'c_mktsegment' AS field, CAST(c_nationkey % 7 AS VARCHAR) AS value FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_custkey % 7 AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'site', NULL FROM customer WHERE c_custkey % 5 = 0),
st AS (SELECT rv.master, rv.review, CASE WHEN bool_and(ch.field IS NOT NULL AND pk.value IS NOT NULL AND ch.new = pk.value) THEN 'approved' ELSE 'rejected' END AS status
FROM rv LEFT JOIN ch USING (review) LEFT JOIN pk ON pk.master = rv.master AND pk.field = ch.field WHERE rv.master IN (SELECT master FROM pk) GROUP BY 1, 2)
"""


def _settled(spark, sf_dir):
    k = F.col("c_custkey")
    pick = lambda when, field, value: F.when(when, F.struct(F.lit(field).alias("field"), value.cast("string").alias("value")))
    picks = F.array_compact(F.array(pick(k % 2 == 0, "c_mktsegment", F.col("c_nationkey") % 7), pick(k % 3 == 0, "c_nationkey", k % 7), pick(k % 5 == 0, "site", F.lit(None))))
    p = table(spark, sf_dir, "customer").select(k.alias("master"), F.explode(picks).alias("p")).select("master", "p.*")
    return I.settle(_reviews(spark, sf_dir), _changes(spark, sf_dir), p, "master", "review")


@query(_PICKS + "SELECT * FROM st")
def picked_statuses(spark, sf_dir):
    """What becomes of the reviews of records for which values were picked."""
    return _settled(spark, sf_dir)[0]


@query(_PICKS + "SELECT DISTINCT st.master, ch.field, ch.new AS value FROM st JOIN ch USING (review) WHERE status = 'rejected'")
def picked_suppressed(spark, sf_dir):
    """Values that rejected reviews proposed."""
    return _settled(spark, sf_dir)[2]


@query("""SELECT event_id, user_id FROM events WHERE event_type = 'error' AND json_extract_string(props, '$.k') = '42' OR (event_type = 'click' AND (event_type ILIKE '%LIC%' OR CAST(user_id AS VARCHAR) ILIKE '%1%'))""")
def review_search(spark, sf_dir):
    """Rows by state, by a level within their evidence and by a word in either name."""
    of = lambda **k: I.review_filter(**k)
    names = [F.col("event_type"), F.col("user_id").cast("string")]
    where = of(equal={"event_type": "error"}, evidence=F.col("props"), evidence_level="42", path="$.k") | (of(equal={"event_type": "click"}) & (of(names=names[:1], q="LIC") | of(names=names, q="1")))
    return table(spark, sf_dir, "events").where(where).select("event_id", "user_id")


@query("""WITH e AS (SELECT o_custkey % 40 AS grp, o_custkey AS rec, o_orderkey AS pos, 'u' || (o_totalprice::BIGINT % 9) AS url, o_orderdate AS seen_at FROM orders),
m AS (SELECT grp, min(rec) AS keeper FROM e GROUP BY 1), r AS (SELECT e.*, rec = keeper AS kept, row_number() OVER (PARTITION BY grp, url ORDER BY rec <> keeper, rec, pos) AS n FROM e JOIN m USING (grp))
SELECT grp, count(*) AS n, array_to_string(list(url ORDER BY NOT kept, rec, pos), ',') AS urls, md5(array_to_string(list(strftime(seen_at, '%Y-%m-%d') ORDER BY NOT kept, rec, pos), ',')) AS days FROM r WHERE kept OR n = 1 GROUP BY 1""")
def merged_histories(spark, sf_dir):
    """Where merged records were seen: the keeper's entries, then what the others add."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("grp"), F.col("o_custkey").alias("rec"), F.col("o_orderkey").alias("pos"), F.struct(F.concat(F.lit("u"), F.rint("o_totalprice").cast("long") % 9).alias("url"), F.col("o_orderdate").alias("at")).alias("e"))
    rows = o.groupBy("grp", "rec").agg(F.array_sort(F.collect_list(F.struct("pos", "e"))).alias("l")).select("grp", "rec", F.col("l.e").alias("entries"))
    least = rows.groupBy("grp").agg(F.min("rec").alias("keeper"))
    h = I.merged_histories(rows.join(least, "grp"), "grp", F.col("rec") == F.col("keeper"), ["rec"], "entries")
    days = F.transform("entries", lambda e: F.date_format(e["at"], "yyyy-MM-dd"))
    return h.select("grp", F.size("entries").cast("long").alias("n"), F.array_join("entries.url", ",").alias("urls"), F.md5(F.array_join(days, ",")).alias("days"))


@query("""WITH g AS (SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS keeper FROM customer WHERE c_acctbal > 2000), r AS (SELECT o_custkey AS a, (o_custkey * 7 + o_orderkey) % 150 AS b FROM orders)
SELECT (SELECT count(DISTINCT keeper) FROM g) AS groups, (SELECT count(*) FROM g WHERE id <> keeper) AS losers,
count(*) FILTER (coalesce(x.keeper, a) = coalesce(y.keeper, b) AND (x.keeper IS NOT NULL OR y.keeper IS NOT NULL)) AS resolved, count(*) FILTER (coalesce(x.keeper, a) <> coalesce(y.keeper, b) AND (coalesce(x.keeper, a) <> a OR coalesce(y.keeper, b) <> b)) AS repointed FROM r LEFT JOIN g x ON x.id = a LEFT JOIN g y ON y.id = b""")
def sweep_totals(spark, sf_dir):
    """What merging all groups of alike records would do, to them and to the reviews that name them."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 2000").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment")
    least = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("id").alias("keeper"))
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 150).alias("b"))
    return I.sweep_totals(c.join(least, ["c_nationkey", "c_mktsegment"]).select("id", "keeper"), r, "a", "b")

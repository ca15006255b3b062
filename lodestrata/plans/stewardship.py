"""Queries of the write path: staged upserts, review actions, backlog, edits, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reviews as V
from ..operators import stewardship as S
from ..session import table
from .registry import query

_FIELDS = ["city", "country", "size"]

#: Suppliers as masters, customers in the order of their key as incoming rows, orders as pending proposals.
_STAGE = """WITH n AS (SELECT count(*) AS n FROM supplier),
m AS (SELECT s_suppkey AS master_id, s_name AS name, CASE WHEN s_acctbal < 2000 THEN '' ELSE 'City ' || s_nationkey END AS city, CASE WHEN s_acctbal > 8000 THEN NULL ELSE 'Land ' || (s_nationkey % 5) END AS country, CASE WHEN s_acctbal < 5000 THEN '0' ELSE CAST(s_nationkey AS VARCHAR) END AS size FROM supplier),
i AS (SELECT c_custkey AS seq, 100000 + c_custkey AS new_id, c_custkey % n AS master_id, CASE WHEN c_nationkey = 7 THEN ' x ' ELSE c_name END AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'exact_same_record' WHEN 'MACHINERY' THEN 'possible_duplicate' WHEN 'HOUSEHOLD' THEN 'anomaly' WHEN 'AUTOMOBILE' THEN 'no_match' ELSE 'exact_same_record' END AS outcome,
 CASE WHEN c_acctbal > 3000 THEN 'high' ELSE 'low' END AS risk, CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE 'CITY ' || (c_nationkey % 12) END AS city, CASE WHEN c_nationkey % 6 = 0 THEN '' ELSE 'Land  ' || (c_nationkey % 4) END AS country, CASE WHEN c_nationkey % 2 = 0 THEN '0' ELSE CAST(c_nationkey % 8 AS VARCHAR) END AS size FROM customer, n),
p AS (SELECT DISTINCT o_custkey % n AS master_id, CASE o_orderstatus WHEN 'F' THEN 'city' ELSE 'size' END AS field, CASE o_orderstatus WHEN 'F' THEN 'City ' || (o_custkey % 12) ELSE CAST(o_custkey % 8 AS VARCHAR) END AS new FROM orders, n WHERE o_totalprice < 20000),
x AS (SELECT i.seq, i.master_id, f.field, CASE f.field WHEN 'city' THEN m.city WHEN 'country' THEN m.country ELSE m.size END AS old, CASE f.field WHEN 'city' THEN i.city WHEN 'country' THEN i.country ELSE i.size END AS new FROM i JOIN m USING (master_id), (VALUES ('city'), ('country'), ('size')) f(field) WHERE i.outcome = 'exact_same_record' AND length(trim(i.name)) > 1),
y AS (SELECT *, regexp_replace(lower(trim(new)), '\\s+', ' ', 'g') AS k, coalesce(old, '') IN ('', '0') AS gap, first_value(seq) OVER w AS s1, first_value(new) OVER w AS n1 FROM x WHERE coalesce(new, '') NOT IN ('', '0') WINDOW w AS (PARTITION BY master_id, field ORDER BY seq)),
z AS (SELECT *, gap AND NOT EXISTS (SELECT 1 FROM p WHERE p.master_id = y.master_id AND p.field = y.field AND lower(p.new) <> regexp_replace(lower(trim(y.n1)), '\\s+', ' ', 'g')) AS takes FROM y),
u AS (SELECT *, takes AND seq = s1 AS fill, CASE WHEN takes AND seq > s1 THEN n1 ELSE old END AS cur FROM z),
v AS (SELECT *, min(seq) FILTER (NOT fill) OVER (PARTITION BY master_id, field, k) AS k1 FROM u WHERE fill OR coalesce(cur, '') IN ('', '0') OR regexp_replace(lower(trim(cur)), '\\s+', ' ', 'g') <> k),
c AS (SELECT seq, master_id, field, cur AS old, new, CASE WHEN fill THEN 'fill' WHEN k1 < seq OR EXISTS (SELECT 1 FROM p WHERE p.master_id = v.master_id AND p.field = v.field AND lower(p.new) = k) THEN 'covered' ELSE 'conflict' END AS action FROM v)
"""


def _masters(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k, b = F.col("s_nationkey"), F.col("s_acctbal")
    return s.select(F.col("s_suppkey").alias("master_id"), F.col("s_name").alias("name"), F.when(b < 2000, "").otherwise(F.concat(F.lit("City "), k)).alias("city"), F.when(b <= 8000, F.concat(F.lit("Land "), k % 5)).alias("country"), F.when(b < 5000, "0").otherwise(k.cast("string")).alias("size"))


def _incoming(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier").count()
    k, seg = F.col("c_nationkey"), F.col("c_mktsegment")
    outcome = F.when(seg == "MACHINERY", "possible_duplicate").when(seg == "HOUSEHOLD", "anomaly").when(seg == "AUTOMOBILE", "no_match").otherwise("exact_same_record")
    return c.select(
        F.col("c_custkey").alias("seq"), (F.col("c_custkey") + 100_000).alias("new_id"), (F.col("c_custkey") % n).alias("master_id"), F.when(k == 7, " x ").otherwise(F.col("c_name")).alias("name"), outcome.alias("outcome"),
        F.when(F.col("c_acctbal") > 3000, "high").otherwise("low").alias("risk"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("CITY "), k % 12)).alias("city"), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("Land  "), k % 4)).alias("country"), F.when(k % 2 == 0, "0").otherwise((k % 8).cast("string")).alias("size"),
    )


def _pending(spark, sf_dir):
    o, n = table(spark, sf_dir, "orders").filter("o_totalprice < 20000"), table(spark, sf_dir, "supplier").count()
    city = F.col("o_orderstatus") == "F"
    return o.select((F.col("o_custkey") % n).alias("master_id"), F.when(city, "city").otherwise("size").alias("field"), F.when(city, F.concat(F.lit("City "), F.col("o_custkey") % 12)).otherwise((F.col("o_custkey") % 8).cast("string")).alias("new")).distinct()


def _changes(spark, sf_dir):
    i = _incoming(spark, sf_dir).filter("outcome = 'exact_same_record' AND length(trim(name)) > 1")
    return S.proposals(_masters(spark, sf_dir), i, _pending(spark, sf_dir), _FIELDS)


@query(_STAGE + "SELECT * FROM c")
def staged_changes(spark, sf_dir):
    """What incoming rows fill, put up for review, or find put up already."""
    return _changes(spark, sf_dir)


@query(_STAGE + """, d AS (SELECT l_suppkey AS a, 100000 + l_orderkey AS b FROM lineitem WHERE l_linenumber = 1)
SELECT seq, CASE WHEN status IN ('no_op', 'staged_update', 'auto_merged_empty_duplicate') THEN master_id WHEN status IS NOT NULL THEN new_id END AS record_id, status FROM (
SELECT i.*, CASE WHEN length(trim(i.name)) < 2 THEN NULL WHEN outcome = 'exact_same_record' THEN CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.seq = i.seq AND action = 'conflict') THEN 'staged_update' ELSE 'no_op' END
 WHEN outcome = 'no_match' OR EXISTS (SELECT 1 FROM d WHERE d.a = i.master_id AND d.b = i.new_id) THEN 'new_master'
 WHEN outcome = 'anomaly' THEN 'staged_anomaly' WHEN risk = 'high' AND i.city = '' AND i.country = '' AND i.size = '0' AND NOT (coalesce(m.city, '') = '' AND m.country IS NULL AND m.size = '0') THEN 'auto_merged_empty_duplicate' ELSE 'staged_duplicate' END AS status FROM i JOIN m USING (master_id))""")
def staged_statuses(spark, sf_dir):
    """The six outcomes of a staged upsert."""
    different = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_suppkey").alias("a"), (F.col("l_orderkey") + 100_000).alias("b"))
    return S.staged(_incoming(spark, sf_dir), _masters(spark, sf_dir), _changes(spark, sf_dir), different, _FIELDS)


@query(_STAGE + """SELECT m.master_id, m.name, coalesce(max(c.new) FILTER (field = 'city'), any_value(m.city)) AS city, coalesce(max(c.new) FILTER (field = 'country'), any_value(m.country)) AS country, coalesce(max(c.new) FILTER (field = 'size'), any_value(m.size)) AS size
FROM m LEFT JOIN c ON c.master_id = m.master_id AND c.action = 'fill' GROUP BY ALL""")
def staged_masters(spark, sf_dir):
    """The masters after the fills."""
    return S.filled(_masters(spark, sf_dir), _changes(spark, sf_dir), _FIELDS)


_RV = """WITH r AS (SELECT o_orderkey AS review_id, CASE WHEN o_orderkey % 2 = 0 THEN 'possible_duplicate' ELSE 'field_update' END AS review_type, o_custkey AS master_id, o_custkey + 7 AS other_id, CASE o_orderstatus WHEN 'P' THEN 'approved' WHEN 'F' THEN 'pending' ELSE 'rejected' END AS status FROM orders),
a AS (SELECT l_orderkey + (CASE WHEN l_quantity > 45 THEN 1000000 ELSE 0 END) AS review_id, max(CASE l_returnflag WHEN 'A' THEN 'approve' WHEN 'N' THEN 'undo' ELSE CASE WHEN l_linestatus = 'F' THEN 'delete' ELSE 'reject' END END) AS action FROM lineitem GROUP BY 1),
t AS (SELECT coalesce(r.review_id, a.review_id) AS review_id, r.review_type, r.master_id, r.other_id, r.status AS was, a.action, CASE WHEN a.action IS NULL THEN NULL WHEN r.status IS NULL THEN 'missing' WHEN (r.status = 'pending' AND a.action <> 'undo') OR (r.status IN ('approved', 'rejected') AND a.action = 'undo') THEN 'ok' ELSE 'conflict' END AS result FROM r FULL JOIN a ON r.review_id = a.review_id)
"""


def _acted(spark, sf_dir):
    o, x = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    status = F.when(F.col("o_orderstatus") == "P", "approved").when(F.col("o_orderstatus") == "F", "pending").otherwise("rejected")
    r = o.select(F.col("o_orderkey").alias("review_id"), F.when(F.col("o_orderkey") % 2 == 0, "possible_duplicate").otherwise("field_update").alias("review_type"), F.col("o_custkey").alias("master_id"), (F.col("o_custkey") + 7).alias("other_id"), status.alias("status"))
    action = F.when(F.col("l_returnflag") == "A", "approve").when(F.col("l_returnflag") == "N", "undo").when(F.col("l_linestatus") == "F", "delete").otherwise("reject")
    a = x.groupBy((F.col("l_orderkey") + F.when(F.col("l_quantity") > 45, 1_000_000).otherwise(0)).alias("review_id")).agg(F.max(action).alias("action"))
    return S.act(r, a)


@query(_RV + "SELECT review_id, result, CASE WHEN result = 'ok' THEN CASE action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'delete' THEN 'deleted' ELSE 'pending' END ELSE was END AS status FROM t")
def review_actions(spark, sf_dir):
    """Bulk approve, reject, delete and undo: what each id becomes, and ids that fail."""
    return _acted(spark, sf_dir).select("review_id", "result", "status")


@query(_RV + "SELECT DISTINCT least(master_id, other_id) AS a, greatest(master_id, other_id) AS b FROM t WHERE result = 'ok' AND action = 'reject' AND review_type = 'possible_duplicate'")
def suppression_memory(spark, sf_dir):
    """Pairs that rejections say are different."""
    return S.suppressed(_acted(spark, sf_dir))


_LP = "WITH q AS (SELECT o_custkey AS master_id, CASE WHEN o_orderkey % 3 = 0 THEN 'city' ELSE 'stage' END AS field, CASE WHEN o_totalprice < 100000 THEN upper(substr(o_orderpriority, 1, 4)) ELSE substr(o_orderpriority, 1, 4) END AS new, o_orderkey AS review_id, CASE o_orderstatus WHEN 'F' THEN 'field_update' WHEN 'P' THEN 'anomaly' ELSE 'possible_duplicate' END AS review_type FROM orders), mc AS (SELECT master_id, field FROM q GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT lower(trim(new))) > 1)\n"


def _proposed(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    word = F.substring("o_orderpriority", 1, 4)
    kind = F.when(F.col("o_orderstatus") == "F", "field_update").when(F.col("o_orderstatus") == "P", "anomaly").otherwise("possible_duplicate")
    return o.select(F.col("o_custkey").alias("master_id"), F.when(F.col("o_orderkey") % 3 == 0, "city").otherwise("stage").alias("field"), F.when(F.col("o_totalprice") < 100_000, F.upper(word)).otherwise(word).alias("new"), F.col("o_orderkey").alias("review_id"), kind.alias("review_type"))


@query(_LP + "SELECT * FROM mc")
def clobber_detection(spark, sf_dir):
    """Fields whose proposals would overwrite one another."""
    return S.multi_candidates(_proposed(spark, sf_dir))


@query(_LP + "SELECT review_type, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM mc WHERE mc.master_id = q.master_id AND mc.field = q.field)) AS applicable FROM q GROUP BY review_type")
def bulk_dry_run(spark, sf_dir):
    """Reviews by type, and how many of them an unattended run may apply."""
    p = _proposed(spark, sf_dir)
    m = S.multi_candidates(p).withColumn("several", F.lit(True))
    return p.join(m, ["master_id", "field"], "left").groupBy("review_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("several").isNull()).alias("applicable"))


@query(_LP + """, live AS (SELECT c_custkey AS master_id, 'city' AS field, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS live FROM customer UNION ALL SELECT c_custkey, 'stage', CASE WHEN c_acctbal < 5000 THEN '' ELSE c_mktsegment END FROM customer)
SELECT q.master_id, q.field, min(new) AS value, CASE WHEN coalesce(any_value(live), '') <> '' THEN 'kept' WHEN count(DISTINCT lower(trim(new))) = 1 THEN 'applied' ELSE 'contested' END AS decision FROM q LEFT JOIN live USING (master_id, field) GROUP BY q.master_id, q.field""")
def backlog_drain(spark, sf_dir):
    """A backlog's fields: applied, contested, or kept as the record has a value."""
    c = table(spark, sf_dir, "customer")
    row = lambda f, v: F.struct(F.lit(f).alias("field"), v.alias("live"))
    live = c.select(F.col("c_custkey").alias("master_id"), F.explode(F.array(row("city", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_mktsegment"))), row("stage", F.when(F.col("c_acctbal") < 5000, "").otherwise(F.col("c_mktsegment"))))).alias("x")).select("master_id", "x.*")
    return S.drained(live, _proposed(spark, sf_dir).select("master_id", "field", "new"))


@query("""WITH t AS (SELECT o_custkey AS k, CASE o_orderstatus WHEN 'F' THEN 'segment' WHEN 'P' THEN 'city' ELSE 'balance' END AS field, o_orderpriority AS value, o_orderdate AS d, o_orderkey AS o FROM orders),
l AS (SELECT k, field, arg_max(value, {'d': d, 'o': o}) AS value FROM t WHERE field <> 'balance' GROUP BY ALL), w AS (SELECT k, max(value) FILTER (field = 'segment') AS s, max(value) FILTER (field = 'city') AS c FROM l GROUP BY k)
SELECT c_custkey AS k, c_acctbal AS balance, coalesce(w.s, c_mktsegment) AS segment, coalesce(w.c, CAST(c_nationkey AS VARCHAR)) AS city, concat_ws(',', CASE WHEN w.s <> c_mktsegment THEN 'segment' END, CASE WHEN w.c <> CAST(c_nationkey AS VARCHAR) THEN 'city' END) AS edited FROM customer LEFT JOIN w ON w.k = c_custkey""")
def whitelisted_edit(spark, sf_dir):
    """The last patch of each allowed field, and which fields it changed; patches of other fields do nothing."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("city"))
    field = F.when(F.col("o_orderstatus") == "F", "segment").when(F.col("o_orderstatus") == "P", "city").otherwise("balance")
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), field.alias("field"), F.col("o_orderpriority").alias("value"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return S.edited(c, p, "k", ["segment", "city"])


@query("""WITH i AS (SELECT DISTINCT l_partkey * 2 AS id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)
SELECT coalesce(p_partkey, id) AS id, CASE WHEN p_partkey IS NULL THEN 'missing' WHEN id IS NULL THEN 'unmarked' ELSE 'marked' END AS state FROM part FULL JOIN i ON p_partkey = id""")
def interest_marking(spark, sf_dir):
    """Records marked by a list of ids, and ids of the list that no record has."""
    ids = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 40").select((F.col("l_partkey") * 2).alias("id")).distinct().withColumn("wanted", F.lit(True))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "missing").when(F.col("wanted"), "marked").otherwise("unmarked")
    return p.join(ids, "id", "full").select("id", state.alias("state"))


@query("""WITH g AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0 OR c_nationkey = 3)
SELECT 'record' AS kind, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT id FROM g) UNION ALL SELECT 'review', count(*) FROM orders WHERE o_custkey NOT IN (SELECT id FROM g) AND o_custkey + 7 NOT IN (SELECT id FROM g)""")
def cascade_delete(spark, sf_dir):
    """What is left once records and the reviews that name them on either side are gone."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    gone = c.filter("c_acctbal < 0 OR c_nationkey = 3").select(F.col("c_custkey").alias("id"))
    left = S.without_records(c.select("c_custkey"), gone, "c_custkey").agg(F.lit("record").alias("kind"), F.count(F.lit(1)).alias("n"))
    reviews = S.without_records(o.select("o_custkey", (F.col("o_custkey") + 7).alias("other")), gone, "o_custkey", "other")
    return left.unionByName(reviews.agg(F.lit("review").alias("kind"), F.count(F.lit(1)).alias("n")))


@query("""WITH k AS (SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS keeper FROM customer), r AS (SELECT o_orderkey, o_custkey AS a, o_custkey + o_orderkey % 9 AS b FROM orders)
SELECT o_orderkey, coalesce(x.keeper, a) AS a, coalesce(y.keeper, b) AS b, coalesce(x.keeper, a) = coalesce(y.keeper, b) AS same FROM r LEFT JOIN k x ON x.id = a LEFT JOIN k y ON y.id = b""")
def review_repoint(spark, sf_dir):
    """Pair reviews after their records were merged; those whose sides became one are to be rejected."""
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    first = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("id").alias("keeper"))
    keepers = c.join(first, ["c_nationkey", "c_mktsegment"]).select("id", "keeper")
    r = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("a"), (F.col("o_custkey") + F.col("o_orderkey") % 9).alias("b"))
    return V.repoint(r, keepers, "a", "b")


@query("""WITH r AS (SELECT DISTINCT o_custkey AS id, o_custkey % 40 AS other FROM orders) SELECT r.id, r.other, s.s_name AS name, s.s_suppkey IS NULL AS master_missing FROM r LEFT JOIN supplier s ON s.s_suppkey = r.id""")
def review_hydration(spark, sf_dir):
    """Reviews with their live record, or marked where it is gone."""
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_custkey") % 40).alias("other")).distinct()
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(True).alias("there"))
    return r.join(s, "id", "left").select("id", "other", "name", F.col("there").isNull().alias("master_missing"))


_VD = """WITH f AS (SELECT l_suppkey AS master_id, CASE l_returnflag WHEN 'A' THEN ' Town' WHEN 'N' THEN 'land' ELSE 'secret' END AS field, CASE WHEN l_linenumber % 2 = 0 THEN 'city ' || (l_partkey % 5) ELSE '' END AS value, 'https://www.s' || (l_partkey % 30) || '.com/' AS url FROM lineitem),
sh AS (SELECT s_suppkey AS master_id, 'http://S' || ((s_suppkey + g) % 30) || '.com' AS url FROM supplier, (VALUES (0), (3), (5)) t(g)), lv AS (SELECT s_suppkey AS master_id, 'city' AS field, CASE WHEN s_nationkey % 2 = 0 THEN NULL ELSE 'City ' || (s_nationkey % 5) END AS live FROM supplier UNION ALL SELECT s_suppkey, 'country', '' FROM supplier),
n AS (SELECT master_id, CASE lower(trim(field)) WHEN 'town' THEN 'city' WHEN 'land' THEN 'country' ELSE lower(trim(field)) END AS field, value, regexp_replace(regexp_replace(lower(url), '^https?://(www\\.)?', ''), '/+$', '') AS u FROM f WHERE value <> ''),
ok AS (SELECT n.master_id, n.field, n.value, lv.live FROM n JOIN lv USING (master_id, field) WHERE EXISTS (SELECT 1 FROM sh WHERE sh.master_id = n.master_id AND regexp_replace(lower(sh.url), '^https?://', '') = n.u) AND (coalesce(live, '') = '' OR lower(live) <> lower(value))),
vp AS (SELECT master_id, field, min(value) AS value, CASE WHEN coalesce(any_value(live), '') = '' THEN 'fill' ELSE 'conflict' END AS kind FROM ok GROUP BY ALL)
"""


def _verdicts(spark, sf_dir):
    x, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    field = F.when(F.col("l_returnflag") == "A", " Town").when(F.col("l_returnflag") == "N", "land").otherwise("secret")
    f = x.select(F.col("l_suppkey").alias("master_id"), field.alias("field"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("city "), F.col("l_partkey") % 5)).otherwise("").alias("value"), F.concat(F.lit("https://www.s"), F.col("l_partkey") % 30, F.lit(".com/")).alias("url"))
    shown = s.select(F.col("s_suppkey").alias("master_id"), F.explode(F.array(*map(F.lit, (0, 3, 5)))).alias("g")).select("master_id", F.concat(F.lit("http://S"), (F.col("master_id") + F.col("g")) % 30, F.lit(".com")).alias("url"))
    row = lambda n, v: F.struct(F.lit(n).alias("field"), v.alias("live"))
    city = F.when(F.col("s_nationkey") % 2 != 0, F.concat(F.lit("City "), F.col("s_nationkey") % 5))
    live = s.select(F.col("s_suppkey").alias("master_id"), F.explode(F.array(row("city", city), row("country", F.lit("")))).alias("x")).select("master_id", "x.*")
    return S.verdict_proposals(f, shown, {"town": "city", "land": "country"}, ["city", "country"], live)


@query(_VD + "SELECT * FROM vp")
def verdict_proposals(spark, sf_dir):
    """Findings whose source was shown, by usual field names, where the record has nothing or something else."""
    return _verdicts(spark, sf_dir)


@query(_VD + """, r AS (SELECT s_suppkey AS master_id, s_name AS name, CASE WHEN s_nationkey % 2 = 0 THEN NULL ELSE 'City ' || (s_nationkey % 5) END AS city, '' AS country FROM supplier), w AS (SELECT master_id, max(value) FILTER (field = 'city') AS c, max(value) FILTER (field = 'country') AS l FROM vp GROUP BY 1)
SELECT r.master_id, name, coalesce(city, w.c) AS city, CASE WHEN city IS NOT NULL AND lower(city) <> lower(w.c) THEN w.c END AS proposed_city, coalesce(w.l, country) AS country, NULL::VARCHAR AS proposed_country FROM r LEFT JOIN w USING (master_id)""")
def proposal_apply(spark, sf_dir):
    """A register after findings: gaps filled, disagreements beside the value."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("master_id"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") % 2 != 0, F.concat(F.lit("City "), F.col("s_nationkey") % 5)).alias("city"), F.lit("").alias("country"))
    return S.applied(s, _verdicts(spark, sf_dir), "master_id", ["city", "country"])


@query("""WITH e AS (SELECT o_custkey AS g, o_orderkey AS id, o_orderstatus = 'F' AS sheet, round(o_totalprice, -4) AS evidence FROM orders)
SELECT id, first_value(id) OVER (PARTITION BY g ORDER BY sheet DESC, evidence DESC, id) AS survivor FROM e""")
def survivor_choice(spark, sf_dir):
    """Which of a group's rows stays: the sheet's, then the richest, then the oldest."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("sheet"), F.round("o_totalprice", -4).alias("evidence"))
    return S.survivors(o, "g", "id", [F.col("sheet"), F.col("evidence")])
